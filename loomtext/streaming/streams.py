"""Structured Streaming: buffered normalisation of response chunks, dedup, segmentation of arriving files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators import dedup, segment
from loomtext.operators.responses import clean

ENDED = re.compile(r"[.!?]\s*\Z")
BUFFERED = "stream_id string, unit long, raw string, done boolean"
STATE = "buffer string, units long, chunks long"


def folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's checkpoint or output, where executors share one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomtext-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def complete(buffer: str) -> bool:
    """Whether a buffer ends a sentence, closes its fences, or holds a paragraph break."""
    fences = buffer.count("```")
    return bool(ENDED.search(buffer)) or (fences >= 2 and fences % 2 == 0) or "\n\n" in buffer


def _buffer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Chunks of one stream in their order; a chunk with done=true flushes what is left."""
    held, units, chunks = state.get if state.exists else ("", 0, 0)
    rows, out = pd.concat(list(batches)).sort_values("seq"), []
    for text, done in zip(rows["chunk"], rows["done"], strict=True):
        held, chunks = held + (text or ""), chunks + 1
        if complete(held) or (done and held):
            out.append((key[0], units, held, bool(done)))
            held, units = "", units + 1
        elif done:
            out.append((key[0], units, "", True))
    state.update((held, units, chunks))
    yield pd.DataFrame(out, columns=["stream_id", "unit", "raw", "done"])


def buffered(chunks: DataFrame) -> DataFrame:
    """Normalised units of a stream of (stream_id, seq, chunk, done); cleaning itself stays in the JVM."""
    units = chunks.groupBy("stream_id").applyInPandasWithState(_buffer, BUFFERED, STATE, "append", GroupStateTimeout.NoTimeout)
    return units.withColumn("content", clean(F.col("raw"))).drop("raw")


def ollama_chunks(payloads: DataFrame, raw: str = "raw", stream_id: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Chunk payloads of Ollama (one JSON object each) as chunks for `buffered`; a payload without a response is an empty chunk."""
    at = lambda x: F.get_json_object(raw, f"$.{x}")
    text = F.coalesce(at("response"), at("message.content"), F.lit(""))
    return payloads.select(F.col(stream_id).cast("string").alias("stream_id"), F.col(seq).alias("seq"), text.alias("chunk"), F.coalesce(at("done").try_cast("boolean"), F.lit(False)).alias("done"))


def ollama_units(units: DataFrame, model: str | None = None) -> DataFrame:
    """Units of such streams as responses: stream_id, unit, content, model (none on the row that ends a stream), done, provider."""
    return units.select("stream_id", "unit", "content", F.when(~F.col("done"), F.lit(model)).alias("model"), "done", F.lit("ollama").alias("provider"))


def counted(segments: DataFrame, name: str = "loomtext") -> DataFrame:
    """segments with counts that Progress reads: rows, duplicates (where they are flagged) and bytes of text."""
    skipped = F.count_if("duplicate") if "duplicate" in segments.columns else F.lit(0).cast("bigint")
    return segments.observe(name, F.count(F.lit(1)).alias("segments_processed"), skipped.alias("duplicates_skipped"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes_processed"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Everything that is there now through the stream, and its output as a table."""
    spark = stream.sparkSession
    out = folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files; a table that is one file is picked from its folder by name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder_, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder_)


def buffered_batch(spark: SparkSession, path: str) -> DataFrame:
    """Turns of conversations as chunks of a stream per conversation; the last turn is its end, which flushes what is left."""
    ends = spark.read.parquet(path).groupBy(F.col("conv_id").alias("__conv")).agg(F.max("turn").alias("__last"))
    turns = read_table(spark, path).join(ends, F.col("conv_id") == F.col("__conv"))
    chunks = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), (F.col("turn") == F.col("__last")).alias("done"))
    return run_available(buffered(chunks), "stream-buffer")


def firsts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, nulls last; combined before its shuffle. Of rows that are equal in `order`, any one is the first."""
    by = F.struct(*(F.struct(F.col(x).isNull(), F.col(x)) for x in order))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), by).alias("__first")).select("__first.*")


def _folders(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """The folders that batches (those of smaller numbers, if one is given) have written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    return [x.toString() for x in found if before is None or int(x.getName()) < before]


def first_batches(stream: DataFrame, path: str, keys: list[str], order: list[str], time: str, delay: str, checkpoint: str):  # noqa: ANN201
    """Each micro-batch adds the first row of each key to a folder of its number, which a replay overwrites.

    Left out is a row that doesn't come before what earlier batches wrote for its key. Only rows written with a time of
    at most `delay` before the batch's newest are looked at, so state is bounded; a key that is older, or a row
    that comes late, is written again. So `firsts` of all folders are those of the stream, whatever came when.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, firsts(batch, keys, order)
        if old := _folders(spark, path, number):
            oldest = batch.agg(F.max(time) - F.lit(delay).cast("interval")).scalar()
            held = spark.read.schema(batch.schema).parquet(*old).where(F.col(time) >= oldest)
            both = held.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
            new = firsts(both, keys, [*order, "__new"]).where("__new").drop("__new")
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def dedup_batch(spark: SparkSession, path: str, keys: list[str], time: str = "ts", delay: str = "365 days", order: list[str] | None = None) -> DataFrame:
    """First rows of each key by `order` (time, then the other columns, if none is given), through a stream of bounded state."""
    rows = read_table(spark, path).withColumn(time, F.col(time).cast("timestamp"))
    order = order or [time, *(x for x in rows.columns if x != time)]
    out = folder(spark, "stream-dedup")
    first_batches(rows, out, keys, order, time, delay, folder(spark, "stream-dedup-state")).start().awaitTermination()
    found = _folders(spark, out)
    return firsts(spark.read.schema(rows.schema).parquet(*found) if found else spark.createDataFrame([], rows.schema), keys, order)


def segments_of_files(spark: SparkSession, path: str, granularity: str = "sentence") -> DataFrame:
    """A stream of segments of text files that arrive in a folder, exact per file; with normalised hashes."""
    files = spark.readStream.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return dedup.hashed(segment.segment(files, granularity))


def unseen_batches(stream: DataFrame, index_path: str, write: Callable[[DataFrame, int], None], order: list[str], checkpoint: str):  # noqa: ANN201
    """Each micro-batch loses what the index knows and what repeats inside it, is written, and joins the index.

    The index has a folder for each batch, which a replay overwrites, so a batch that is run again after
    a failure gives the same rows.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _folders(spark, index_path, number)
        new = dedup.survivors(batch.where("hash is not null"), order)
        if old:
            new = dedup.unseen(new, spark.read.schema(dedup.INDEX).json(old))
        write(new, number)
        dedup.index(batch, order).write.mode("overwrite").json(f"{index_path}/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class Progress(StreamingQueryListener):
    """Counts of a session's streams, and a call for each batch with them."""

    def __init__(self, call: Callable[[dict], None] | None = None):
        self.call = call
        self.counts = {"batches": 0, "rows_read": 0, "rows_written": 0, "segments_processed": 0, "duplicates_skipped": 0, "bytes_processed": 0}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        more = {"batches": 1, "rows_read": p.numInputRows, "rows_written": max(0, p.sink.numOutputRows)}
        for row in (p.observedMetrics or {}).values():
            more |= {k: v for k, v in row.asDict().items() if k in self.counts}
        self.counts = {k: v + more.get(k, 0) for k, v in self.counts.items()}
        if self.call:
            self.call(dict(self.counts))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
