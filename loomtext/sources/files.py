"""Sources and sinks: text, JSON and JSON-lines prompts, segments, statistics, code trees."""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import ParsingError, ValidationError
from loomtext.functions import rx

#: Parts of a path at which a crawl leaves a file out.
IGNORED = ("node_modules", "__pycache__", ".git", "venv", "env", ".pytest_cache", "dist", "build", ".egg-info")
#: Bytes of a file that are looked at for its encoding.
HEAD = 1024


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def check_readable(spark: SparkSession, path: str, most_mb: float | None = None) -> str:
    """The path, if it is there and not larger than `most_mb`."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        raise ValidationError(f"no such file: {path}")
    if most_mb is not None and fs.getContentSummary(at).getLength() > most_mb * 2**20:
        raise ValidationError(f"larger than {most_mb} MB: {path}")
    return path


def check_writable(spark: SparkSession, path: str) -> str:
    """The path, if a file can be written in its folder, which is made where it isn't there."""
    fs, at = _fs(spark, path)
    folder = at.getParent() or at
    probe = spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    try:
        fs.mkdirs(folder)
        fs.create(probe).close()
        fs.delete(probe, False)
    except Py4JJavaError as e:
        raise ValidationError(f"can't be written: {path}") from e
    return path


def check_encoding(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """The path, if the first HEAD bytes of its files are in the encoding; a character that the head cuts off doesn't count."""
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.substring("content", 1, HEAD).alias("head"), "length")

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = []
            for name, head, length in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                try:
                    codecs.getincrementaldecoder(encoding)().decode(head, length <= HEAD)
                except UnicodeDecodeError:
                    wrong.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string())], ["path"])

    if found := heads.mapInArrow(bad, "path string").orderBy("path").limit(3).collect():
        raise ParsingError(f"not in {encoding}: {', '.join(r.path for r in found)}")
    return path


def read_chunks(spark: SparkSession, path: str, size: int = 8192) -> DataFrame:
    """file, chunk, text: the files' texts in parts of `size` characters; the last may be shorter, an empty file has none."""
    if size < 1:
        raise ValidationError(f"chunks have a positive size: {size}")
    parts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.lit(size)).cast("int"))
    cut = read_texts(spark, path).where(F.length("text") > 0).select("file", "text", F.explode(parts).alias("chunk"))
    return cut.select("file", "chunk", F.substr("text", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row per file; a folder is read with its subfolders."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_prompts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """ord, id, content of prompts in txt (parts between lines of ---), json (a list, {"prompts": [...]} or one object) or jsonl files."""
    kind = kind or {".json": "json", ".jsonl": "jsonl"}.get(PurePosixPath(path).suffix, "txt")
    if kind == "txt":
        parts = read_texts(spark, path).select("file", F.posexplode(F.split("text", "\n---\n")).alias("pos", "part"))
        found = parts.select("file", "pos", F.lit(None).cast("string").alias("id"), rx.strip(F.col("part")).alias("content")).where("content <> ''")
    elif kind in ("json", "jsonl"):
        if kind == "json":
            body = F.trim("text")
            listed = F.coalesce(F.when(F.startswith(body, F.lit("[")), body), F.when(F.get_json_object(body, "$.prompts").isNotNull(), F.get_json_object(body, "$.prompts")), F.concat(F.lit("["), body, F.lit("]")))
            items = read_texts(spark, path).select("file", F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "item"))
        else:
            # A file's lines keep their order in a stable number: partition, then place.
            items = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("raw")).where("raw <> ''")
            items = items.select("file", "pos", F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>")[0].alias("item"))
        field = lambda x: F.get_json_object("item", f"$.{x}")
        found = items.select("file", "pos", field("id").alias("id"), F.coalesce(field("content"), F.col("item")).alias("content"))
    else:
        raise ValidationError(f"prompts are txt, json or jsonl: {kind}")
    return found.select(F.struct("file", "pos").alias("ord"), "id", "content")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. A schema saves the pass that infers one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_segments(segments: DataFrame, path: str, kind: str = "jsonl", source: str = "", statistics: DataFrame | None = None) -> None:
    """Segments as JSON lines, or as lines with a header file of metadata (kind json): path/segments and path/metadata.

    statistics: one row, which the header holds. The two are files of their own, as all segments in one JSON value would be one task's.
    """
    if kind == "jsonl":
        write_jsonl(segments, path)
    elif kind == "json":
        write_jsonl(segments, f"{path}/segments")
        header = segments.agg(F.count("*").alias("total_segments")).select(F.lit(source).alias("input_file"), F.current_timestamp().alias("processed_at"), "total_segments")
        if statistics is not None:
            header = header.join(F.broadcast(statistics.limit(1).select(F.struct("*").alias("statistics"))), F.lit(True))
        write_jsonl(header, f"{path}/metadata")
    else:
        raise ValidationError(f"segments are json or jsonl: {kind}")


def render_statistics(row: dict, kind: str = "json") -> str:
    """One row of statistics as JSON or as lines of text."""
    if kind == "json":
        return json.dumps(row, indent=2, default=str)
    if kind == "txt":
        return "\n".join(f"{k}: {v}" for k, v in row.items())
    raise ValidationError(f"statistics are json or txt: {kind}")


def write_statistics(stats: DataFrame, path: str, kind: str = "json") -> None:
    """A one-row table of statistics as a text file in the folder `path`."""
    text = render_statistics(stats.first().asDict(recursive=True), kind)
    stats.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def crawl(spark: SparkSession, path: str, extensions: tuple[str, ...], ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """file, text of a tree's files with these extensions, without those whose path below the tree holds an ignored part."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(x.lstrip(".") for x in extensions) + "}").text(path, wholetext=True)
    found = files.select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    root = _fs(spark, path)[1].toUri().getPath().rstrip("/")
    below = F.regexp_replace("file", f"^[a-zA-Z0-9+.-]*:?/*{re.escape(root).lstrip('/')}", "") if root else F.col("file")
    for name in ignored:
        found = found.where(~F.contains(below, F.lit(name)))
    return found
