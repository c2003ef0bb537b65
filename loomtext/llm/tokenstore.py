"""Token-id output as ORC: ascending document ids, run-length-encoded integers, row indexes, Bloom filters.

Documents are dealt by ranges of doc_id and sorted, so file k holds smaller ids than file k+1 and
each stripe covers a narrow range of ids. ORC keeps integers run-length-encoded; its row indexes
(minimum and maximum per stride) and the Bloom filters on doc_id let a lookup skip files, stripes
and strides by metadata alone, and stripes are read in parallel.

Defined results: a null or empty text is the end id alone; null ids come first; rows that are equal
in doc_id stand next to each other in their input order; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import partitions_for, sliced, texts_of
from loomtext.llm.tokens import default_path, encoder

STORED = "doc_id bigint, file_start bigint, n_tokens bigint, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, stripe_bytes: int = 16 << 20, stride_rows: int = 1000) -> None:
    """Encode every text and write `path`: doc_id, file_start (ids before it in its file), n_tokens, ids."""
    model = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in sliced(batches, 4096):
            low = 0
            for ids, at in encoder(model).flat(texts_of(batch, 1), end_id):
                lengths = np.diff(at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(lengths)), pa.array(start + at[:-1]), pa.array(lengths), lists], ["doc_id", "file_start", "n_tokens", "ids"])
                low, start = low + len(lengths), start + int(at[-1])

    # A second key, so that rows of one doc_id needn't be one range.
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("__row"))
    dealt = dealt.repartitionByRange(partitions_for(docs), "doc_id", "__row").sortWithinPartitions("doc_id", "__row").select("doc_id", "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.row.index.stride": str(stride_rows), "orc.stripe.size": str(stripe_bytes), "compression": "lz4"}
    # One file for each task, whatever the session says, as file_start counts a task's ids.
    dealt.mapInArrow(encode, STORED).write.options(**options).option("maxRecordsPerFile", 0).orc(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).orc(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 of the stored ids."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            lists = batch.column(3)
            flat = memoryview(lists.flatten().to_numpy().astype("<u4", copy=False)).cast("B")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            cuts = 4 * np.concatenate([[0], np.cumsum(sizes)])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(crc, pa.int64())], ["file", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    stored = _stored(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "file_start", "ids")
    checked = stored.mapInArrow(check, "file string, doc_id bigint, file_start bigint, n_tokens bigint, ids_crc32 bigint")
    # Files ascend in doc_id as their names do; a file's ids before it are the totals of the earlier files.
    totals = _stored(spark, path).groupBy(F.col("_metadata.file_name").alias("__file")).agg(F.sum("n_tokens").alias("__ids"))
    before = Window.orderBy(F.regexp_extract("__file", r"part-(\d+)", 1).cast("bigint"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__file", F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__base"))
    joined = checked.join(bases, F.col("file") == F.col("__file"))
    return joined.select("doc_id", (F.col("__base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the given documents; files, stripes and strides without them are skipped."""
    return _stored(spark, path).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "ids")
