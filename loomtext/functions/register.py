"""SQL names for the functions that aren't built in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtext.functions import jsonx
from loomtext.functions.text import _blake2b
from loomtext.operators.blocks import scan
from loomtext.operators.chunk import pack
from loomtext.operators.segment import segments_of


def register(spark: SparkSession) -> None:
    """loom_blake2b(text), loom_json_repair(text); table functions loom_chunks(text, most, overlap), loom_segments(text) and loom_blocks(text).

    loom_json_repair is the SQL text of `repair`'s expression, so it stays in the JVM.
    """

    class Chunks:
        def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple]:
            for i, (content, length, kind) in enumerate(pack(text, most, overlap) if text else ()):
                yield i, content, length, kind

    class Segments:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, x in enumerate(segments_of(text) if text else ()):
                yield i, x["text"], x["type"], x["start_pos"], x["end_pos"], x["code_type"]

    class Blocks:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, b in enumerate(scan(text, False) if text else ()):
                yield i, b["type"], b["content"], b["level"], b["language"], b["items"]

    spark.udf.register("loom_blake2b", F.pandas_udf(_blake2b, "string"))
    spark.udtf.register("loom_chunks", F.udtf(Chunks, returnType="chunk_id int, content string, length int, type string"))
    spark.udtf.register("loom_segments", F.udtf(Segments, returnType="seg_idx int, text string, type string, start_pos int, end_pos int, code_type string"))
    spark.udtf.register("loom_blocks", F.udtf(Blocks, returnType="block int, type string, content string, level int, language string, items array<string>"))
    body = spark.createDataFrame([], "text string").select(jsonx.repair(F.col("text")))
    sql = body._jdf.queryExecution().analyzed().expressions().head().children().head().sql()
    spark.sql(f"create or replace temporary function loom_json_repair(text string) returns string return {sql}")
