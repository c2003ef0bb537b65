"""Prompts: normalise, type, chunk, flag repeated chunks, enrich; and the rollup to one row per prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.text import code_blocks, hash_chunk, normalize_prompt, prompt_type, token_estimate
from loomtext.operators import dedup
from loomtext.operators.chunk import chunks
from loomtext.plans.scratch import materialize, partitions_for

OPTIMIZED = ("ollama", "openai", "anthropic")


def with_ids(df: DataFrame, order: list[str], prompt_id: str = "id") -> DataFrame:
    """df with prompts' ids where they have none: prompt_0, prompt_1, ... in order.

    Rows are dealt by ranges of the order and written once, each with its range and its place there; the
    ranges' sizes, one number each, are summed and joined back. Both uses read what was written: a second shuffle
    would sample other ranges.
    """
    parts = df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order)
    # A row's number is its partition's, shifted, and its place.
    parts = materialize(parts.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "prompt-ids")
    sizes = parts.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__p", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    out = parts.join(bases, F.col("__part") == F.col("__p"))
    number = F.concat(F.lit("prompt_"), (F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("string"))
    return out.withColumn(prompt_id, F.coalesce(F.col(prompt_id), number)).drop("__part", "__at", "__p", "__base")


def process(df: DataFrame, order: list[str], content: str = "content", prompt_id: str = "id", most: int = 2048, overlap: int = 200, seen: DataFrame | None = None) -> DataFrame:
    """One row per segment of each prompt; empty prompts have none.

    A segment is a duplicate if an earlier segment of the batch, or one in `seen` (hash), is equal.
    """
    kept = [x for x in dict.fromkeys([*order, *(x for x in df.columns if x not in (content, prompt_id))]) if x in df.columns]
    normal = df.where(F.length(content) > 0).withColumn("__text", normalize_prompt(F.col(content))).withColumn("type", prompt_type(F.col("__text")))
    cut = normal.select(*kept, F.col(prompt_id).cast("string").alias("prompt_id"), "type", F.explode_outer(chunks(F.col("__text"), most, overlap)).alias("c")).where(F.col("c").isNotNull())
    rows = cut.select(*kept, "prompt_id", "type", F.col("c.id").alias("segment_index"), "c.content", "c.length", hash_chunk(F.col("c.content")).alias("hash"))
    rows = dedup.flag(rows, [*order, "segment_index"])
    if seen is not None:
        old = seen.select(F.col("hash").alias("__seen")).distinct()
        rows = rows.join(old, F.col("hash") == F.col("__seen"), "left").withColumn("duplicate", F.col("duplicate") | F.col("__seen").isNotNull()).drop("__seen")
    return rows.withColumns({
        "id": F.concat_ws("_seg_", "prompt_id", F.col("segment_index").cast("string")), "normalized": F.lit(True), "token_estimate": token_estimate(F.col("content")),
        "code_blocks": F.when(F.contains("content", F.lit("```")), code_blocks(F.col("content"))), "timestamp": F.current_timestamp(),
    })


def rollup(segments: DataFrame) -> DataFrame:
    """One row per prompt: contents joined by blank lines in order, type of the first, tokens summed."""
    parts = F.array_sort(F.collect_list(F.struct("segment_index", "content")))
    out = segments.groupBy("prompt_id").agg(parts.alias("p"), F.min_by("type", "segment_index").alias("type"), F.sum("token_estimate").cast("bigint").alias("token_estimate"), F.count("*").alias("segments"))
    return out.select("prompt_id", F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"), "type", "token_estimate", "segments", F.lit("input").alias("direction"))


def for_provider(rolled: DataFrame, provider: str) -> DataFrame:
    """Known providers are tagged; others leave the prompts as they are."""
    tag = F.lit(provider if provider in OPTIMIZED else None).cast("string")
    return rolled.withColumns({"provider": tag, "optimized_for": tag})


def statistics(segments: DataFrame, most: int = 2048, overlap: int = 200) -> DataFrame:
    out = segments.agg(F.countDistinct("prompt_id").alias("processed_count"), F.countDistinct("hash").alias("unique_hashes"))
    return out.withColumns({"max_chars": F.lit(most), "overlap": F.lit(overlap)})
