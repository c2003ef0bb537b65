"""Dedup by normalised hash: flags, survivors, an index that outlives runs, statistics.

The first row of each hash is found by an aggregate of hashes and order keys, which is combined before its shuffle;
rows meet it by their order key, which few rows share, and not by their hash. So neither a hash that a third of
all rows have nor the rows without one are a task's rows; what is shuffled is the hashes and, once, the rows.

A missing hash is grouped as an empty one and sorted out after the aggregate: a filter on the hash, or one
that the planner infers for a nullable key, would be pushed to the scan and compute every hash twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.text import digest, flatten_for_dedup, preview, trim_for_dedup

SHORT = 10
INDEX = "hash string, text string, first_seen string, occurrences bigint"


def hashed(df: DataFrame, text: str = "text", algorithm: str = "sha256", least: int = SHORT, normalize: bool = True) -> DataFrame:
    """df with `hash`; texts of under `least` characters have none and are never duplicates."""
    if not normalize:
        return df.withColumn("hash", F.when(F.length(text) >= least, digest(F.col(text), algorithm)))
    # The flattened text is a column of its own, as the tests for code look at it a dozen times.
    flat = df.withColumn("__flat", flatten_for_dedup(F.col(text)))
    return flat.withColumn("hash", F.when(F.length(text) >= least, digest(trim_for_dedup(F.col("__flat")), algorithm))).drop("__flat")


def _placed(df: DataFrame, order: list[str], hash_column: str) -> DataFrame:
    """df with `__first`: whether a row's order key is that of its hash's first row; false without a hash."""
    key = F.coalesce(F.col(hash_column), F.lit(""))
    first = df.groupBy(key.alias("__hash")).agg(F.min(F.struct(*order)).alias("__key"), F.count(hash_column).alias("__n")).where("__n > 0")
    first = first.select("__hash", *(F.col(f"__key.{x}").alias(f"__key{i}") for i, x in enumerate(order)))
    same = F.col("__own") == F.col("__hash")
    for i, x in enumerate(order):
        same = same & F.col(x).eqNullSafe(F.col(f"__key{i}"))
    joined = df.withColumn("__own", key).join(first, same, "left")
    return joined.withColumn("__first", F.col("__hash").isNotNull() & F.col(hash_column).isNotNull()).drop("__hash", "__own", *(f"__key{i}" for i in range(len(order))))


def flag(df: DataFrame, order: list[str], hash_column: str = "hash") -> DataFrame:
    """df with `duplicate`: whether an earlier row has the same hash. A null hash is never a duplicate; of rows equal in order and hash, one is the first."""
    place = F.row_number().over(Window.partitionBy(*order, hash_column, "__first").orderBy(F.lit(0)))
    found = _placed(df, order, hash_column)
    return found.withColumn("duplicate", F.col(hash_column).isNotNull() & (~F.col("__first") | (place > 1))).drop("__first")


def survivors(df: DataFrame, order: list[str], hash_column: str = "hash") -> DataFrame:
    """The first row of each hash (rows equal to it in order as well), and all rows without one."""
    return _placed(df, order, hash_column).where(F.col(hash_column).isNull() | F.col("__first")).drop("__first")


def index(df: DataFrame, order: list[str], text: str = "text", seen: Column | None = None) -> DataFrame:
    """One row per hash: preview of its first text, when it was first seen, occurrences."""
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if seen is None else seen
    first = F.min(F.struct(*(F.col(x) for x in order), preview(F.col(text)).alias("__text"), when.alias("__seen")))
    grouped = df.groupBy(F.coalesce("hash", F.lit("")).alias("__hash")).agg(first.alias("f"), F.count("hash").alias("occurrences"), F.max("hash").alias("hash"))
    return grouped.where("hash is not null").select("hash", F.col("f.__text").alias("text"), F.col("f.__seen").alias("first_seen"), "occurrences")


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences add up; the earlier entry keeps its preview."""
    both = old.select("*", F.lit(0).alias("__run")).unionByName(new.select("*", F.lit(1).alias("__run")))
    first = F.min(F.struct("__run", "first_seen", "text"))
    return both.groupBy("hash").agg(first.alias("f"), F.sum("occurrences").alias("occurrences")).select("hash", F.col("f.text").alias("text"), F.col("f.first_seen").alias("first_seen"), "occurrences")


def save_index(df: DataFrame, path: str) -> None:
    if not path:
        raise ValueError("an index needs a path")
    df.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).json(path)


def export_index(df: DataFrame, path: str, kind: str = "jsonl") -> None:
    if kind == "jsonl":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.select("hash", "text", "first_seen", "occurrences").write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"export as jsonl or csv: {kind}")


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose hash isn't in the index; the planner broadcasts the index if it is small."""
    return df.join(seen.select("hash").distinct(), "hash", "left_anti")


def known(df: DataFrame, seen: DataFrame) -> DataFrame:
    return df.join(seen.select("hash").distinct(), "hash", "left_semi")


def lookup(df: DataFrame, seen: DataFrame) -> DataFrame:
    """df with the index entry of each row's hash, or nulls."""
    entry = seen.select("hash", F.col("text").alias("preview"), "first_seen", "occurrences")
    return df.join(entry, "hash", "left")


def statistics(flagged: DataFrame, *by: str) -> DataFrame:
    """total_processed, unique_content, duplicates_found, dedup_ratio of flagged rows that have a hash."""
    new = F.col("hash").isNotNull() & ~F.col("duplicate")
    out = flagged.groupBy(*by).agg(F.count("hash").alias("total_processed"), F.count_if(new).alias("unique_content"), F.count_if("duplicate").alias("duplicates_found"))
    out = out.where("total_processed > 0") if by else out
    return out.withColumn("dedup_ratio", F.coalesce(F.try_divide("duplicates_found", "total_processed"), F.lit(0.0)))


def index_statistics(flagged: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """`statistics` with cache_hits (rows whose hash was in the index before) and unique_hashes (hashes of the rows and the index)."""
    old = seen.select(F.col("hash").alias("__seen")).distinct() if seen is not None else None
    rows = flagged.groupBy("hash").agg(F.count("hash").alias("n"), F.count_if("duplicate").alias("dup")).where("n > 0")
    joined = rows.join(old, F.col("hash") == F.col("__seen"), "full") if old is not None else rows.withColumn("__seen", F.lit(None).cast("string"))
    known = F.col("__seen").isNotNull()
    # Of a hash that the index knows, all rows are duplicates; else all but the first.
    dup = F.when(known, F.coalesce("n", F.lit(0))).otherwise(F.col("dup"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    out = joined.agg(total("n").alias("total_processed"), (total("n") - total(dup)).alias("unique_content"), total(dup).alias("duplicates_found"), total(F.when(known, F.coalesce("n", F.lit(0)))).alias("cache_hits"), F.count("*").alias("unique_hashes"))
    return out.withColumn("dedup_ratio", F.coalesce(F.try_divide("duplicates_found", "total_processed"), F.lit(0.0)))


def summary(df: DataFrame, order: list[str], *by: str, hash_column: str = "hash") -> DataFrame:
    """What `statistics` gives for flagged rows, without flagging them.

    Rows are counted by hash and group before they are shuffled, so a hash that a third of all rows share
    arrives as a few rows; of a hash's groups, the one with its first row has its unique text.
    """
    key = F.coalesce(F.col(hash_column), F.lit(""))
    counted = df.groupBy(key.alias("__hash"), *by).agg(F.count(hash_column).alias("n"), F.min(F.struct(*order)).alias("first"))
    first = F.min("first").over(Window.partitionBy("__hash"))
    placed = counted.withColumn("new", ((F.col("first") == first) & (F.col("n") > 0)).cast("bigint"))
    total, new = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("new"), F.lit(0))
    out = placed.groupBy(*by).agg(total.alias("total_processed"), new.alias("unique_content"), (total - new).alias("duplicates_found"))
    out = out.where("total_processed > 0") if by else out
    return out.withColumn("dedup_ratio", F.coalesce(F.try_divide("duplicates_found", "total_processed"), F.lit(0.0)))
