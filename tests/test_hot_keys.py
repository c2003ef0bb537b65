"""Ids and flags at sizes where samples and hot keys count."""

from pyspark.sql import functions as F

from loomtext.operators import dedup, prompts


def test_ids_of_a_million_rows(spark, tmp_path):
    """More rows than a range shuffle samples: every number once, in order."""
    path = f"file://{tmp_path}/rows"
    spark.range(0, 1_000_000, 1, 16).select(((F.col("id") * 7919) % 1_000_003).alias("a"), F.lit(None).cast("string").alias("id")).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = prompts.with_ids(spark.read.parquet(path), ["a"]).select("a", F.substring("id", 8, 20).cast("bigint").alias("n"))
        row = found.agg(F.count("*").alias("rows"), F.countDistinct("n").alias("ids"), F.max("n").alias("last")).first()
        assert tuple(row) == (1_000_000, 1_000_000, 999_999)
        assert [r.n for r in found.orderBy("a").limit(1000).collect()] == list(range(1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_hash_and_rows_without_one(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise((F.col("id") % 500).cast("string")).alias("hash"))
    found = dedup.flag(rows, ["id"])
    seen, expected = set(), {}
    for r in sorted(rows.collect()):
        expected[r.id] = r.hash is not None and r.hash in seen
        seen.add(r.hash)
    assert {r.id: r.duplicate for r in found.collect()} == expected
    assert sorted(r.id for r in dedup.survivors(rows, ["id"]).collect()) == sorted(k for k, x in expected.items() if not x)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hash" not in plan  # rows don't meet by their hash


def test_ties_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (2, None), (3, "b")], "k int, hash string")
    flags = sorted((repr(r.k), repr(r.hash), r.duplicate) for r in dedup.flag(rows, ["k"]).collect())
    # A null key is before all others.
    assert flags == sorted([("1", "'a'", True), ("1", "'a'", True), ("None", "'a'", False), ("None", "'b'", False), ("None", "'b'", True), ("2", "None", False), ("2", "None", False), ("3", "'b'", True)])
    assert dedup.survivors(rows, ["k"]).count() == 5
    assert dedup.flag(rows.where("1 = 0"), ["k"]).count() == 0
