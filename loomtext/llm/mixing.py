"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Each document draws a key -ln(u) / weight: u is a uniform number from its id, the weight its
quality. Ascending keys are a weighted sample without replacement. A source whose target exceeds
its size first gives complete epochs of all its documents; the fraction that is left goes to its
documents in the order of their keys while their prefix sum stays within the budget; what is then
left goes to the one later document whose size comes nearest, if that brings the sum closer.

No source is sorted whole. Keys fall into buckets that ascend with the key, about GROUP documents
each; sums by bucket place the budget's end in one bucket, and only that bucket is sorted. So the
outcome for a source is a cut in the order of keys, and each document compares itself with it.

Defined results: null text has size 0; a null source is a source, the last; null doc_ids share one
key; rows of one source equal in doc_id and size are taken together; documents of size 0 are never
taken; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|=<>{}\[\]\\^~+_@]+"
WEIGHTS = (3, 1, 2)
GROUP = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: Column, size: Column) -> Column:
    """From 1 down to 1/2: the more runs of symbols a text has for its words, the lower."""
    runs = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.least(F.lit(1.0), runs / F.greatest(size, F.lit(1)).cast("double")))


def key_of(doc_id: Column, weight: Column, seed: int) -> Column:
    """An exponential key: 52 bits of a digest of the id make u in (0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / weight


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with `target`: by weight, at most `most` times the size, the excess reshared.

    Sources in ascending order of (cap / weight): while a source's cap is below its share of what the
    earlier ones leave, it is full. The share per unit of weight that the rest gets is the largest
    of all those shares.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in WEIGHTS)), (place - 1) % len(WEIGHTS) + 1)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    found = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most).withColumn("total", total)
    found = found.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return found.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def keyed(docs: DataFrame, seed: int, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, key of each document."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).withColumn("size", size_of(F.col("text")))
    return sized.select("doc_id", "source", "size", key_of(F.col("doc_id"), quality_of(F.col("text"), F.col("size")), seed).alias("key"))


def _id(column: str) -> Column:
    """Ids in a form that compares nulls: null is the smallest."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def plan(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs, and which documents the fraction holds.

    Those at or before (cut_key, cut_id, cut_size), and the one of (more_key, more_id, more_size).
    rows: source, key, doc_id, size and `n`, the number of equal rows.
    """
    rows = rows.withColumn("total", F.col("size") * F.col("n")).withColumn("__id", _id("doc_id"))
    sources = rows.groupBy("source").agg(F.sum("total").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(sources.select("source", "source_size")).withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    goal = sources.select("source", "rows").join(goal, same).drop("__source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = goal.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal.withColumn("groups", F.ceil(F.col("rows") / F.lit(GROUP))).drop("rows"), "mix-goal")
    named = goal.select(F.col("source").alias("__source"), "budget", "groups")

    group = F.floor(F.col("groups") * (F.lit(1.0) - F.exp(-F.col("key"))))
    rows = rows.where("size > 0").join(named, same).drop("__source").withColumn("group", group)
    upto = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("source", "group").agg(F.sum("total").alias("sum"), F.first("budget").alias("budget")).withColumn("upto", F.sum("sum").over(upto))
    # The first bucket that the budget doesn't cover holds the cut.
    ends = sums.where("upto > budget").groupBy(F.col("source").alias("__source")).agg(F.min(F.struct("group", (F.col("upto") - F.col("sum")).alias("before"))).alias("end"))
    placed = rows.join(ends, same).drop("__source")
    last = placed.where(F.col("group") == F.col("end.group"))
    order = Window.partitionBy("source").orderBy("key", "__id", "size")
    last = last.withColumn("upto", F.col("end.before") + F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.struct("key", "__id", "size")
    # cut: the last document within the budget, else the end of the bucket before.
    cuts = last.groupBy(F.col("source").alias("__source")).agg(
        F.max(F.when(F.col("upto") <= F.col("budget"), place)).alias("cut"),
        F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("within"),
        F.first("end.group").alias("cut_group"), F.first("end.before").alias("before"),
    )
    cuts = cuts.select("__source", "cut", "cut_group", F.coalesce("within", "before").alias("sum"))
    rest = rows.join(cuts, same).where((F.col("group") > F.col("cut_group")) | (F.col("group") == F.col("cut_group")) & (F.col("cut").isNull() | (place > F.col("cut"))))
    gap = F.col("budget") - F.col("sum")
    near = F.struct(F.abs(F.col("total") - gap).alias("off"), "key", "__id", "size")
    more = rest.where(F.abs(F.col("total") - gap) < gap).groupBy(F.col("source").alias("__more_source")).agg(F.min(near).alias("more"))
    out = goal.join(cuts, same, "left").join(more, F.col("source").eqNullSafe(F.col("__more_source")), "left")
    ends = [F.col(f"{a}.{b}").alias(f"{a}_{c}") for a in ("cut", "more") for b, c in (("key", "key"), ("__id", "id"), ("size", "size"))]
    # As a table its size is known: a small one is broadcast to the documents, a large one joined by a shuffle.
    return materialize(out.select(*goal.columns, "cut_group", *ends), "mix-plan")


def taken(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows (with source, key, doc_id, size) with source_size, target, epochs, chosen and copies."""
    planned = plans.select(F.col("source").alias("__source"), *(F.col(x).alias(f"__{x}") for x in plans.columns if x != "source"))
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("__source")))
    own = F.struct(F.col("key"), _id("doc_id"), F.col("size"))
    group = F.floor(F.col("__groups") * (F.lit(1.0) - F.exp(-F.col("key"))))
    cut = F.struct("__cut_key", "__cut_id", "__cut_size")
    within = F.coalesce(group < F.col("__cut_group"), F.lit(False)) | F.coalesce((group == F.col("__cut_group")) & F.col("__cut_key").isNotNull() & (own <= cut), F.lit(False))
    more = F.coalesce((F.col("key") == F.col("__more_key")) & (_id("doc_id") == F.col("__more_id")) & (F.col("size") == F.col("__more_size")), F.lit(False))
    chosen = (F.col("size") > 0) & (within | more)
    copies = F.when(F.col("size") > 0, F.col("__epochs") + chosen.cast("bigint")).otherwise(0)
    return joined.withColumn("source_size", F.col("__source_size")).withColumn("target", F.col("__target")).withColumn("epochs", F.col("__epochs")).withColumn("chosen", chosen).withColumn("copies", copies).drop("__source", *(f"__{x}" for x in plans.columns))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, source, epochs, chosen."""
    grouped = keyed(docs, seed).groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    rows = materialize(grouped, "mix-rows")
    out = taken(rows, plan(rows)).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "epochs", "chosen")


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, in docs' columns."""
    names = docs.columns
    rows = materialize(keyed(docs, seed).groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")), "mix-rows")
    whole = docs.select(F.struct(*names).alias("__row"), "doc_id", "source", "text")
    sized = whole.withColumn("size", size_of(F.col("text")))
    again = sized.select("__row", "doc_id", "source", "size", key_of(F.col("doc_id"), quality_of(F.col("text"), F.col("size")), seed).alias("key"))
    out = taken(again, plan(rows)).where("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


#: The same mix in DuckDB.
SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#$%&*|=<>{}\[\]\\^~+_@]+'))::DOUBLE AS runs FROM documents),
keyed AS (SELECT doc_id, source, size, coalesce(doc_id::VARCHAR, '') AS id,
    -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (1.0 / (1.0 + least(1.0, runs / greatest(size, 1)::DOUBLE))) AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1) AS weight,
    source_size::DOUBLE * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM sources),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goals AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goals),
budget AS (SELECT *, target - epochs * source_size AS budget FROM goal),
prefix AS (SELECT k.*, b.source_size, b.target, b.epochs, b.budget,
    sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY k.source ORDER BY key, id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source),
gaps AS (SELECT source, any_value(budget) - coalesce(max(upto) FILTER (upto <= budget), 0) AS gap FROM prefix GROUP BY source),
near AS (SELECT p.source, p.key, p.id, p.size, g.gap, sum(p.size) AS total FROM prefix p JOIN gaps g ON p.source IS NOT DISTINCT FROM g.source
    WHERE p.upto > p.budget AND p.size > 0 GROUP BY ALL),
more AS (SELECT source, arg_min({'key': key, 'id': id, 'size': size}, {'off': abs(total - gap), 'key': key, 'id': id, 'size': size}) AS m
    FROM near WHERE abs(total - gap) < gap GROUP BY source)
SELECT p.doc_id, p.size, p.source_size, p.target,
    CASE WHEN p.size > 0 THEN p.size * (p.epochs + ((p.upto <= p.budget OR coalesce(m.m.key = p.key AND m.m.id = p.id AND m.m.size = p.size, FALSE)))::BIGINT) ELSE 0 END::BIGINT AS taken,
    p.source, p.epochs, p.size > 0 AND (p.upto <= p.budget OR coalesce(m.m.key = p.key AND m.m.id = p.id AND m.m.size = p.size, FALSE)) AS chosen
FROM prefix p LEFT JOIN more m ON p.source IS NOT DISTINCT FROM m.source
"""
