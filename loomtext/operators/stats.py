"""Statistics over segments and texts: run counts, dedup rates by granularity, cost and storage models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import rx
from loomtext.functions.text import hash_chunk
from loomtext.operators.segment import paragraph_texts, sentence_texts

#: Dollars for a thousand tokens, and answer tokens for each item.
INPUT_PRICE, OUTPUT_PRICE, EMBEDDING_PRICE, ANSWER = 0.03, 0.06, 0.0001, 100


def run_statistics(segments: DataFrame) -> DataFrame:
    """Segments by type and content type, characters and duplicates. segments: type, content_type, text, duplicate."""
    kinds = ("sentence", "paragraph", "code_block", "list_item", "heading")
    contents = ("prose", "code", "structured_data", "mixed", "unknown")
    return segments.agg(
        F.count("*").alias("total_segments"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_characters"), F.count_if("duplicate").alias("duplicates_found"),
        *(F.count_if(F.col("type") == x).alias(f"{x}s") for x in kinds), *(F.count_if((F.col("content_type") == x) & ~F.col("duplicate")).alias(f"content_{x}") for x in contents),
    )


def input_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count("*").alias("files_processed"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_characters"), F.coalesce(F.sum(F.size(rx.split_lines(F.col(text)))), F.lit(0)).alias("total_lines"))


def pieces(docs: DataFrame, granularity: str, text: str = "text") -> DataFrame:
    """line, segment (sentence) or block (paragraph) texts of the documents, blank ones left out."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts: dict[str, Column] = {
        "line": F.transform(rx.lines(body), rx.strip),
        "segment": sentence_texts(body),
        "block": paragraph_texts(body),
    }
    return docs.select(F.explode_outer(parts[granularity]).alias("piece")).where("piece <> ''")


def dedup_rates(docs: DataFrame, text: str = "text") -> DataFrame:
    """granularity, total, unique and rate of repeated pieces."""
    out = None
    for granularity in ("line", "segment", "block"):
        # Counted by hash first, so that no task counts distinct values alone.
        hashes = pieces(docs, granularity, text).groupBy(hash_chunk(F.col("piece"), "md5").alias("h")).agg(F.count("*").alias("n"))
        row = hashes.agg(F.lit(granularity).alias("granularity"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("dedup_rate", F.coalesce(F.try_divide(F.col("total") - F.col("unique"), "total"), F.lit(0.0)))


def token_cost(items: DataFrame) -> DataFrame:
    """Cost before and after dedup. items: token_estimate, duplicate."""
    kept = ~F.col("duplicate")
    out = items.agg(F.count("*").alias("items"), F.count_if(kept).alias("unique_items"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(kept, F.col("token_estimate"))), F.lit(0)).alias("unique_tokens"))
    cost = lambda tokens, n: F.col(tokens) / 1000 * INPUT_PRICE + F.col(n) * ANSWER / 1000 * OUTPUT_PRICE
    out = out.withColumns({"cost": cost("tokens", "items"), "unique_cost": cost("unique_tokens", "unique_items")})
    return out.withColumn("saved_share", F.coalesce(1 - F.try_divide("unique_cost", "cost"), F.lit(0.0)))


def embedding_cost(items: DataFrame) -> DataFrame:
    kept = F.when(~F.col("duplicate"), F.col("token_estimate"))
    out = items.agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(kept), F.lit(0)).alias("unique_tokens"))
    return out.withColumns({"cost": F.col("tokens") / 1000 * EMBEDDING_PRICE, "unique_cost": F.col("unique_tokens") / 1000 * EMBEDDING_PRICE})


def storage_overhead(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Bytes of texts alone and of the rows as JSON."""
    json = F.to_json(F.struct(*rows.columns))
    out = rows.groupBy(*by).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("text_bytes"), F.coalesce(F.sum(F.octet_length(json)), F.lit(0)).alias("json_bytes"))
    return out.withColumn("overhead", F.coalesce(F.try_divide(F.col("json_bytes") - F.col("text_bytes"), F.col("text_bytes")), F.lit(0.0)))


def validation_summary(checked: DataFrame, checks: str = "checks", *by: str) -> DataFrame:
    """Passed, failed errors and warnings of arrays of check results."""
    count = lambda test: F.size(F.filter(checks, test))
    failed = lambda s: count(lambda c: (c["severity"] == s) & ~c["passed"])
    # Counted in each row's array, so that nothing is exploded.
    rows = checked.select(*by, F.size(checks).alias("total"), count(lambda c: c["passed"]).alias("passed"), failed("error").alias("errors"), failed("warning").alias("warnings"))
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "passed", "errors", "warnings")))
