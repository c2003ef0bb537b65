"""Responses: cleaning, provider payloads, pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import text as T
from loomtext.functions.classify import strict_json
from loomtext.functions.providers import PROVIDERS, parse
from loomtext.functions.validate import check_threshold


def clean(text: Column, model: Column | None = None, thinking: bool = True, artifacts: bool = True, quirks: bool = True, fences: bool = True) -> Column:
    if thinking:
        text = T.remove_thinking(text)
    if artifacts:
        text = T.remove_artifacts(text)
    if model is not None and quirks:
        text = T.remove_quirks(text, model)
    text = T.normalize_whitespace(text)
    return T.normalize_fences(text) if fences else text


def normalize(df: DataFrame, text: str = "response", model: str | None = "model", **flags: bool) -> DataFrame:
    """df with normalized_content, lengths, reduction_ratio, token_estimate, metadata and hash."""
    out = df.withColumn("normalized_content", clean(F.col(text), F.col(model) if model else None, **flags))
    new = F.col("normalized_content")
    return out.withColumns({
        "original_length": F.length(text), "normalized_length": F.length(new), "reduction_ratio": T.reduction_ratio(F.col(text), new),
        "token_estimate": T.token_estimate(new), "metadata": T.content_metadata(new), "hash": T.hash_chunk(new),
    })


def normalize_payloads(df: DataFrame, raw: str = "raw", provider: str | None = None) -> DataFrame:
    """df with the unified response of each payload; its content is cleaned, and text that isn't JSON is its own content."""
    known = F.col(provider) if provider else None
    wrapped = F.when(strict_json(F.col(raw)), F.col(raw)).otherwise(F.to_json(F.struct(F.col(raw).alias("content"))))
    out = df.withColumn("__payload", wrapped).withColumn("response", parse(F.col("__payload"), known)).drop("__payload")
    content = F.col("response.content")
    out = out.withColumn("content", F.when(content == "", content).otherwise(clean(content, F.col("response.model"))))
    return out.withColumns({"content_metadata": T.content_metadata(F.col("content")), "hash": T.hash_chunk(F.col("content"))})


def with_provider_config(df: DataFrame, configs: DataFrame, provider: str = "provider") -> DataFrame:
    """Configurations joined by name. configs has a row per provider: a few, so it is broadcast."""
    if configs.count() > 1000:
        raise ValueError("provider configurations are a short list")
    return df.join(F.broadcast(configs), provider, "left")


def pairs(df: DataFrame, group: str, order: str, content: str = "normalized_content", threshold: float = 0.8) -> DataFrame:
    """Similarity of each two responses within a group: group, i, j, similarity, similar.

    Word sets are made once per response, before the join.
    """
    words = df.select(F.col(group).alias("g"), F.col(order).alias("o"), T.word_set(F.col(content)).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    both = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.o") < F.col("b.o")))
    shared = F.size(F.array_intersect("a.w", "b.w"))
    empty = (F.size("a.w") == 0) | (F.size("b.w") == 0)
    alike = F.when(empty, F.lit(0.0)).otherwise(shared / (F.size("a.w") + F.size("b.w") - shared))
    return both.select(F.col("a.g").alias(group), F.col("a.o").alias("i"), F.col("b.o").alias("j"), alike.alias("similarity")).withColumn("similar", F.col("similarity") >= threshold)


def compare(df: DataFrame, group: str, order: str, threshold: float = 0.8) -> DataFrame:
    """One summary row per group of normalised responses; a response repeats if an earlier one has its hash."""
    alike = pairs(df, group, order, threshold=threshold).groupBy(group).agg(F.avg("similarity").alias("average_similarity"))
    flagged = df.withColumn("__again", F.row_number().over(Window.partitionBy(group, "hash").orderBy(order)) > 1)
    out = flagged.groupBy(group).agg(
        F.count("*").alias("total_responses"), F.count_if(~F.col("__again")).alias("unique_responses"), F.count_if("__again").alias("duplicate_responses"),
        F.array_sort(F.collect_set("provider")).alias("providers"), F.array_sort(F.collect_set("model")).alias("models"),
        *(f(x).alias(f"{name}_{x}") for x in ("normalized_length", "token_estimate") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))),
    )
    return out.join(alike, group, "left").withColumn("average_similarity", F.coalesce("average_similarity", F.lit(0.0)))


def normalize_ollama(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Payloads of Ollama in the unified schema, with what else they say of the run in `ollama_metadata`."""
    out = normalize_payloads(df.withColumn("__provider", F.lit("ollama")), raw, "__provider").drop("__provider")
    at = lambda x, kind: F.get_json_object(raw, f"$.{x}").try_cast(kind).alias(x)
    times = ("total_duration", "load_duration", "prompt_eval_count", "prompt_eval_duration", "eval_count", "eval_duration")
    return out.withColumn("ollama_metadata", F.struct(at("model", "string"), at("created_at", "string"), at("done", "boolean"), *(at(x, "bigint") for x in times), F.from_json(F.get_json_object(raw, "$.context"), "array<bigint>").alias("context")))


def compare_all(df: DataFrame, order: str, threshold: float = 0.8) -> DataFrame:
    """One summary row of all rows, or a row whose `error` says that there are none."""
    check_threshold(threshold)
    whole = compare(df.withColumn("__all", F.lit(1)), "__all", order, threshold).drop("__all").withColumn("error", F.lit(None).cast("string"))
    some = df.limit(1).agg((F.count("*") == 0).alias("none"))
    lone = some.where("none").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema if f.name != "error"), F.lit("no responses to compare").alias("error"))
    return whole.unionByName(lone)


def is_provider(name: Column) -> Column:
    return F.coalesce(name.isin(*PROVIDERS), F.lit(False))
