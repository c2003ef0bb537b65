"""From files to classified, deduplicated segments; and the facades over prompts and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import ValidationError
from loomtext.functions import classify as C
from loomtext.functions import jsonx
from loomtext.functions import text as T
from loomtext.functions import validate as V
from loomtext.operators import dedup, prompts, responses, segment, stats
from loomtext.sources import files


def process_texts(docs: DataFrame, key: str, granularity: str = "sentence", classify: bool = True, remove: bool = True, index: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """Segments of `docs` (key, text), without duplicates and with their content types.

    Duplicates go before anything is classified, so the costly features see survivors only.
    """
    V.check_threshold(threshold, "the least confidence")
    found = segment.segment(docs.select(key, "text"), granularity)
    if remove:
        found = dedup.hashed(found)
        if index is not None:
            found = found.where("hash is null").unionByName(dedup.unseen(found.where("hash is not null"), index))
        found = dedup.survivors(found, [key, "seg_idx"])
    found = found.withColumn("length", F.length("text"))
    if not classify:
        return found
    out = C.classify(found, threshold=threshold)
    kept = [*found.columns, F.struct("content_type", F.round("confidence", 3).alias("confidence")).alias("classification")]
    return out.select(*kept)


def _settle(spark: SparkSession, cache: str) -> None:
    """Put a complete next index in the place of one that is gone: also what a run that broke off between the two steps left."""
    fs, at = files._fs(spark, cache)
    if not fs.exists(at) and fs.exists(files._fs(spark, f"{cache}.next/_SUCCESS")[1]):
        fs.rename(files._fs(spark, f"{cache}.next")[1], at)


def process_file(spark: SparkSession, source: str, target: str, granularity: str = "sentence", classify: bool = True, remove: bool = True, cache: str | None = None, statistics: str | None = None) -> DataFrame:
    """Read files, write their segments as JSON lines, keep the index for later runs; the written segments."""
    files.check_readable(spark, source)
    if cache:
        _settle(spark, cache)
    docs = files.read_texts(spark, source)
    known = None
    if cache and files._fs(spark, cache)[0].exists(files._fs(spark, cache)[1]):
        known = dedup.load_index(spark, cache)
    out = process_texts(docs, "file", granularity, classify, remove, known)
    files.write_jsonl(out, target)
    written = spark.read.schema(out.schema).json(target)
    if cache and remove:
        new = dedup.index(written, ["file", "seg_idx"])
        merged = dedup.merge_index(known, new) if known is not None else new
        # Written beside the old index and then moved, as the old one is being read.
        dedup.save_index(merged, f"{cache}.next")
        fs, at = files._fs(spark, cache)
        fs.delete(at, True)
        _settle(spark, cache)
    if statistics:
        files.write_statistics(stats.input_statistics(docs).withColumn("segments_written", F.lit(written.count())), statistics, "txt" if statistics.endswith(".txt") else "json")
    return written


def process_prompts(spark: SparkSession, source: str, kind: str | None = None, most: int = 2048, overlap: int = 200) -> DataFrame:
    """Segments of the prompts in a file."""
    return prompts.process(prompts.with_ids(files.read_prompts(spark, source, kind), ["ord"]), ["ord"], most=most, overlap=overlap)


def normalize_inputs(df: DataFrame, order: list[str], provider: str | None = None) -> DataFrame:
    """One row per prompt (id, content): the rollup of its segments."""
    rolled = prompts.rollup(prompts.process(df, order))
    return prompts.for_provider(rolled, provider) if provider else rolled


def normalize_outputs(df: DataFrame, raw: str = "raw", provider: str | None = None) -> DataFrame:
    """Payloads or texts of responses in one schema, with their direction."""
    return responses.normalize_payloads(df, raw, provider).withColumn("direction", F.lit("output"))


def normalize_full(df: DataFrame, raw: str = "raw", kind: str = "output", provider: str | None = None, strict: bool = False) -> DataFrame:
    """df with its records normalised and checked: `record` (JSON), `valid`, `errors`; one evaluation, as the work is deterministic.

    kind output: payloads of any provider, other JSON or text in one schema; input: prompts with type and tokens. A record
    with errors fails the job if strict, else it is kept as it came, with the errors.
    """
    raw_text = F.coalesce(F.col(raw), F.lit(""))
    if kind == "output":
        done = responses.normalize_payloads(df.withColumn("__raw", raw_text), "__raw", provider)
        found = F.col("response")
        usage = V.coerced_usage(found)
        record = F.struct(F.col("content").alias("content"), found["provider"].alias("provider"), found["model"].alias("model"), usage.alias("usage"), found["finish_reason"].alias("finish_reason"), F.lit("output").alias("direction"))
        done = done.withColumn("__record", F.to_json(record)).withColumn("__checked", V.safe_validate(F.col("__record"), "output")).drop("content", "content_metadata", "hash", "response", "__raw")
    elif kind == "input":
        done = df.withColumn("__text", T.normalize_prompt(raw_text))
        record = F.struct(F.col("__text").alias("content"), T.prompt_type(F.col("__text")).alias("type"), T.token_estimate(F.col("__text")).cast("bigint").alias("token_estimate"), F.lit("input").alias("direction"))
        done = done.withColumn("__record", F.to_json(record)).withColumn("__checked", V.safe_validate(F.col("__record"), "input")).drop("__text")
    else:
        raise ValidationError(f"records are input or output: {kind}")
    valid = F.col("__checked.valid")
    kept = F.raise_error(F.concat(F.lit("not a valid record: "), F.substring(raw_text, 1, 100))) if strict else F.to_json(F.struct(F.col(raw).alias("_raw"), F.lit("kept as it came").alias("_note")))
    return done.select(*df.columns, F.when(valid, F.col("__record")).otherwise(kept).alias("record"), valid.alias("valid"), F.col("__checked.errors").alias("errors"))


def normalize_any(df: DataFrame, raw: str = "raw", retries: int = 3, strict: bool = False) -> DataFrame:
    """df with the repaired canonical JSON of `raw` and its direction."""
    return df.withColumn("json", jsonx.normalize_json(F.col(raw), retries, strict)).withColumn("direction", jsonx.direction(F.col("json")))
