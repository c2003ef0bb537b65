"""Checks of normalised records, and fidelity of a normalised text to its original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.errors import ValidationError
from loomtext.functions import rx
from loomtext.functions.text import jaccard

#: Fields and domains of the record formats.
OUTPUT_FIELDS = ("content", "provider", "model", "usage", "finish_reason", "timestamp")
INPUT_FIELDS = ("content", "type", "token_estimate", "direction")
USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")
PROVIDERS = ("openai", "anthropic", "ollama", "generic")
PROMPT_TYPES = ("code", "conversation", "instruction", "example", "system")
GRANULARITIES = ("sentence", "paragraph")


def check(name: str, passed: Column, severity: str) -> Column:
    """One result: a passed check is information, a failed one has its severity."""
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(F.lit(name).alias("name"), ok.alias("passed"), F.when(ok, F.lit("info")).otherwise(F.lit(severity)).alias("severity"))


def missing(keys: Column, required: tuple[str, ...]) -> Column:
    """Required fields that aren't among the keys."""
    return F.array_except(F.array(*(F.lit(x) for x in required)), F.coalesce(keys, F.expr("cast(array() as array<string>)")))


def _keys(json: Column, path: str | None = None) -> Column:
    return F.json_object_keys(F.get_json_object(json, f"$.{path}") if path else json)


def is_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text).isNotNull()


def validate_output(json: Column) -> Column:
    """Checks of a normalised response (a JSON record): array of (name, passed, severity)."""
    at = lambda x: F.get_json_object(json, f"$.{x}")
    content = F.coalesce(F.when(at("content") != "", at("content")), at("normalized_content"), at("content"))
    counts = F.lit(True)
    for x in USAGE_FIELDS:
        value = at(f"usage.{x}")
        counts = counts & (value.isNull() | (F.coalesce(value.try_cast("bigint"), F.lit(-1)) >= 0))
    return F.array(
        check("structure", _keys(json).isNotNull(), "error"),
        check("required_fields", F.size(missing(_keys(json), OUTPUT_FIELDS)) == 0, "error"),
        check("usage", _keys(json, "usage").isNotNull() & (F.size(missing(_keys(json, "usage"), USAGE_FIELDS)) == 0), "error"),
        check("content", content.isNotNull(), "error"),
        check("provider", at("provider").isin(*PROVIDERS), "warning"),
        check("timestamp", (at("timestamp") != "") & is_timestamp(at("timestamp")), "warning"),
        check("token_counts", counts, "error"),
    )


def validate_input(json: Column) -> Column:
    """Checks of a normalised prompt (a JSON record)."""
    at = lambda x: F.get_json_object(json, f"$.{x}")
    kind = F.coalesce(at("type"), F.lit(""))
    prompt_type = F.struct(F.lit("prompt_type").alias("name"), kind.isin(*PROMPT_TYPES).alias("passed"), F.when(kind == "", F.lit("error")).when(kind.isin(*PROMPT_TYPES), F.lit("info")).otherwise(F.lit("warning")).alias("severity"))
    return F.array(
        check("structure", _keys(json).isNotNull(), "error"),
        check("required_fields", F.size(missing(_keys(json), INPUT_FIELDS)) == 0, "error"),
        check("content", at("content").isNotNull(), "error"),
        prompt_type,
        check("token_estimate", F.coalesce(at("token_estimate").try_cast("bigint"), F.lit(-1)) >= 0, "error"),
    )


def schema_errors(json: Column) -> Column:
    """Violations of the response schema: array of (field, error)."""
    at = lambda x: F.get_json_object(json, f"$.{x}")
    rules = [
        ("content", at("content").isNull(), "missing"),
        ("provider", ~F.coalesce(at("provider").isin(*PROVIDERS), F.lit(False)), "not a known provider"),
        ("model", F.coalesce(at("model"), F.lit("")) == "", "empty"),
        *((f"usage.{x}", F.coalesce(at(f"usage.{x}").try_cast("bigint"), F.lit(0)) < 0, "negative") for x in USAGE_FIELDS),
        ("timestamp", at("timestamp").isNotNull() & ~is_timestamp(at("timestamp")), "not ISO-8601"),
    ]
    found = F.array(*(F.when(test, F.struct(F.lit(name).alias("field"), F.lit(error).alias("error"))) for name, test, error in rules))
    return F.filter(found, lambda x: x.isNotNull())


def check_threshold(value: float, name: str = "threshold") -> float:
    """The value, if it is from 0 to 1."""
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value <= 1:
        raise ValidationError(f"{name} must be from 0 to 1: {value!r}")
    return float(value)


def text_content(text: Column, least: int = 1, most: int | None = None) -> Column:
    """Whether a text is there and its length is from `least` to `most`."""
    fits = F.length(text) >= least
    return F.coalesce(fits if most is None else fits & (F.length(text) <= most), F.lit(False))


def corrected_total(prompt: Column, completion: Column, total: Column) -> Column:
    """The total that the parts give, unless the total is 0."""
    return F.when(total == 0, total).otherwise(prompt + completion)


def coerced_usage(usage: Column) -> Column:
    """Counts of usage, with the total that the parts give unless it is 0; a missing count is 0."""
    at = lambda x: F.coalesce(usage[x].cast("bigint"), F.lit(0).cast("bigint"))
    prompt, completion, total = (at(x) for x in USAGE_FIELDS)
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), corrected_total(prompt, completion, total).alias("total_tokens"))


def coerced_segment(segment: Column) -> Column:
    """A prompt's segment with the length that its content has."""
    return segment.withField("length", F.length(F.coalesce(segment["content"], F.lit(""))))


INPUT_RECORD = "content string, type string, token_estimate bigint, direction string, timestamp string, segments array<struct<id:string,content:string,type:string,length:int,token_estimate:bigint>>"
OUTPUT_RECORD = "content string, provider string, model string, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>, finish_reason string, timestamp string"


def _errors(*rules: tuple[str, Column, str]) -> Column:
    found = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(error).alias("error"))) for name, test, error in rules))
    return F.filter(found, lambda x: x.isNotNull())


def input_errors(json: Column) -> Column:
    """Violations of the prompt schema: array of (field, error)."""
    read = F.from_json(json, INPUT_RECORD)
    tokens = F.get_json_object(json, "$.token_estimate")
    return _errors(
        ("record", F.json_object_keys(json).isNull(), "not an object"),
        ("content", F.get_json_object(json, "$.content").isNull(), "missing"), ("content", read["content"] == "", "empty"),
        ("type", ~F.coalesce(read["type"].isin(*PROMPT_TYPES), F.lit(False)), "not a known type"),
        ("token_estimate", F.coalesce(tokens.try_cast("bigint"), F.lit(-1)) < 0, "not a count"),
        ("timestamp", read["timestamp"].isNotNull() & ~is_timestamp(read["timestamp"]), "not ISO-8601"),
        ("segments", F.get_json_object(json, "$.segments").isNotNull() & (F.size(F.coalesce(read["segments"], F.array())) == 0), "empty"),
        ("segments", F.exists(F.coalesce(read["segments"], F.array()), lambda s: F.coalesce(s["content"], F.lit("")) == ""), "a segment without content"),
    )


def safe_validate(json: Column, kind: str) -> Column:
    """valid, the record coerced (lengths, totals), errors: of an `input` or `output` record; a record with errors is null."""
    if kind == "input":
        errors, read = input_errors(json), F.from_json(json, INPUT_RECORD)
        record = read.withField("segments", F.transform(read["segments"], coerced_segment))
    elif kind == "output":
        errors, read = schema_errors(json), F.from_json(json, OUTPUT_RECORD)
        record = read.withField("usage", F.when(read["usage"].isNotNull(), coerced_usage(read["usage"])))
    else:
        raise ValidationError(f"records are input or output: {kind}")
    return F.struct((F.size(errors) == 0).alias("valid"), F.when(F.size(errors) == 0, record).alias("record"), errors.alias("errors"))


def terms(text: Column) -> Column:
    return F.array_distinct(rx.all_of(F.lower(text), r"\b[a-zA-Z0-9]{4,}\b"))


def semantic_preserved(original: Column, normalized: Column) -> Column:
    """At least 70 % of the original's terms are kept and the length ratio is 0.2 to 2; no terms: yes; an empty side: no."""
    before = terms(original)
    kept = F.try_divide(F.size(F.array_intersect(before, terms(normalized))), F.size(before))
    ratio = F.try_divide(F.length(normalized), F.length(original))
    empty = (F.coalesce(original, F.lit("")) == "") | (F.coalesce(normalized, F.lit("")) == "")
    return F.when(empty, F.lit(False)).when(F.size(before) == 0, F.lit(True)).otherwise((kept >= 0.7) & ratio.between(0.2, 2.0))


def structure_preserved(original: Column, normalized: Column) -> Column:
    """Fences and headings differ by one at most."""
    fences = lambda x: F.floor((F.length(x) - F.length(F.replace(x, F.lit("```"), F.lit("")))) / 3)
    headings = lambda x: rx.count(x, r"^#{1,6}\s", "m")
    return (F.abs(fences(original) - fences(normalized)) <= 1) & (F.abs(headings(original) - headings(normalized)) <= 1)


def fidelity_score(original: Column, normalized: Column, semantic: Column, structure: Column) -> Column:
    ratio = F.try_divide(F.length(normalized), F.length(original))
    part = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    length = F.when(ratio.between(0.5, 1.5) & (normalized != ""), F.lit(0.1)).when(ratio.between(0.2, 2.0) & (normalized != ""), F.lit(0.05)).otherwise(F.lit(0.0))
    return F.least(part(normalized != "", 0.3) + part(semantic, 0.4) + part(structure, 0.2) + length, F.lit(1.0))


def fidelity_report(original: Column, normalized: Column) -> Column:
    semantic, structure = semantic_preserved(original, normalized), structure_preserved(original, normalized)
    return F.struct(
        F.length(original).alias("original_length"), F.length(normalized).alias("normalized_length"), (normalized != "").alias("content_preserved"), semantic.alias("semantic_preserved"), structure.alias("structure_preserved"),
        fidelity_score(original, normalized, semantic, structure).alias("fidelity_score"),
    )


def round_trip(original: Column, restored: Column, least: float = 0.95) -> Column:
    """exact, similarity and whether the text survived: equal, or alike in more than `least` of its words."""
    alike = jaccard(original, restored)
    exact = original == restored
    return F.struct(exact.alias("exact"), alike.alias("similarity"), (exact | (alike > least)).alias("passed"))
