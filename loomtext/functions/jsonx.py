"""JSON in text: extraction, repair, canonical form, direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import rx
from loomtext.functions.classify import strict_json

#: An object or array with at most one more level inside.
BLOCK = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"
#: Fixed value: a string in single quotes where JSON could have one.
SINGLE = r"(?<=[{\[,:\s])'([^']*)'(?=[}\],\s])"


def repair_step(text: Column, attempt: int) -> Column:
    """One round of repairs; later attempts repair more."""
    if attempt == 0:
        block = F.regexp_extract(text, rx.py(BLOCK, "s"), 0)
        text = F.when(block != "", block).otherwise(text)
    if attempt >= 1:
        text = rx.replace(text, SINGLE, '"$1"')
    if attempt >= 2:
        text = rx.replace(text, r"\b(\w+)(?=\s*:)", '"$1"')
    text = rx.replace(text, r",\s*([\]}])", "$1")
    for literal, json in (("True", "true"), ("False", "false"), ("None", "null")):
        text = rx.replace(text, rf"\b{literal}\b", json)
    return rx.strip(text)


def canonical(text: Column) -> Column:
    """The value with its keys in order at all levels, or null if the text isn't one JSON value."""
    return F.when(strict_json(text), F.to_json(F.try_parse_json(text)))


def repair(text: Column, retries: int = 3) -> Column:
    """The canonical form of the text or of its first repair that parses; null if none does."""
    now = rx.strip(text)
    tried = [canonical(now)]
    for attempt in range(retries):
        now = repair_step(now, attempt)
        tried.append(canonical(now))
    return F.coalesce(*tried)


def normalize_json(text: Column, retries: int = 3, strict: bool = True) -> Column:
    """Repaired JSON; what can't be repaired is an error, or a record of the raw text if not strict."""
    fixed = repair(text, retries)
    if strict:
        return F.coalesce(fixed, F.raise_error(F.concat(F.lit("not JSON: "), F.substring(text, 1, 100))))
    record = F.to_json(F.struct(F.lit("not JSON after repairs").alias("_error"), F.lit("kept as it came").alias("_note"), text.alias("_raw")))
    return F.coalesce(fixed, record)


def keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.expr("cast(array() as array<string>)"))


def has(json: Column, *names: str) -> Column:
    """Whether the object has all these keys."""
    test = F.lit(True)
    for name in names:
        test = test & F.array_contains(keys(json), F.lit(name))
    return test


def is_list(json: Column, name: str) -> Column:
    return F.coalesce(F.substring(F.get_json_object(json, f"$.{name}"), 1, 1) == "[", F.lit(False))


def direction(json: Column) -> Column:
    """input or output: by its own field, or output if it looks like a provider's response."""
    output = has(json, "choices") | is_list(json, "content") | has(json, "response", "done") | (has(json, "model") & (has(json, "usage") | has(json, "finish_reason")))
    return F.when(has(json, "direction"), F.get_json_object(json, "$.direction")).when(output, F.lit("output")).otherwise(F.lit("input"))
