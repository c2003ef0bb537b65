"""Provider payloads (JSON text) in one response schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import jsonx

PROVIDERS = ("openai", "anthropic", "ollama", "generic")
RESPONSE = "struct<content:string,provider:string,model:string,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,finish_reason:string,metadata:string>"


def _at(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def _number(json: Column, path: str) -> Column:
    return _at(json, path).try_cast("bigint")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("bigint"))


def _items(json: Column) -> Column:
    return F.from_json(_at(json, "content"), "array<struct<type:string,text:string>>")


def detect(json: Column) -> Column:
    """openai, anthropic, ollama or generic, by the payload's keys."""
    texts = F.exists(F.coalesce(_items(json), F.expr("cast(array() as array<struct<type:string,text:string>>)")), lambda x: F.coalesce(x["type"] == "text", F.lit(False)))
    return (
        F.when(jsonx.has(json, "choices", "usage"), "openai")
        .when(jsonx.is_list(json, "content") & texts, "anthropic")
        .when(jsonx.has(json, "response", "done"), "ollama")
        .when(jsonx.has(json, "message", "model"), "ollama")
        .otherwise("generic")
    )


def _response(content: Column, provider: str, model: Column, prompt: Column, completion: Column, total: Column, finish: Column, metadata: Column) -> Column:
    names = ("content", "provider", "model", "prompt_tokens", "completion_tokens", "total_tokens", "finish_reason", "metadata")
    values = (content, F.lit(provider), model, prompt, completion, total, finish, metadata)
    return F.struct(*(v.alias(k) for k, v in zip(names, values, strict=True)))


def _unknown(x: Column) -> Column:
    return F.coalesce(x, F.lit("unknown"))


def _some(json: Column, *names: str) -> Column:
    return F.to_json(F.struct(*(_at(json, x).alias(x) for x in names)))


def parse_openai(json: Column) -> Column:
    return _response(
        F.coalesce(_at(json, "choices[0].message.content"), F.lit("")), "openai", _unknown(_at(json, "model")), _number(json, "usage.prompt_tokens"), _number(json, "usage.completion_tokens"),
        _number(json, "usage.total_tokens"), _unknown(_at(json, "choices[0].finish_reason")), _some(json, "id", "created", "object"),
    )


def parse_anthropic(json: Column) -> Column:
    texts = F.transform(F.filter(_items(json), lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit("")))
    content = F.when(jsonx.is_list(json, "content"), F.array_join(texts, "\n")).otherwise(F.coalesce(_at(json, "content"), F.lit("")))
    prompt, completion = _zero(_number(json, "usage.input_tokens")), _zero(_number(json, "usage.output_tokens"))
    return _response(content, "anthropic", _unknown(_at(json, "model")), prompt, completion, prompt + completion, _unknown(_at(json, "stop_reason")), _some(json, "id", "type", "stop_sequence"))


def parse_ollama(json: Column) -> Column:
    prompt, completion = _zero(_number(json, "prompt_eval_count")), _zero(_number(json, "eval_count"))
    content = F.coalesce(_at(json, "response"), _at(json, "message.content"), F.lit(""))
    finish = F.when(_at(json, "done") == "true", F.lit("stop")).otherwise(F.lit("length"))
    metadata = _some(json, "created_at", "done", "context", "total_duration", "load_duration", "prompt_eval_duration", "eval_duration")
    return _response(content, "ollama", _unknown(_at(json, "model")), prompt, completion, prompt + completion, finish, metadata)


def parse_generic(json: Column) -> Column:
    """The first of the usual fields; else the canonical payload; text that isn't an object is its own content."""
    null = F.lit(None).cast("bigint")
    fields = [F.when(jsonx.has(json, x), _at(json, x)) for x in ("content", "response", "text", "message", "output")]
    found = F.coalesce(*fields)
    content = F.coalesce(F.when(found != "", found), jsonx.canonical(json), json)
    return _response(content, "generic", F.lit("unknown"), null, null, null, F.lit("unknown"), F.when(F.json_object_keys(json).isNotNull(), json).otherwise(F.lit("{}")))


PARSERS = {"openai": parse_openai, "anthropic": parse_anthropic, "ollama": parse_ollama, "generic": parse_generic}


def parse(json: Column, provider: Column | None = None) -> Column:
    """One response; a provider that is given and known is taken at its word, else it is detected."""
    kind = detect(json)
    if provider is not None:
        kind = F.when(F.lower(provider).isin(*PROVIDERS), F.lower(provider)).otherwise(kind)
    chosen = F
    for name in PROVIDERS[:3]:
        chosen = chosen.when(kind == name, PARSERS[name](json))
    return chosen.otherwise(parse_generic(json))
