import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import classify, jsonx, providers, rx, validate
from loomtext.functions import text as T

ODD = ["", " ", "a", "A  b\t c.", "x\r\ny\rz \n\n\n\n\nq  ", "\u00a0nb\u2003sp\x1c", "```PY\n\n\ncode\n\n```\n\n\n\n- a\n*   b\n##   h", "é È ß İ Σς", "def f(): import x", "\x1fa\x85b\u2028c", "a\n    \n\n\n\t\nb"]


def one(spark, column, *values):
    names = "abc"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("r")).first().r


def each(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in df.select("i", column(F.col("t")).alias("r")).orderBy("i").collect()]


def test_whitespace(spark):
    def rule(t):
        lines = [x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        return re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines)).strip()

    assert each(spark, T.normalize_whitespace, ODD) == [rule(t) for t in ODD]


def test_prompt_normal(spark):
    def rule(t):
        t = t.replace("\r\n", "\n").strip()
        for pattern, by in ((r"```(\w+)?\n+", "```\\1\n"), (r"\n+```", "\n```"), (r"\n{3,}", "\n\n"), (r"\n([*-])\s+", r"\n\1 "), (r"\n(#{1,6})\s+", r"\n\1 ")):
            t = re.sub(pattern, by, t)
        return t

    assert each(spark, T.normalize_prompt, ODD) == [rule(t) for t in ODD]


def test_dedup_normal(spark):
    def rule(t):
        t = " ".join(t.lower().split())
        return t if sum(x in t for x in T.CODE_PARTS) >= 2 else t.strip(".,;:!? \t\n")

    assert each(spark, T.normalize_for_dedup, [*ODD, "... Hello,  World!!", "class A { }  ;"]) == [rule(t) for t in [*ODD, "... Hello,  World!!", "class A { }  ;"]]


def test_hashes(spark):
    assert each(spark, lambda t: T.hash_text(t, "blake2b", False), ["abc"]) == [hashlib.blake2b(b"abc").hexdigest()]
    assert each(spark, lambda t: T.hash_chunk(t, "unknown"), ["abc"]) == [hashlib.sha256(b"abc").hexdigest()]
    with pytest.raises(ValueError):
        T.hash_text(F.lit("x"), "crc")


def test_code_blocks(spark):
    text = "a ```py\nx = 1\n``` b ```\nplain\n``` c ```py\nx = 1\n```"
    found = each(spark, T.code_blocks, [text])[0]
    assert [(b.language, b.content, text[b.start : b.end]) for b in found] == [("py", "x = 1", "```py\nx = 1\n```"), ("plaintext", "plain", "```\nplain\n```"), ("py", "x = 1", "```py\nx = 1\n```")]


def test_prompt_types(spark):
    cases = {"### System: be brief": "system", "def f(): pass": "code", "x ``` y": "code", "    indented": "code", "User: hi": "conversation", "For example: this": "example", "Input: 3": "example", "Explain this": "instruction", "": "instruction"}
    assert each(spark, T.prompt_type, list(cases)) == list(cases.values())


def test_response_cleaning(spark):
    from loomtext.operators.responses import clean

    text = "<thinking>\nhm\n</thinking>[SYSTEM]x[/SYSTEM]Let me think about it.\n\nAnswer:  \n```PYTHON\n\nx\n\n```\n"
    assert one(spark, clean(F.col("a")), text) == "Answer:\n```python\nx\n```"
    assert one(spark, T.remove_quirks(F.col("a"), F.col("b")), "[INST] q\nr [/INST] hi </s>", "Llama2-chat") == "hi"
    assert one(spark, T.remove_quirks(F.col("a"), F.lit(None).cast("string")), "hi </s>") == "hi </s>"


def test_classifier(spark):
    cases = {"": "unknown", "def f(x):\n    return x\n\nclass A:\n    def g(self):\n        return [1, 2]; if (a && b) {}": "code", '{"a": [1, 2]}': "structured_data", "<a><b>x</b></a>": "structured_data", "name: x\nage: 3": "structured_data", "The cat is on the mat, and it was there for the whole of the long day. It is a quiet place, and the people are kind; they stay!": "prose"}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.content_type for r in classify.classify(df).collect()} == cases


@pytest.mark.parametrize(("text", "ok"), [('{"a":1}', True), ('{"a":1} x', False), ("[1", False), ("1", True), ('{"a":NaN}', False), ("", False), ('{"a":1}{"b":2}', False), ("1,2", False), ('"x"', True)])
def test_strict_json(spark, text, ok):
    assert one(spark, classify.strict_json(F.col("a")), text) is ok


def test_json_repair(spark):
    cases = {'{"b": 1, "a": [2, {"d": 1, "c": 2}]}': '{"a":[2,{"c":2,"d":1}],"b":1}', 'Result: {"a": 1,} done': '{"a":1}', "{a: 1, b: True}": '{"a":1,"b":true}', "{\"a\": 'x'}": '{"a":"x"}', "no json": None, '{"a": None}': '{"a":null}'}
    assert each(spark, jsonx.repair, list(cases)) == list(cases.values())
    assert json.loads(each(spark, lambda t: jsonx.normalize_json(t, strict=False), ["nope"])[0])["_raw"] == "nope"
    with pytest.raises(Exception, match="not JSON"):
        each(spark, jsonx.normalize_json, ["nope"])


def test_providers(spark):
    payloads = [
        {"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}, "model": "g"},
        {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 4, "output_tokens": 5}},
        {"model": "m", "message": {"content": "chat"}, "done": False, "eval_count": 7}, {"response": "r", "done": True}, {"output": "o"}, {"z": 1, "a": 2},
    ]
    found = each(spark, lambda t: providers.parse(t), [json.dumps(p) for p in payloads])
    assert [(r.provider, r.content, r.total_tokens, r.finish_reason) for r in found] == [("openai", "hi", 3, "stop"), ("anthropic", "a\nb", 9, "unknown"), ("ollama", "chat", 7, "length"), ("ollama", "r", 0, "stop"), ("generic", "o", None, "unknown"), ("generic", '{"a":2,"z":1}', None, "unknown")]
    assert one(spark, providers.parse(F.col("a"), F.lit("ollama")), json.dumps(payloads[4])).provider == "ollama"
    assert [jsonx_direction for jsonx_direction in each(spark, jsonx.direction, [json.dumps(p) for p in [*payloads, {"direction": "input", "choices": 1}]])] == ["output", "output", "input", "output", "input", "input", "input"]


def test_validation(spark):
    good = {"content": "x", "provider": "openai", "model": "m", "usage": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}, "finish_reason": "stop", "timestamp": "2024-01-01T00:00:00Z"}
    bad = {"provider": "who", "usage": {"prompt_tokens": -1}, "timestamp": "soon"}
    failed = lambda checks: sorted((c.name, c.severity) for c in checks if not c.passed)
    a, b, c = each(spark, validate.validate_output, [json.dumps(good), json.dumps(bad), "[1]"])
    assert failed(a) == [] and failed(b) == [("content", "error"), ("provider", "warning"), ("required_fields", "error"), ("timestamp", "warning"), ("token_counts", "error"), ("usage", "error")] and ("structure", "error") in failed(c)
    a, b = each(spark, validate.validate_input, [json.dumps({"content": "x", "type": "code", "token_estimate": 1, "direction": "input"}), json.dumps({"type": "poem"})])
    assert failed(a) == [] and ("prompt_type", "warning") in failed(b)
    assert [e.field for e in one(spark, validate.schema_errors(F.col("a")), json.dumps(bad))] == ["content", "provider", "model", "usage.prompt_tokens", "timestamp"]


def test_fidelity(spark):
    text = "# Title\n\nSome meaningful words about rivers and bridges."
    same = one(spark, validate.fidelity_report(F.col("a"), F.col("b")), text, text)
    assert same.fidelity_score == pytest.approx(1.0) and same.semantic_preserved and same.structure_preserved
    gone = one(spark, validate.fidelity_report(F.col("a"), F.col("b")), text, "")
    assert gone.fidelity_score < 0.3 and not gone.content_preserved
    trip = one(spark, validate.round_trip(F.col("a"), F.col("b")), text, text + " ")
    assert not trip.exact and trip.passed and trip.similarity == 1.0


def test_split_lines(spark):
    assert each(spark, rx.split_lines, ODD) == [t.splitlines() for t in ODD]
