"""Guards, records, documents of blocks, streams' counts, SQL names."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.errors import LoomError, ParsingError, ValidationError
from loomtext.functions import classify, jsonx, register, validate
from loomtext.operators import blocks, dedup, responses, segment
from loomtext.plans import pipeline
from loomtext.sources import files
from loomtext.streaming import streams

TEXT = "# Title\n\nSome *prose* here.\n\n```python\nx = 1\n```\n\n- one\n- two\n\nIs it so?\n\n<thinking>\nwell\n</thinking>"


def test_file_guards(spark, tmp_path):
    (tmp_path / "good.txt").write_text("é" * 3000, encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"abc \xff\xfe def")
    assert files.check_encoding(spark, f"{tmp_path}/good.txt")
    with pytest.raises(ParsingError):
        files.check_encoding(spark, f"{tmp_path}/bad.txt")
    assert files.check_writable(spark, f"{tmp_path}/new/deep/out.json") and (tmp_path / "new/deep").is_dir()
    with pytest.raises(ValidationError):
        files.check_writable(spark, "/proc/nowhere/out.json")
    with pytest.raises(LoomError):
        files.check_readable(spark, f"{tmp_path}/good.txt", 0.001)
    chunks = files.read_chunks(spark, f"{tmp_path}/good.txt", 1000).orderBy("chunk").collect()
    assert [len(r.text) for r in chunks] == [1000, 1000, 1000] and "".join(r.text for r in chunks) == "é" * 3000


def test_crawl_leaves_parts_out(spark, tmp_path):
    for name in ("src/a.py", "env/b.py", "x.egg-info/c.py", "src/.pytest_cache/d.py", "src/e.txt"):
        (tmp_path / "env_root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "env_root" / name).write_text("x")
    found = files.crawl(spark, f"{tmp_path}/env_root", (".py",)).collect()
    assert [r.file.rpartition("/")[2] for r in found] == ["a.py"]


def test_envelope_holds_statistics(spark, tmp_path):
    segments = spark.createDataFrame([("a",), ("b",)], "text string")
    files.write_segments(segments, f"{tmp_path}/out", "json", "in.txt", spark.createDataFrame([(3, 0.5)], "lines int, dedup_ratio double"))
    head = spark.read.json(f"{tmp_path}/out/metadata").first()
    assert head.total_segments == 2 and head.statistics.lines == 3 and head.statistics.dedup_ratio == 0.5


def test_thresholds_and_contents(spark):
    docs = spark.createDataFrame([("abc",), (None,), ("",), ("abcdef",)], "text string")
    assert [r[0] for r in docs.select(validate.text_content(F.col("text"), 1, 5)).collect()] == [True, False, False, False]
    for bad in (-0.1, 1.5, "x", True):
        with pytest.raises(ValidationError):
            classify.classify(docs, threshold=bad)


def test_index_statistics_are_brute_force(spark):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(["a", "b", "a", None, "c", "b", "z", "z"])], "id int, hash string")
    flagged = dedup.flag(rows, ["id"])
    assert dedup.index_statistics(flagged).first().asDict() == {"total_processed": 7, "unique_content": 4, "duplicates_found": 3, "cache_hits": 0, "unique_hashes": 4, "dedup_ratio": 3 / 7}
    known = spark.createDataFrame([("z",), ("q",)], "hash string")
    assert dedup.index_statistics(flagged, known).first().asDict() == {"total_processed": 7, "unique_content": 3, "duplicates_found": 4, "cache_hits": 2, "unique_hashes": 5, "dedup_ratio": 4 / 7}
    assert dedup.index_statistics(flagged.where("1 = 0")).first().dedup_ratio == 0


def test_documents_of_blocks(spark):
    df = spark.createDataFrame([(TEXT,), ("",), (None,)], "text string").withColumn("blocks", blocks.parser()(F.col("text")))
    found = df.select("text", "blocks", blocks.kind_counts(F.col("blocks")).alias("k"), blocks.to_document(F.col("blocks"), "low", F.create_map(F.lit("by"), F.lit("me"))).alias("json"), blocks.meaning(F.col("blocks")).alias("m"), blocks.compress(F.col("blocks"), 12).alias("few")).collect()
    row = next(r for r in found if r.text == TEXT)
    assert {k: v for k, v in row.k.asDict().items() if v} == Counter(b["type"] for b in blocks.scan(TEXT, False)) and len(row.k) == 17
    doc = json.loads(row.json)
    assert doc["version"] == blocks.VERSION and doc["fidelity"] == "low" and doc["metadata"] == {"by": "me"} and doc["statistics"]["total_blocks"] == len(doc["blocks"]) == 5
    assert [b["type"] for b in doc["blocks"]].count("thinking") == 0
    assert row.m.titles == ["Title"] and row.m.questions == ["Is it so?"] and row.m.languages == ["python"] and row.m["items"] == ["one", "two"]
    assert [b["type"] for b in row.few] == ["heading", "code_block"]
    again = spark.createDataFrame([(row.json,), ("{}",), ("x",)], "json string").select(blocks.from_document(F.col("json")).alias("d")).collect()
    assert [b.type for b in again[0].d.blocks] == [b["type"] for b in doc["blocks"]] and again[1].d is None and again[2].d is None


def test_records_are_coerced(spark):
    good = '{"content": "hello", "provider": "openai", "model": "m", "usage": {"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 9}}'
    zero = good.replace('"total_tokens": 9', '"total_tokens": 0')
    bad = '{"provider": "who", "model": ""}'
    found = [r[0] for r in spark.createDataFrame([(good,), (zero,), (bad,)], "json string").select(validate.safe_validate(F.col("json"), "output")).collect()]
    assert found[0].valid and found[0].record.usage.total_tokens == 5 and found[1].record.usage.total_tokens == 0
    assert not found[2].valid and found[2].record is None and {e.field for e in found[2].errors} == {"content", "provider", "model"}
    prompt = '{"content": "hi", "type": "instruction", "token_estimate": 1, "segments": [{"id": "a", "content": "four", "length": 99}]}'
    wrong = ['{"content": "", "type": "poem", "token_estimate": -1, "segments": []}', "[1]"]
    found = [r[0] for r in spark.createDataFrame([(prompt,), *((x,) for x in wrong)], "json string").select(validate.safe_validate(F.col("json"), "input")).collect()]
    assert found[0].valid and found[0].record.segments[0].length == 4
    assert {(e.field, e.error) for e in found[1].errors} == {("content", "empty"), ("type", "not a known type"), ("token_estimate", "not a count"), ("segments", "empty")}
    assert not found[2].valid


def test_full_mode(spark):
    rows = [(1, '{"model": "llama2", "response": "hello", "done": true, "prompt_eval_count": 2, "eval_count": 3}'), (2, '{"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}], "model": "gpt-4", "usage": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 7}}'), (3, "plain words"), (4, None)]
    df = spark.createDataFrame(rows, "id int, raw string")
    out = {r.id: r for r in pipeline.normalize_full(df).collect()}
    assert all(out[k].valid for k in (1, 2, 3)) and json.loads(out[1].record)["provider"] == "ollama"
    assert json.loads(out[2].record)["usage"]["total_tokens"] == 2 and json.loads(out[3].record)["content"] == "plain words"
    prompts = {r.id: r for r in pipeline.normalize_full(spark.createDataFrame([(1, "Write a poem"), (2, "  ")], "id int, raw string"), kind="input").collect()}
    assert prompts[1].valid and not prompts[2].valid and json.loads(prompts[2].record)["_raw"] == "  "
    with pytest.raises(Exception, match="not a valid record"):
        pipeline.normalize_full(spark.createDataFrame([(2, " ")], "id int, raw string"), kind="input", strict=True).collect()
    own = responses.normalize_ollama(df.where("id = 1")).first()
    assert own.ollama_metadata.eval_count == 3 and own.ollama_metadata.done and own.response.provider == "ollama"


def test_comparing_nothing_is_an_error_row(spark):
    rows = spark.createDataFrame([(1, "openai", "m", "the same words"), (2, "ollama", "n", "the same words")], "turn int, provider string, model string, text string")
    two = responses.compare_all(responses.normalize(rows, "text"), "turn").collect()
    assert len(two) == 1 and two[0].total_responses == 2 and two[0].error is None
    none = responses.compare_all(responses.normalize(rows.where("1 = 0"), "text"), "turn").collect()
    assert len(none) == 1 and none[0].error and none[0].total_responses is None


def test_streams_flush_and_count(spark, tmp_path):
    spark.createDataFrame([(1, 0, "One whole sentence."), (1, 1, "left over"), (2, 0, "no end")], "conv_id bigint, turn bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/turns")
    found = sorted((r.stream_id, r.unit, r.content, r.done) for r in streams.buffered_batch(spark, f"{tmp_path}/turns").collect())
    assert found == [("1", 0, "One whole sentence.", False), ("1", 1, "left over", True), ("2", 0, "no end", True)]
    payloads = spark.createDataFrame([("s", 0, '{"response": "Hi ", "model": "m", "done": false}'), ("s", 1, '{"response": "", "done": true}'), ("s", 2, "junk")], "stream_id string, seq int, raw string")
    assert [(r.chunk, r.done) for r in streams.ollama_chunks(payloads).orderBy("seq").collect()] == [("Hi ", False), ("", True), ("", False)]
    units = streams.ollama_units(spark.createDataFrame([("s", 0, "Hi", False), ("s", 1, "", True)], "stream_id string, unit long, content string, done boolean"), "m")
    assert [(r.model, r.provider) for r in units.orderBy("unit").collect()] == [("m", "ollama"), (None, "ollama")]


def test_sql_names(spark):
    register.register(spark)
    assert [tuple(r) for r in spark.sql("select seg_idx, text, type from loom_segments('One is here. Two is too.\n```\nx\n```')").collect()] == [(i, x["text"], x["type"]) for i, x in enumerate(segment.segments_of("One is here. Two is too.\n```\nx\n```"))]
    raw = ["{'a': 1}", "{\"b\": [1, 2,],}", "none here", "```json\n{\"c\": True}\n```", "{key: 'it\\'s'}"]
    rows = spark.createDataFrame([(x,) for x in raw], "t string")
    assert rows.selectExpr("loom_json_repair(t)").collect() == rows.select(jsonx.repair(F.col("t"))).collect()
