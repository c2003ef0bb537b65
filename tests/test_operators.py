import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.operators import blocks, chunk, dedup, prompts, responses, segment, stats


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


PROSE = ["", None, "One. Two! Three? ", "Dr. Smith went. It was e.g. fine. \"Yes.\" 'No.'", "a. b. C. d", "No end", "Final. Systems. Done. Ok", "x!!  Yes...  No", "Line one.\nLine two. 3 four. é. É.", ".", "A.B. C"]


def sentences(text):
    """The rule, mark by mark."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]", text):
        end = m.end()
        if text[max(0, m.start() - 10) : m.start()].lower().endswith(segment.ABBREVIATIONS):
            continue
        rest = text[end:]
        after = rest.lstrip()
        if rest and not (rest[0].isspace() and (not after or after[0].isupper() or after[0].isdigit() or after[0] in "\"'")):
            continue
        out.append((start, end))
        start = end
    return [(text[a:b].strip(), a, b) for a, b in [*out, (start, len(text))] if len(text[a:b].strip()) >= 3]


def test_sentences_follow_the_rule(spark):
    rng = random.Random(1)
    texts = PROSE + ["".join(rng.choice("aB1é.!?  \n\"'") for _ in range(rng.randint(0, 60))) + rng.choice(["", " dr. X", " etc. Y"]) for _ in range(300)]
    found = {}
    for r in segment.segment(frame(spark, texts), preserve_code=False).collect():
        found.setdefault(r.doc_id, []).append((r.text, r.start_pos, r.end_pos))
    assert {i: sorted(v, key=lambda x: x[1]) for i, v in found.items()} == {i: s for i, t in enumerate(texts) if t and (s := sentences(t))}


def test_code_is_kept_whole(spark):
    text = "Before. It is.\n```py\nx = 1. Y\n```\nAfter it. Done.\n    indented. Code\n    more\nEnd."
    rows = sorted(segment.segment(frame(spark, [text, "plain. Text"])).where("doc_id = 0").collect(), key=lambda r: r.seg_idx)
    assert [r.text for r in rows if r.type == "code_block"] == ["```py\nx = 1. Y\n```", "\n    indented. Code\n    more"]
    assert all(text[r.start_pos : r.end_pos].strip() == r.text.strip() for r in rows)
    assert {r.code_type for r in rows} == {None, "fenced", "indented"}


def test_paragraphs(spark):
    text = "# Head\n\n- item\n \n1. one\n\n\n~~~\ncode\n~~~\n\nprose\nmore"
    rows = segment.segment(frame(spark, [text]), "paragraph").orderBy("seg_idx").collect()
    assert [(r.type, r.text) for r in rows] == [("heading", "# Head"), ("list_item", "- item"), ("list_item", "1. one"), ("code_block", "~~~\ncode\n~~~"), ("paragraph", "prose\nmore")]
    assert all(text[r.start_pos : r.end_pos] == r.text for r in rows)
    with pytest.raises(ValueError):
        segment.segment(frame(spark, [text]), "word")


@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, most, overlap):
    parts = list(chunk.pack(text, most, overlap))
    lines = [x for x in text.split("\n") if len(x) + 1 <= most]
    packed = [x for c, _, kind in parts if kind == "segment" for x in c.split("\n")]
    assert [x for x in lines if x] == [] or set(lines) <= set(packed)
    assert all(n == len(c) + 1 <= most + overlap for c, n, kind in parts if kind == "segment")
    assert all(len(c) <= most for c, _, kind in parts if kind == "long_line_fragment")


def test_chunks_in_and_out_of_the_jvm(spark):
    texts = ["short", "", None, "line\n" * 600, "x" * 5000 + "\nend"]
    rows = chunk.chunk(frame(spark, texts), most=2048, overlap=200).orderBy("doc_id", "chunk_id").collect()
    expected = [(i, k, *c) for i, t in enumerate(texts) if t for k, c in enumerate(chunk.pack(t, 2048, 200))]
    assert [(r.doc_id, r.chunk_id, r.content, r.length, r.chunk_type) for r in rows] == expected
    with pytest.raises(ValueError):
        chunk.chunks(F.col("text"), 10, 10)


def test_dedup(spark, tmp_path):
    texts = ["Hello there, world.", "hello   there, WORLD!", "tiny", "tiny", "Another longer text", "hello there, world"]
    df = dedup.hashed(frame(spark, texts))
    assert [r.duplicate for r in dedup.flag(df, ["doc_id"]).orderBy("doc_id").collect()] == [False, True, False, False, False, True]
    assert sorted(r.doc_id for r in dedup.survivors(df, ["doc_id"]).collect()) == [0, 2, 3, 4]
    index = dedup.index(df, ["doc_id"], seen=F.lit("t"))
    assert sorted((r.text, r.occurrences) for r in index.collect()) == [("Another longer text", 1), ("Hello there, world.", 3)]
    dedup.save_index(index, f"{tmp_path}/index")
    loaded = dedup.load_index(spark, f"{tmp_path}/index")
    assert dedup.unseen(df.where("hash is not null"), loaded).count() == 0 and dedup.known(df, loaded).count() == 4
    assert sorted(r.occurrences for r in dedup.merge_index(loaded, index).collect()) == [2, 6]
    dedup.export_index(index, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["hash", "text", "first_seen", "occurrences"]
    row = dedup.statistics(dedup.flag(df, ["doc_id"])).first()
    assert (row.total_processed, row.unique_content, row.duplicates_found, row.dedup_ratio) == (4, 2, 2, 0.5)
    same = dedup.summary(df, ["doc_id"])
    assert same.first() == row and dedup.summary(df.where("1 = 0"), ["doc_id"]).first().total_processed == 0
    for bad in (lambda: dedup.save_index(index, ""), lambda: dedup.export_index(index, "x", "xml")):
        with pytest.raises(ValueError):
            bad()


def test_prompts(spark):
    rows = [(0, "a", "Explain this. " * 400), (1, None, "User: hi"), (2, "c", ""), (3, "d", "User: hi"), (4, "e", "Code:\n```py\nx\n```")]
    df = prompts.with_ids(spark.createDataFrame(rows, "ord int, id string, content string").repartition(3), ["ord"])
    found = prompts.process(df, ["ord"], most=2048, overlap=200).orderBy("ord", "segment_index").collect()
    assert [r.id for r in found if r.ord == 1] == ["prompt_1_seg_0"] and not [r for r in found if r.ord == 2]
    assert [r.duplicate for r in found if r.ord in (1, 3)] == [False, True]
    assert [b.language for r in found if r.ord == 4 for b in r.code_blocks] == ["py"] and all(r.code_blocks is None for r in found if r.ord != 4)
    rolled = {r.prompt_id: r for r in prompts.for_provider(prompts.rollup(prompts.process(df, ["ord"])), "ollama").collect()}
    assert rolled["a"].segments == len([r for r in found if r.ord == 0]) and rolled["a"].optimized_for == "ollama" and rolled["d"].content == "User: hi"
    seen = spark.createDataFrame([(r.hash,) for r in found if r.ord == 1], "hash string")
    assert all(r.duplicate for r in prompts.process(df, ["ord"], seen=seen).where("ord in (1, 3)").collect())


def test_compare(spark):
    rows = [(1, 0, "m", "p", "the same words here"), (1, 1, "m", "q", "The same words HERE"), (1, 2, "n", "q", "the same words here"), (2, 0, "m", "p", "alone")]
    df = responses.normalize(spark.createDataFrame(rows, "g int, o int, model string, provider string, response string"))
    assert sorted((r.i, r.j, r.similarity, r.similar) for r in responses.pairs(df, "g", "o").collect()) == [(0, 1, 1.0, True), (0, 2, 1.0, True), (1, 2, 1.0, True)]
    found = {r.g: r for r in responses.compare(df, "g", "o").collect()}
    assert (found[1].unique_responses, found[1].duplicate_responses, found[1].providers, found[1].average_similarity) == (2, 1, ["p", "q"], 1.0)
    assert found[2].average_similarity == 0.0


def kinds(text, strict=True):
    return [(b["type"], b["content"]) for b in blocks.scan(text, strict)]


def test_block_rules():
    text = "# Head\npara one\nmore\n\n- a\n- b\n1. c\n```py\nx\n```\nWhy?\n<thinking>\nhm\n</thinking>\nend"
    assert kinds(text) == [("heading", "Head"), ("paragraph", "para one\nmore"), ("list", None), ("code_block", "x"), ("question", "Why?"), ("thinking", "hm"), ("paragraph", "end")]
    assert kinds("```py\nnever closed") == [("paragraph", "never closed")] and kinds("```py\nnever closed", False) == [("paragraph", "```py\nnever closed")]
    assert kinds("#tag") == [] and kinds("#tag", False) == [("paragraph", "#tag")]


def test_blocks_survive_a_second_pass(spark):
    texts = ["# H\n\nText here.\n\n1. a\n2. b\n\n```js\nx\n```\n\nReally?", "plain\n\n- x\n- y"]
    once = blocks.parse(frame(spark, texts)).withColumn("text", blocks.reconstruct(F.col("blocks")))
    twice = blocks.parse(once.select("doc_id", "text")).withColumn("again", blocks.reconstruct(F.col("blocks")))
    assert [(r.text, r.again) for r in twice.collect()] == [(r.again, r.again) for r in twice.collect()]
    assert [r.text for r in once.orderBy("doc_id").collect()] == texts
    s = once.orderBy("doc_id").first().statistics
    assert (s.total_blocks, s.heading, s.list, s.has_code) == (5, 1, 1, True)


def test_statistics(spark):
    rates = {r.granularity: (r.total, r.unique) for r in stats.dedup_rates(frame(spark, ["One line here.\nOne line here.", "Other. One line here."])).collect()}
    assert rates["line"] == (3, 2)
    items = spark.createDataFrame([(1000, False), (1000, True)], "token_estimate int, duplicate boolean")
    cost = stats.token_cost(items).first()
    assert cost.cost == pytest.approx(0.06 + 0.012) and cost.saved_share == pytest.approx(0.5)
    assert stats.embedding_cost(items).first().unique_cost == pytest.approx(0.0001)
    assert stats.token_cost(items.where("1 = 0")).first().saved_share == 0.0
