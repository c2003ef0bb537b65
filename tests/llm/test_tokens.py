import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import packing, tokencounts, tokenstore
from loomtext.llm.common import scratch_path
from loomtext.llm.tokens import Encoder, default_path, encoder


@given(st.text(alphabet="aAbÉéßΣσςİıǅ19_'’.,-#<|>́  \x1c\x85\t\n²Ⅷ한ᄀ가ﬁ​中ªʰ", max_size=20))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_tokenizer(text):
    e = encoder(default_path())
    assert e.encode([text, "<|endoftext|>" + text]) == e._whole([text, "<|endoftext|>" + text])


def test_memo_may_be_dropped():
    e = Encoder(default_path(), limit=5)
    texts = ["one two three, four. five six", "seven Eight nine. ten", "one two"]
    assert e.encode(texts) == e._whole(texts)


def ids_of(text, end):
    return encoder(default_path())._whole([text or ""])[0] + np.asarray([end], "<u4").tobytes()


def first_fit(lengths, capacity):
    """Sequences that first-fit decreasing needs."""
    room = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, left in enumerate(room) if left >= n), None)
        if at is None:
            room.append(capacity - n)
        else:
            room[at] -= n
    return len(room)


def test_packing_places_every_piece_once(docs, rows):
    found = packing.pack_documents(docs, capacity=256).collect()
    expected = Counter()
    for row in rows:
        body = ids_of(row[1], 1)
        for k, at in enumerate(range(0, len(body), 1024)):
            expected[row[0], k, at // 4, len(body[at : at + 1024]) // 4, zlib.crc32(body[at : at + 1024])] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= first_fit([r.length for r in found], 256) + 1


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_bins_are_feasible_and_few(histogram):
    key, first, times, start, n = packing.minimum_bin_slack(histogram, 60)
    fill = Counter()
    for length, count in histogram.items():
        for rank in range(count):
            wanted = length << packing.RANK_BITS | rank
            run = np.searchsorted(key, wanted, side="right") - 1
            fill[int(first[run] + (wanted - key[run]) // times[run])] += length
    assert len(fill) == n and max(fill.values()) <= 60 and sum(fill.values()) == sum(k * v for k, v in histogram.items())
    assert n <= first_fit([k for k, v in histogram.items() for _ in range(v)], 60) * 11 // 10 + 1


def test_fullest_is_optimal_for_its_seed():
    from itertools import product

    counts = {31: 1, 17: 2, 11: 2, 7: 3, 3: 1}
    found = packing.fullest(counts, sorted(counts, reverse=True), 60)
    best = max(s for k in product(*(range(v + 1) for v in counts.values())) if k[0] >= 1 and (s := sum(a * b for a, b in zip(counts, k, strict=True))) <= 60)
    assert sum(length * k for length, k in found) == best and dict(found)[31] == 1


def test_packing_rejects_lengths_beyond_the_capacity(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 300)], "doc_id bigint, length bigint"), 256)


def test_sequences_hold_the_ids(docs, none, rows):
    found = packing.sequences(docs, capacity=256).collect()
    assert sorted(b"".join(r.ids for r in found)) == sorted(b"".join(ids_of(r[1], 1) for r in rows))
    assert all(len(r.ids) == 4 * r.n_ids <= 1024 for r in found)
    assert packing.pack_documents(none).count() == 0


def test_token_store_round_trip(spark, docs, none, rows):
    path = scratch_path(spark, "ids")
    tokenstore.write_ids(docs, path)
    found = sorted(map(tuple, tokenstore.read_index(spark, path).collect()), key=lambda r: r[1])
    bodies = {}
    for row in rows:
        bodies.setdefault(row[0], []).append(ids_of(row[1], 2))
    start, seen = 0, []
    for doc, at, n, crc in found:
        assert at == start
        assert (n, crc) in [(len(b) // 4, zlib.crc32(b)) for b in bodies[doc]]
        seen.append(-1 if doc is None else doc)
        start += n
    assert seen == sorted(seen) and len(seen) == len(rows)
    hit = tokenstore.lookup(spark, path, [102])
    assert np.asarray(hit.first().ids, "<u4").tobytes() == bodies[102][0]
    assert "PushedFilters" in hit._jdf.queryExecution().toString()
    path = scratch_path(spark, "ids")
    tokenstore.write_ids(none, path)
    assert tokenstore.read_index(spark, path).count() == 0


def test_counts_follow_deltas(spark, docs, none, rows):
    expected = Counter()
    for row in rows:
        n, words = len(ids_of(row[1], 2)) // 4, len((row[1] or "").split())
        if words:
            expected[row[3], row[2], "word_bpe_49k"] += n
            expected[row[3], row[2], "words"] += words
    found = {tuple(r)[:3]: r.n_tokens for r in tokencounts.document_totals(docs).collect()}
    assert found == expected
    assert tokencounts.document_totals(none).count() == 0


def test_batches_are_idempotent_and_compact(spark, docs):
    rollup = tokencounts.Rollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    counts = tokencounts.count_documents(docs).persist()
    assert rollup.apply("a", tokencounts.deltas(counts, 1)) and not rollup.apply("a", tokencounts.deltas(counts, 1))
    once = sorted(map(str, rollup.totals().collect()))
    rollup.compact()
    assert sorted(map(str, rollup.totals().collect())) == once and rollup.batches() == ["a"]
    assert not rollup.apply("a", tokencounts.deltas(counts, 1))
    # A folder without the commit mark is a batch that broke off: it doesn't count, and it is written anew.
    tokencounts.deltas(counts, 1).groupBy(*tokencounts.KEYS).agg({"n_tokens": "sum"}).write.parquet(f"{rollup.path}/batch=b")
    fs, at = rollup._fs(f"{rollup.path}/batch=b/_SUCCESS")
    fs.delete(at, False)
    assert sorted(map(str, rollup.totals().collect())) == once
    assert rollup.apply("b", tokencounts.deltas(counts, -1)) and rollup.totals().count() == 0
    with pytest.raises(ValueError):
        rollup.apply("../x", tokencounts.deltas(counts, 1))


def test_long_chunks_are_not_kept_and_lengths_agree():
    e = Encoder(default_path(), limit=40)
    texts = ["x" * 5000 + " y", "a1.5b, don't (stop)!", None or "", "tail " * 3000, "naïve café ﬁ ａ"]
    for _ in range(3):
        assert e.encode(texts) == e._whole(texts)
        assert e.lengths(texts).tolist() == [len(x) // 4 for x in e._whole(texts)]
        assert e.held <= e.most
    ids, at = next(e.flat(texts, 7))
    assert ids[at[1:] - 1].tolist() == [7] * len(texts)


def test_one_file_for_a_task_whatever_the_session_says(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        tokenstore.write_ids(docs, f"file://{tmp_path}/ids")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = tokenstore.read_index(spark, f"file://{tmp_path}/ids").orderBy("doc_id").collect()
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert len(found) == 3000
