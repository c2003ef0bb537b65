import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from loomtext.llm import linededup, mixing, neardup, quality, toxicity
from tests.llm.conftest import prose


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], (r[0] or 0) % 2, (r[0] or 0) % 3 == 0 and 1 or 0) for r in rows], "doc_id bigint, quality int, toxic int")


def auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    return float((p[y == 1][:, None] > p[y == 0][None, :]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).mean())


# Line dedup


def brute_lines(rows):
    """(doc, position) of lines that go: greedy templates, all lines of a leaf at once."""
    lines = {}
    for doc, text in rows:
        for line in linededup.masked(text or "").split("\n"):
            if len(line.split()) >= linededup.LEAST:
                lines.setdefault(line, set()).add(linededup.LAST if doc is None else doc)
    leaves = {}
    for line in sorted(lines):
        tokens = line.split()
        leaves.setdefault((len(tokens), *tokens[: linededup.DEPTH]), []).append(line)
    first = {}
    for part in leaves.values():
        own, _ = linededup.merge_block([x.split() for x in part])
        for k in set(own):
            group = [x for x, o in zip(part, own, strict=True) if o == k]
            docs = set().union(*(lines[x] for x in group))
            if len(docs) > 1:
                first |= {x: min(docs) for x in group}
    gone = set()
    for doc, text in rows:
        doc = linededup.LAST if doc is None else doc
        gone |= {(doc, i) for i, x in enumerate(linededup.masked(text or "").split("\n")) if first.get(x, doc) != doc}
    return gone


def line_rows():
    common = "this line is the same in many of the documents here"
    log = "user logged in from address number {} at the given time today"
    rows = [(k, f"{prose(k, 12)}\n{common}\n{log.format('n' + 'abc'[k % 3])}\nshort one\n{prose(900 + k, 15)}", f"e{k}") for k in range(12)]
    passage = prose(5, 60)
    rows += [(50 + k, prose(60 + k, 9) + "\n" + passage + f"\nseen 4{k} times by {k} people on day {k}", "p") for k in range(4)]
    return [*rows, rows[0], (70, None, "n"), (71, "", "n"), (None, common + "\n" + prose(77, 20), "n"), (72, prose(1, 20_000), "long")]


def test_lines_are_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id bigint, text string, template string, leaf int").repartition(3)
    found = linededup.document_lines(docs).collect()
    got = {(linededup.LAST if r.doc_id is None else r.doc_id, i) for r in found for i in r.dropped}
    assert got == brute_lines([(a, b) for a, b, _ in rows])
    assert len(found) == len(rows)
    texts = dict(((a, b) for a, b, _ in rows))
    for r in found:
        kept = None if texts[r.doc_id] is None else "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in r.dropped)
        assert r.text == kept
    passages = [r for r in found if r.doc_id is not None and 50 <= r.doc_id < 54]
    assert sorted(1 in r.dropped for r in passages) == [False, True, True, True]
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert linededup.document_lines(docs.where("1 = 0")).count() == 0


def test_templates_generalise():
    own, templates = linededup.merge_block(["a b c d red f".split(), "a b c d blue f".split(), "a b c x y z".split()])
    assert own == [0, 0, 1] and templates[0] == ["a", "b", "c", "d", "<*>", "f"]


def test_masking_is_linear_and_alike_in_both_engines(spark):
    text = "x" * 100_000 + " a1b 22\t3\n4é5 é"
    assert linededup.masked(text).split()[1:] == ["<*>", "<*>", "<*>", "<*>", "é"]
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"regexp_replace(t, r\"{linededup.VARIABLE}\", '<*>') as m", f"xxhash64(regexp_replace(t, r\"{linededup.VARIABLE}\", '<*>')) as h").first()
    assert row.m == linededup.masked(text) and row.h == linededup.line_hash(linededup.masked(text))


# Near duplicates


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join("changed" + str(rng.randint(0, 10**6)) if rng.random() < share else w for w in text.split())


def near_rows():
    rows = [(k, prose(k, 120)) for k in range(40)]
    rows += [(100 + k, changed(rows[0][1], 0.015, k)) for k in range(30)] + [(200 + k, rows[3][1]) for k in range(5)]
    rows += [(300, "One two."), (301, "one, TWO"), (302, ""), (303, None), (304, "..."), (None, rows[7][1]), (305, " ".join(reversed(rows[9][1].split()))), (306, prose(1, 25_000)), (307, prose(1, 25_000) + " more")]
    return [*rows, rows[3]]


def brute_classes(rows):
    words = neardup.Words()
    seqs = [neardup.shingles(words(t or "")) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or neardup.similarity(seqs[i], seqs[j]) >= neardup.LEAST:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    order = lambda x: linededup.LAST if x is None else x
    return {i: min((rows[k][0] for k in g), key=order) for g in groups.values() for i in g}


def test_classes_are_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, label int").repartition(3)
    found = Counter((r.doc_id, r.class_id) for r in neardup.document_classes(docs).collect())
    assert found == Counter((rows[i][0], c) for i, c in brute_classes(rows).items())
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({-1 if c is None else c for _, c in found})
    assert neardup.document_classes(docs.where("1 = 0")).count() == 0


def test_buckets_of_many_texts_lose_no_pair(spark):
    """Texts of one passage and an ending: buckets of far over MOST, in which only the two texts of an ending are linked."""
    passage = prose(1, 80)
    words = neardup.Words()
    pairs = []
    for k in range(1500):
        end = [f"{x}q{k}" for x in prose(1000 + k, 24).split()]
        pairs.append((f"{passage} {' '.join(end)}", f"{passage} {' '.join(end[:14])} {' '.join(x + 'z' for x in end[14:])}"))
    assert all(neardup.similarity(*(neardup.shingles(words(x)) for x in pair)) >= neardup.LEAST for pair in pairs)
    docs = spark.createDataFrame([(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)], "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in neardup.document_classes(docs).collect()} == {x: x // 2 * 2 for x in range(3000)}


def test_shared_shingles_are_counted():
    rng = np.random.default_rng(5)
    some = [rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64) for _ in range(25)]
    expected = [[(Counter(a.tolist()) & Counter(b.tolist())).total() for b in some[10:]] for a in some[:10]]
    assert neardup.overlaps(some[:10], some[10:]).tolist() == expected


def test_banded_alignment_is_the_full_one():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 2)) if rng.random() < 0.5 else rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        full = table[-1, -1]
        assert neardup.common(a, b, 50) == full
        exact = full / (len(a) + len(b) - full)
        assert neardup.similarity(a, b) == (pytest.approx(exact) if exact >= neardup.LEAST else neardup.similarity(a, b)) and (neardup.similarity(a, b) >= neardup.LEAST) == (exact >= neardup.LEAST)


def test_order_and_repeats_change_the_sketch():
    words = neardup.Words()
    text = prose(1, 200)
    half = text.split()
    keys = [neardup.sketch([words(t)])[0] for t in (text, text, " ".join(half[100:] + half[:100]), text + " " + text)]
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).mean() < 0.7 and (keys[0] == keys[3]).mean() < 0.7


def test_components(spark):
    edges = [(b"a", b"b"), (b"c", b"b"), (b"x", b"y"), (b"z", b"y"), (b"z", b"w")]
    found = {bytes(r.node): bytes(r.label) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert found == dict.fromkeys((b"a", b"b", b"c"), b"a") | dict.fromkeys((b"w", b"x", b"y", b"z"), b"w")


# Mixing


def test_mix_follows_the_rule(spark, docs, rows, none):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    by = {}
    for r in found:
        assert r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
        by.setdefault(r.source, []).append(r)
    assert sum({s: rs[0].target for s, rs in by.items()}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, rs in by.items():
        assert rs[0].target <= 2 * sizes[s] + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) / 2 + 1
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +Counter({k: n for k, n in sum((Counter({r.doc_id: r.taken // r["size"]}) for r in found if r["size"]), Counter()).items()})


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_weights_decide_the_order(spark):
    rows = [(k, ("good words here " * 5) if k % 2 else ("w# x$ y% " * 5), "s") for k in range(400)]
    sizes = mixing.mix(spark.createDataFrame(rows + [(1000 + k, "z " * 40, "t") for k in range(300)], "doc_id bigint, text string, source string")).where("source = 's' and epochs = 0")
    taken = Counter(r.doc_id % 2 for r in sizes.where("chosen").collect())
    assert not taken or taken[1] > taken[0]


# Classifiers


def test_quality_rules(spark, docs, rows, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    found = {r.doc_id: r for r in quality.quality_documents(table, truth).collect()}
    held = [(r.quality, found[r.doc_id].score) for r in truth.collect() if found[r.doc_id].held_out]
    assert auc(*zip(*held, strict=True)) > 0.85
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in found.values())
    out = quality.quality_documents(docs, labels_of(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.quality_documents(none, labels).count() == 0
    bare = quality.quality_documents(docs, labels.where("1 = 0")).collect()
    assert {r.score for r in bare} == {0.5}
    assert quality.keep_good(docs, labels.where("1 = 0")).columns == docs.columns


def test_compiled_rules_score_like_numpy(spark, docs):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.NAMES))) * 10
    rules = quality.learn(x, (x[:, 1] + x[:, 3] > 9).astype(int))
    assert 0 < len(rules.rules) < 24 * 14
    stats = quality.with_statistics(docs).select(*(f"__q_{n}" for n in quality.NAMES), rules.column().alias("s")).toPandas().to_numpy()
    assert np.allclose(rules.score(stats[:, :-1]), stats[:, -1])


def toxic_texts(n):
    bad = ("vile", "nasty", "horrid")
    rng = random.Random(4)
    texts = [prose(k, rng.randint(5, 200)).split() for k in range(n)]
    for k in range(0, n, 3):
        for _ in range(3):
            texts[k].insert(rng.randrange(len(texts[k])), rng.choice(bad) + rng.choice(["", ".", "!!"]))
    return [" ".join(t) for t in texts], [int(k % 3 == 0) for k in range(n)]


def test_network_learns_and_gradients_are_right():
    texts, y = toxic_texts(300)
    model = toxicity.train(texts[:200], y[:200])
    assert auc(y[200:], toxicity.Scorer(model).score(texts[200:])) > 0.9
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.standard_normal((6, 3, 6 * toxicity.HIDDEN))
    mask = np.arange(6)[:, None] < np.asarray([6, 4, 1])
    _, tape = toxicity.forward(p, x, mask, keep=True)
    g, dx = toxicity.backward(p, tape, np.ones(3))
    for name, at in (("u_ahead", (2, 5)), ("u_back", (1, 20)), ("attend", (3, 2)), ("attend_v", (1,)), ("out", (4,))):
        eps, moved = 1e-3, {k: v.copy() for k, v in p.items()}
        moved[name][at] += eps
        up = toxicity.forward(moved, x, mask).sum()
        moved[name][at] -= 2 * eps
        assert g[name][at] == pytest.approx((up - toxicity.forward(moved, x, mask).sum()) / (2 * eps), rel=0.05, abs=1e-3)
    y2 = x.copy()
    y2[3, 0, 10] += 1e-3
    assert dx[3, 0, 10] == pytest.approx((toxicity.forward(p, y2, mask).sum() - toxicity.forward(p, x, mask).sum()) / 1e-3, rel=0.1, abs=1e-3)


def test_windows_cover_every_word_and_memory_is_bounded(monkeypatch):
    for n in (0, 1, 16, 17, 31, 32, 33, 48, 100):
        starts = toxicity.windows_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))
    texts, y = toxic_texts(90)
    model = toxicity.train(texts, y, rounds=2)
    texts += ["", prose(1, 3000) + " vile vile vile"]
    whole = toxicity.Scorer(model).score(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 700)
    assert np.allclose(toxicity.Scorer(model).score(texts), whole, atol=1e-5)


def test_toxic_documents(spark, docs, rows, none):
    labels = labels_of(spark, rows)
    found = toxicity.toxic_documents(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in found)
    assert {r.score for r in toxicity.toxic_documents(docs, labels.where("1 = 0")).collect()} == {0.5}
    assert toxicity.toxic_documents(none, labels).count() == 0
