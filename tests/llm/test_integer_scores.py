import numpy as np
import pytest

from loomtext.llm import topk


def brute(vectors, queries, k):
    rows = []
    for q, query in queries:
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in vectors if i != q)
        rows += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(rows)


@pytest.mark.parametrize("size", [2**10, 2**29, 2**30])
def test_scores_are_integers(spark, size):
    """Products beyond 2^53 keep their last digits, in scores, order and ties."""
    rng = np.random.default_rng(3)
    vectors = [(i, (size + rng.integers(-3, 3, 3)).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, i, v) for i, v in vectors], "row bigint, id bigint, vector array<bigint>").repartition(4)
    found = sorted(tuple(r) for r in topk.top_k(df, df.where("id % 7 = 0"), 5).collect())
    assert found == brute(vectors, [x for x in vectors if x[0] % 7 == 0], 5)


def test_products_beyond_64_bits():
    vectors = np.asarray([[2**40, -(2**40)], [2**40, 1 - 2**40], [-(2**40), 2**40 + 1]])
    query = np.asarray([2**33, 2**33])
    assert topk.kind_for(vectors, query[None]) is object
    lists = np.argsort(vectors, axis=0, kind="stable").T
    found, scores = topk.threshold_top(lists, vectors.astype(object), np.arange(3), np.arange(3), query, -1, 2)
    assert found.tolist() == [1, 2] and scores.tolist() == [2**33, 2**33]
    with pytest.raises(OverflowError):
        topk.threshold_top(lists, vectors.astype(object), np.arange(3), np.arange(3), np.asarray([2**33, 0]), -1, 2)


def test_passes_give_what_one_pass_gives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.integers(-50, 50, 4).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, i, v) for i, v in vectors], "row bigint, id bigint, vector array<bigint>").repartition(4)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk.passes, "__defaults__", (700,))
    found = sorted(tuple(r) for r in topk.top_k(df, df.where("id % 5 = 0"), 4).collect())
    assert found == brute(vectors, [x for x in vectors if x[0] % 5 == 0], 4)
