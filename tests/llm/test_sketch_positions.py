import random

import numpy as np

from loomtext.llm import neardup
from tests.llm.conftest import prose


def test_texts_too_long_for_positions_have_the_same_keys(monkeypatch):
    words = neardup.Words()
    texts = [words(prose(k, n)) for k, n in enumerate((5, 40, 300, 2000))]
    keys, minima, sizes = neardup.sketch(texts)
    monkeypatch.setattr(neardup, "VAST", 10)
    again, same, _ = neardup.sketch(texts)
    assert (keys == again).all() and (minima == same).all() and sizes.tolist() == [len(x) - 4 for x in texts]


def test_links_of_the_real_table(spark):
    """Of all pairs of texts of sf0.01 whose ordered similarity is 0.8 or more, by brute force, all are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    words = neardup.Words()
    seqs = [neardup.shingles(words(r.text or "")) for r in rows]
    sets = [set(x.tolist()) for x in seqs]
    holders: dict[int, list[int]] = {}
    for k, x in enumerate(sets):
        for y in x:
            holders.setdefault(y, []).append(k)
    own = {r.doc_id: r.class_id for r in neardup.document_classes(docs).collect()}
    links = found = 0
    for i, x in enumerate(sets):
        near = {j for y in random.Random(i).sample(sorted(x), max(1, len(x) // 4)) for j in holders[y] if j > i}
        for j in near:
            if len(x & sets[j]) >= 0.7 * len(x | sets[j]) and neardup.similarity(seqs[i], seqs[j]) >= neardup.LEAST:
                links += 1
                found += own[rows[i].doc_id] == own[rows[j].doc_id]
    assert links > 20 and found >= 0.98 * links, (links, found)
    assert np.mean([c <= d for d, c in own.items()]) == 1
