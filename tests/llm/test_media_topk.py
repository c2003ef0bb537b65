import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import media, topk


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_images_hold_their_payloads(payload):
    padded = media.pad(payload)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(payload)
    image = media.encode(padded)
    assert media.decode(image).tobytes() == padded and image == media.encode(padded)
    assert len(media.feature(media.decode(image))) == 16


def filtered(rows, kinds):
    """Reference filters by their definitions."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(rows.shape[1]):
            a, b, c = (int(rows[y, x - 1]) if x else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
    return b"".join(out)


def image_of(stream, width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x") + media._chunk(b"IDAT", zlib.compress(stream)[:5]) + media._chunk(b"IDAT", zlib.compress(stream)[5:]) + media._chunk(b"IEND", b"")


def test_all_filters_are_undone():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (40, 9)).astype(np.uint8)
    kinds = rng.integers(0, 5, 40).tolist()
    assert (media.decode(image_of(filtered(rows, kinds), 9, 40)) == rows).all()


def test_broken_images_are_found():
    image = bytearray(media.encode(media.pad(b"some text" * 30)))
    for at in (0, 20, 45, len(image) // 2, len(image) - 2):
        broken = bytes(image[:at]) + bytes([image[at] ^ 1]) + bytes(image[at + 1 :])
        with pytest.raises(media.MediaError):
            media.decode(broken)
    with pytest.raises(media.MediaError):
        media.decode(bytes(image[:-5]))
    with pytest.raises(media.MediaError):
        media.decode(image_of(bytes([9]) + bytes(4), 4, 1))


def test_feature_is_of_low_frequencies():
    rng = np.random.default_rng(0)
    smooth = lambda: np.kron(rng.integers(40, 200, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    base = smooth()
    noisy = base.copy()
    noisy[::7, ::5] ^= 3
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert far(media.feature(base), media.feature(noisy)) < 6 < far(media.feature(base), media.feature(smooth()))


def test_documents(spark, docs, rows, none):
    found = {r.doc_id: r for r in media.document_media(docs).collect()}
    for row in rows:
        body = (row[1] or "").encode()
        padded = media.pad(body)
        r = found[row[0]]
        image = media.encode(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    assert media.document_media(docs).count() == len(rows) and media.document_media(none).count() == 0
    bad = spark.createDataFrame([(1, b"no image"), (2, None), (3, media.encode(media.pad(b"x")))], "k int, media binary")
    assert [r.feature is None for r in media.media_features(bad, errors="null").orderBy("k").collect()] == [True, True, False]


def brute_top(vectors, k=10, every=100):
    """query, rank, id, score; rows are (id, vector)."""
    ints = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, qv) in enumerate(ints):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for n, (i, v) in enumerate(ints) if n != at and len(v) == len(qv))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(6).astype(np.float32).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[5][1]) for k in range(30)] + [rows[100], rows[100], (800, [0.0] * 6), (900, [1.0, 2.0]), (901, [3.0, -1.0]), (902, [1.0, None, 2.0]), (1100, [float("nan")] * 6), (1200, [float("inf")] + [0.0] * 5), (1300, []), (1400, None), (None, rows[1][1])]
    return rows


@pytest.mark.parametrize(("first", "size"), [(64, 8192), (2, 50)])
def test_top_is_brute_force(spark, monkeypatch, first, size):
    monkeypatch.setattr(topk, "ROWS", size)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, row int").repartition(3)
    found = sorted(tuple(r) for r in topk.search_embeddings(df).collect())
    assert found == brute_top(rows)
    assert topk.search_embeddings(df.where("1 = 0")).count() == 0


def test_threshold_stops_early_and_is_exact():
    rng = np.random.default_rng(7)
    vectors_ = np.floor(rng.pareto(1.0, (4000, 4)) * 100)
    lists = np.argsort(vectors_, axis=0, kind="stable").T
    ids = rows = np.arange(4000)
    for query in ([1, 2, 3, 4], [5, 0, 0, -1], [0, 0, 0, 0], [-1, -1, -1, -1]):
        scores = vectors_ @ np.asarray(query)
        expected = sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:10]
        found, best = topk.threshold_top(lists, vectors_, ids, rows, np.asarray(query), -1, 10)
        assert list(zip((-best).tolist(), found.tolist(), strict=True)) == [(int(s), i) for s, i in expected]
