"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its words in lower case without marks at their ends; its k-mers are shingles of K words,
labelled with their occurrence number so that repeats differ. For each of SKETCHES hash functions the
TAKEN smallest labelled shingles are kept in the order in which they stand in the text, and that
ordered tuple is a bucket key: texts that share many shingles in the same order, that is texts of high
edit similarity, share buckets. Further minima, a byte each, estimate similarity inside a bucket.

Candidates are verified exactly: the longest common subsequence of the two shingle sequences, by
bit-parallel dynamic programming inside the band that a similarity of LEAST leaves, over the number of
shingles in either. Classes are the connected components of the verified links.

Equal texts are one node. A bucket is streamed in blocks of at most MOST texts, sorted by their minima.
First a block proposes few pairs: its most central text with all its candidates, each text with its
nearest ones, and the bucket's first centre with the block's; these are verified by joins and give
classes. Then the texts of each bucket that holds several classes stand in the order of their classes
in blocks of about BLOCK, and every two blocks (and each with itself) that aren't of one and the same class
are streamed together with the texts' word hashes. Every pair of texts in different classes is verified
there: the shingles that both hold bound their similarity exactly, and pairs within that bound are
aligned; no estimate decides. Only links come out. So all pairs that share a bucket of any size are
judged, a large group of copies costs few pairs of blocks, and no task holds more than two blocks.

Defined results: null, empty and wordless texts are alike; texts of under K words are one shingle; a
null doc_id comes last; rows with equal doc_ids are documents of their own; an empty table, no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import materialize, sliced, texts_of

K, LEAST = 5, 0.8
SKETCHES, TAKEN, EXTRA = 16, 3, 64
#: Estimated similarity of a pair that is proposed first; three deviations of SKETCHES + EXTRA samples below LEAST.
LIKELY, MOST, NEAREST = 0.665, 1024, 3
#: Texts of a block in the second pass, and shingles counted by one product of matrices.
BLOCK, WIDE = 512, 4096
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LAST = 2**63 - 1
REMEMBERED = 400_000

U = np.uint64
POSITION = U((1 << 24) - 1)
#: Shingles of a text whose positions fit.
VAST = int(POSITION)
_rng = np.random.default_rng(2019)
XORS = _rng.integers(0, 1 << 63, SKETCHES + EXTRA, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 63, SKETCHES + EXTRA, dtype=np.uint64) * U(2) + U(1)
STEPS = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * U(2) + U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Words:
    """Hashes of a text's words; a worker remembers the words it has met."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        chunks = text.split()
        memo = self.memo
        new = {x for x in chunks if x not in memo}
        if len(memo) + len(new) > REMEMBERED:
            memo.clear()
            new = set(chunks)
        for x in new:
            word = x.lower().strip(MARKS)
            memo[x] = xxhash.xxh64_intdigest(word.encode()) | 1 if word else 0
        out = np.fromiter(map(memo.__getitem__, chunks), np.uint64, len(chunks))
        out = out[out != 0]
        return out if len(out) >= K else np.concatenate([out, np.full(K - len(out), 2, np.uint64)])


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the K-word shingles of a sequence of at least K words."""
    n = len(words) - K + 1
    return mixed(sum((words[i : i + n] * STEPS[i] for i in range(1, K)), words[:n] * STEPS[0]))


def labelled(flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of shingles with their occurrence numbers, so that those of one text differ. owner: the text of each shingle."""
    own = mixed(flat ^ mixed(owner.astype(np.uint64) + U(1)))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    at = np.arange(len(flat))
    occurrence = np.empty(len(flat), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mixed(flat + occurrence * U(0xD6E8FEB86659FD93))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each sequence of left shares with each of right: no common subsequence is longer."""
    rows, columns = len(left), len(right)
    sizes = np.asarray([len(x) for x in (*left, *right)])
    owner = np.repeat(np.arange(rows + columns), sizes)
    _, codes = np.unique(labelled(np.concatenate([*left, *right]), owner), return_inverse=True)
    cut = sizes[:rows].sum()
    a = np.bincount(codes[:cut], minlength=codes.max() + 1)
    b = np.bincount(codes[cut:], minlength=len(a))
    often = a * b > 64
    found = np.zeros(rows * columns, np.int64)
    # Shingles of few texts: each of their pairs is counted.
    some = ~often & (a > 0) & (b > 0)
    own, holder = codes[:cut][some[codes[:cut]]], owner[:cut][some[codes[:cut]]]
    holders = owner[cut:][np.argsort(codes[cut:], kind="stable")] - rows
    starts = np.cumsum(b) - b
    for at in range(0, len(own), 1 << 16):
        part = own[at : at + (1 << 16)]
        n = b[part]
        other = holders[np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found += np.bincount(np.repeat(holder[at : at + (1 << 16)], n) * columns + other, minlength=rows * columns)
    found = found.reshape(rows, columns)
    # Those of many: by products of matrices.
    place = np.full(len(a), -1)
    place[often] = np.arange(often.sum())
    places = place[codes]
    for at in range(0, int(often.sum()), WIDE):
        here = (places >= at) & (places < at + WIDE)
        held = np.zeros((rows + columns, min(WIDE, int(often.sum()) - at)), np.float32)
        held[owner[here], places[here] - at] = 1
        found += (held[:rows] @ held[rows:].T).astype(np.int64)
    return found


def sketch(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys (texts x SKETCHES), minima (texts x samples, bytes) and numbers of shingles."""
    sizes = np.asarray([len(x) - K + 1 for x in texts], np.int64)
    flat = np.concatenate([shingles(x) for x in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(texts)), sizes)
    position = (np.arange(len(flat)) - starts[owner]).astype(np.uint64)
    labels = labelled(flat, owner)
    position = np.minimum(position, POSITION)  # of texts that don't fit, the minima are taken one by one
    vast = np.flatnonzero(sizes > VAST).tolist()
    keys = np.empty((len(texts), SKETCHES), np.uint64)
    minima = np.empty((len(texts), SKETCHES + EXTRA), np.uint8)
    none = U(0xFFFFFFFFFFFFFFFF)
    for i in range(SKETCHES + EXTRA):
        y = (labels ^ XORS[i]) * FACTORS[i]
        y ^= y >> U(32)
        if i >= SKETCHES:
            minima[:, i] = (np.minimum.reduceat(y, starts) >> U(24)).astype(np.uint8)
            continue
        plain = y * U(0x9E3779B97F4A7C15) & ~POSITION
        y = plain | position
        taken = []
        for k in range(TAKEN):
            low = np.minimum.reduceat(y, starts)
            taken.append(low)
            if k + 1 < TAKEN:
                there = low != none
                y[(starts + (low & POSITION).astype(np.int64))[there]] = none
        best = np.stack(taken, axis=1)
        minima[:, i] = (best[:, 0] >> U(24)).astype(np.uint8)
        place = np.argsort(np.where(best == none, none, best & POSITION), axis=1, kind="stable")
        ordered = np.take_along_axis(best & ~POSITION, place, axis=1)
        key = np.full(len(texts), U(i + 1))
        for k in range(TAKEN):
            key = mixed(key * U(0x9E3779B97F4A7C15) + ordered[:, k])
        keys[:, i] = key
        for text in vast:
            own = plain[starts[text] : starts[text] + sizes[text]]
            least = np.argpartition(own, TAKEN)[:TAKEN]
            key = np.asarray([U(i + 1)])
            for x in own[np.sort(least)]:
                key = mixed(key * U(0x9E3779B97F4A7C15) + x)
            keys[text, i] = key[0]
    return keys, minima, sizes


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of a and b by paths within `band` of the diagonal."""
    low = 0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    low = n if same.all() else int(same.argmin())
    a, b = a[low:], b[low:]
    n = min(len(a), len(b))
    if not n:
        return low
    same = a[::-1][:n] == b[::-1][:n]
    high = n if same.all() else int(same.argmin())
    if high:
        a, b = a[: len(a) - high], b[: len(b) - high]
    if not len(a) or not len(b):
        return low + high
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    size = len(a)
    state = (1 << size) - 1
    for j, x in enumerate(b.tolist()):
        matches = where.get(x)
        if not matches:
            continue
        left, right = max(0, j - band), min(size, j + band + 1)
        if left >= right:
            continue
        mask = (1 << (right - left)) - 1
        part = state >> left & mask
        hit = part & (matches >> left & mask)
        if hit:
            part = ((part + hit) | (part - hit)) & mask
            state = state & ~(mask << left) | part << left
    return low + high + size - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Ordered similarity of two shingle sequences: common ones over those of either; 0 where it must be below `least`."""
    need = math.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9)  # floats may stand just over the exact bound
    if min(len(a), len(b)) < need or min(np.isin(a, b).sum(), np.isin(b, a).sum()) < need:
        return 0.0
    band = max(len(a), len(b)) - need + 1  # a path that leaves it skips too many
    found = common(a, b, band)
    return found / (len(a) + len(b) - found)


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc, node, n, buckets, minima of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches, 512):
            if not batch.num_rows:
                continue
            texts = texts_of(batch, 1)
            keys, minima, sizes = sketch([words(x) for x in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * SKETCHES, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            nodes = [hashlib.md5(x.encode()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes), lists, pa.array([x.tobytes() for x in minima], pa.binary())], ["doc", "node", "n", "buckets", "minima"])

    chosen = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), "text")
    return chosen.mapInArrow(run, "doc bigint, node binary, n bigint, buckets array<bigint>, minima binary")


def alike(n: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """Estimated similarity of each two texts of a block where they are candidates, else 0."""
    near = np.stack([(minima == row).mean(axis=1, dtype=np.float32) for row in minima])
    fits = np.minimum.outer(n, n) >= LEAST * np.maximum.outer(n, n) - 1e-9
    np.fill_diagonal(fits, False)
    return np.where((near >= LIKELY) & fits, near, 0)


def propose(good: np.ndarray) -> tuple[int, set[tuple[int, int]]]:
    """The block's centre, and few pairs of positions that hold its candidates together."""
    m = len(good)
    centre = int(good.sum(axis=1).argmax())
    pairs = {(centre, int(x)) for x in np.flatnonzero(good[centre])}
    nearest = min(NEAREST, m - 1)
    some = np.argpartition(-good, nearest - 1, axis=1)[:, :nearest].ravel()
    rows = np.repeat(np.arange(m), nearest)
    keep = good[rows, some] > 0
    pairs.update(zip(rows[keep].tolist(), some[keep].tolist(), strict=True))
    return centre, {(min(x), max(x)) for x in pairs}


def _ordered(groups: DataFrame, columns: list[str]) -> DataFrame:
    spark = groups.sparkSession
    return groups.select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "minima")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple]]]:
    """Blocks of at most MOST rows of one bucket, without the bucket; True with a bucket's first block."""
    held: list[tuple] = []
    last, begins = None, True
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for bucket, *row in zip(*columns, strict=True):
            if held and (bucket != last or len(held) == MOST):
                yield begins, held
                held, begins = [], bucket != last
            last = bucket
            held.append(tuple(row))
    if held:
        yield begins, held


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray([x[1] for x in rows]), np.stack([np.frombuffer(x[2], np.uint8) for x in rows])


def _pairs(pairs: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def candidates(groups: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) that the blocks of the buckets propose. groups: bucket, node, n, minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        first: tuple | None = None
        for begins, rows in _blocks(batches):
            rows = rows if begins or first is None else [first, *rows]
            first = None if begins else first
            if len(rows) > 1:
                centre, pairs = propose(alike(*_arrays(rows)))
                out.update((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in pairs)
                first = first or rows[centre]
            if len(out) > 50_000:
                yield _pairs(out)
                out.clear()
        yield _pairs(out)

    return _ordered(groups, ["bucket", "node", "n", "minima"]).mapInArrow(run, "a binary, b binary").distinct()


def pairs_of_blocks(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, i, j (blocks), block, node, label: the texts of each two blocks of a bucket that hold several classes.

    groups: bucket, node. Of buckets of the same texts one stays.
    """
    labelled = groups.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("texts"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mix"))
    several = each.where("low <> high").groupBy("texts", "total", "mix").agg(F.min("bucket").alias("bucket")).select("bucket")
    # Classes stand one after the other, and a text somewhere in its class: only counts of classes are ordered in a window.
    chosen = labelled.join(several, "bucket")
    sizes = chosen.groupBy("bucket", "label").agg(F.count("*").alias("members"))
    before = F.coalesce(F.sum("members").over(Window.partitionBy("bucket").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("members"))
    placed = chosen.join(sizes.withColumn("before", before), ["bucket", "label"]).select("bucket", "node", "label", F.floor(place / BLOCK).cast("int").alias("block"))
    placed = materialize(placed, "omh-placed")
    ends = placed.groupBy("bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    first, second = (ends.select("bucket", F.col("block").alias(x), F.col(y).alias(y)) for x, y in (("i", "low"), ("j", "high")))
    pairs = first.join(second, "bucket").where("i <= j and low <> high").select("bucket", "i", "j")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return placed.join(sides, ["bucket", "block"]).select("bucket", "i", "j", "block", "node", "label")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple]]]:
    """block, node, label and words of each two blocks; True where they are one."""
    held: list[tuple] = []
    last = None
    for batch in sliced(batches, 2 * BLOCK):
        for bucket, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if held and (bucket, i, j) != last:
                yield last[1] == last[2], held
                held = []
            last = bucket, i, j
            held.append(tuple(row))
    if held:
        yield last[1] == last[2], held


def links_between(groups: DataFrame) -> DataFrame:
    """Verified pairs (a < b) of texts that have different labels. groups: as from pairs_of_blocks, with words.

    The shingles that two texts share bound their similarity; pairs within that bound are tried from the most
    alike down, but for those that earlier links of the two blocks have joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried: dict[tuple[bytes, bytes], bool] = {}
        for one, rows in _groups(batches):
            own = np.unique([x[2] for x in rows], return_inverse=True)[1]
            if len(rows) == 2:
                low, high = sorted(x[1] for x in rows)
                if (low, high) in tried:
                    continue
            sequences = [shingles(np.frombuffer(x[3], np.uint32).astype(np.uint64)) for x in rows]
            n = np.asarray([len(x) for x in sequences])
            if len(rows) == 2:
                i, j = np.asarray([0]), np.asarray([1])
            else:
                # Sorted by block: the first block's texts against the second's, or all against all.
                cut = 0 if one else sum(x[0] == rows[0][0] for x in rows)
                shared = overlaps(sequences[: cut or None], sequences[cut:])
                total = n[: cut or None, None] + n[None, cut:] - shared
                close = (shared / total >= LEAST) & (own[: cut or None, None] != own[None, cut:])
                i, j = np.nonzero(np.triu(close, 1) if one else close)
                best = np.argsort(-(shared / total)[i, j], kind="stable")
                i, j = i[best], j[best] + cut
            out = set()
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if own[x] == own[y]:
                    continue
                a, b = rows[x][1], rows[y][1]
                pair = (min(a, b), max(a, b))
                if pair not in tried:
                    tried[pair] = similarity(sequences[x], sequences[y]) >= LEAST
                if tried[pair]:
                    out.add(pair)
                    own[own == own[y]] = own[x]
            if len(tried) > 500_000:
                tried.clear()
            if out:
                yield _pairs(out)
        yield _pairs(set())

    spark = groups.sparkSession
    keys = ["bucket", "i", "j"]
    dealt = groups.select(*keys, "block", "node", "label", "words").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "block")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs whose similarity is LEAST or more. words: node and its word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            kept, last, left = [], None, None
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if x is not last:
                    last, left = x, shingles(np.frombuffer(x, np.uint32).astype(np.uint64))
                if similarity(left, shingles(np.frombuffer(y, np.uint32).astype(np.uint64))) >= LEAST:
                    kept.append(k)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    right = words.select(F.col("node").alias("b"), F.col("words").alias("right"))
    left = words.select(F.col("node").alias("a"), F.col("words").alias("left"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label of each node that has an edge: label is the smallest node of its component.

    Large-star and small-star steps in turn until no edge changes; each step is an aggregation with
    partial sums and a join, and its result is written to the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = materialize(small.distinct(), "star")
        if (after := state(now)) == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, node) of each document, and (node, label) of the texts that have verified links."""
    found = materialize(sketches(docs), "omh-sketches")
    nodes = materialize(found.groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("minima").alias("minima")), "omh-nodes")
    buckets = nodes.select("node", F.explode("buckets").alias("bucket"))
    # Counted before they are shuffled, and joined by a key that is one row on its side, so that a large bucket can be split.
    several = buckets.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1").select("bucket")
    shared = buckets.join(several.hint("merge"), "bucket").select("bucket", "node")
    groups = materialize(shared.join(nodes.select("node", "n", "minima"), "node"), "omh-groups")

    tried = materialize(candidates(groups), "omh-pairs")
    wanted = groups.select("node").distinct()
    wanted = materialize(wanted.join(nodes.select("node", "doc"), "node"), "omh-wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(x).astype(np.uint32).tobytes() for x in texts_of(batch, 1)], pa.binary())], ["node", "words"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), node_of(F.col("text")).alias("node"), "text")
    # These texts grow with the corpus: not a side to broadcast, at any size.
    texts = texts.join(wanted.hint("merge"), ["node", "doc"], "left_semi").select("node", "text").mapInArrow(hashed, "node binary, words binary")
    words = materialize(texts.groupBy("node").agg(F.first("words").alias("words")), "omh-words")
    links = materialize(verified(tried, words), "omh-links")
    labels = materialize(components(links), "omh-labels")
    more = materialize(links_between(pairs_of_blocks(groups, labels).join(words, "node")), "omh-links")
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "omh-labels")
    return found.select("doc", "node"), labels


def document_classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), n_copies (documents of its text), kept (whether it is the one that stays)."""
    own, labels = classes(docs)
    texts = own.groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("n_copies")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = texts.groupBy("label").agg(F.min("first").alias("class_id"))
    out = own.join(texts.join(heads, "label").select("node", "class_id", "n_copies"), "node")
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(null("doc").alias("doc_id"), null("class_id").alias("class_id"), "n_copies", (F.col("doc") == F.col("class_id")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id (and, among its rows, one)."""
    names = docs.columns
    own, labels = classes(docs)
    texts = own.groupBy("node").agg(F.min("doc").alias("first")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = texts.groupBy("label").agg(F.min(F.struct("first", "node")).alias("head")).select(F.col("head.first").alias("__doc"), F.col("head.node").alias("__node"))
    keyed = docs.select(F.struct(*names).alias("__row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("__doc"), node_of(F.col("text")).alias("__node"))
    return keyed.join(heads, ["__doc", "__node"]).groupBy("__doc", "__node").agg(F.first("__row").alias("__row")).select("__row.*")
