"""Exact top-k inner products by Fagin's threshold algorithm, block by block.

Vectors are integers. Candidates are packed into blocks; a block keeps, for each dimension, its
vectors in sorted order. For a query the lists are read in step, from their large end where the
query's component is positive and from their small end where it is negative, and each vector met is
scored whole. No vector not yet met can score more than the bound: the sum of the query's components
times the values at which the lists stand. Reading stops when the kth best score is above that bound.
A vector that ties with the kth score may still have a smaller id, so equality doesn't stop it.

Candidates stay where they are and aren't shuffled. Queries come to them in passes: a pass holds PASS_BYTES of
query vectors at most, which is what is broadcast, and reads all candidates once. In a task a query's kth score so far
is what later blocks must reach. Each task yields at most k rows per query, and the best k of those are the answer. So
what moves is the queries, to each worker, and k rows per query and task.

Scores are exact integers: products are summed as doubles where no sum can reach 2^53, as 64-bit integers where none can
reach 2^63, else as Python's integers; a score that doesn't fit in 64 bits is an error.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part;
vectors of different lengths aren't compared; a query isn't its own candidate, but an equal row with
the same id is; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import materialize

#: Candidates and queries in a block.
ROWS, QUERIES = 8192, 512
#: Bytes of the queries of a pass, which are broadcast.
PASS_BYTES = 64 << 20
#: Depth of the lists at the first look; it doubles.
FIRST = 64
PACKED = "n_dims int, block string, ids binary, rows binary, vectors binary"


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(doubles, lambda x: F.floor(x * scale).cast("bigint")))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """rows (row, id, vector array<bigint>) in blocks of at most `most` vectors of one length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(n: int) -> pa.RecordBatch:
            part = held.pop(n)
            row, ids, vectors = (np.asarray(x, np.int64) for x in zip(*part, strict=True))
            order = np.argsort(ids, kind="stable")
            values = [n, f"{row.min()}-{n}", ids[order].tobytes(), row[order].tobytes(), np.ascontiguousarray(vectors[order]).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int32()), *(pa.array([x]) for x in values[1:])], ["n_dims", "block", "ids", "rows", "vectors"])

        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for row, id_, low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held.setdefault(high - low, []).append((row, id_, flat[low:high]))
                if len(held[high - low]) >= most:
                    yield block(high - low)
        for n in list(held):
            yield block(n)

    return rows.select("row", "id", "vector").mapInArrow(pack, PACKED)


def kind_for(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The cheapest kind of number in which all products of integer vectors and queries are exact."""
    if not vectors.size or not queries.size:
        return np.float64
    largest = lambda x: max(int(x.max()), -int(x.min()))
    bound = largest(vectors) * largest(queries) * vectors.shape[1]
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def threshold_top(lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (id, score) among `vectors` but row `own`. lists[j]: positions, ascending in dimension j.

    Positions ascend with the ids, so that equal scores are told apart by position. Scores below `least` may be left out.
    """
    n = len(ids)
    dims = np.flatnonzero(query)
    up = query[dims] < 0
    query = query.astype(vectors.dtype)
    met, depth = np.zeros(n, bool), min(n, FIRST)
    if not len(dims):
        depth = n
    best_at, best = np.empty(0, np.int64), np.empty(0, vectors.dtype)
    done = 0
    while True:
        if len(dims):
            new = np.concatenate([lists[dims[up], done:depth].ravel(), lists[dims[~up], n - depth : n - done].ravel()])
        else:
            new = np.arange(done, depth)
        fresh = np.zeros(n, bool)
        fresh[new] = True
        fresh &= ~met
        met |= fresh
        at = np.flatnonzero(fresh)
        at = at[rows[at] != own]
        at = np.concatenate([best_at, at])
        scores = np.concatenate([best, vectors[at[len(best) :]] @ query])
        if len(scores) > k and scores.dtype != object:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= edge
            at, scores = at[keep], scores[keep]
        order = np.lexsort((at, -scores))[:k] if scores.dtype != object else np.asarray(sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k], np.int64)
        best_at, best = at[order], scores[order]
        if depth == n:
            break
        edges = np.where(up, vectors[lists[dims, depth - 1], dims], vectors[lists[dims, n - depth], dims])
        bound = edges @ query[dims]
        if len(best) == k and best[-1] > bound or least is not None and least > bound:
            break
        done, depth = depth, min(n, 2 * depth)
    return ids[best_at], best.astype(np.int64) if best.dtype != object else np.asarray([int(x) for x in best], np.int64)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows, vectors = (np.frombuffer(row[x], np.int64) for x in ("ids", "rows", "vectors"))
    return ids, rows, vectors.reshape(-1, row["n_dims"])


def passes(asked: DataFrame, most: int = PASS_BYTES) -> Iterator[list[dict]]:
    """Query blocks in lists of about `most` bytes; the driver holds one list and one partition of blocks at a time."""
    held, size = [], 0
    for row in asked.toLocalIterator():
        row = row.asDict()
        row = {x: bytes(v) if isinstance(v, bytearray) else v for x, v in row.items()}
        n = sum(len(row[x]) for x in ("ids", "rows", "vectors"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: row (unique), id, vector array<bigint>; a query's `row` is its own among the candidates."""
    spark = candidates.sparkSession
    blocks = materialize(packed(candidates.where("vector is not null"), ROWS), "topk-blocks")
    asked = materialize(packed(queries.where("vector is not null"), QUERIES), "topk-queries")

    def searched(part: list[dict]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)  # at most PASS_BYTES and a block

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
            for row in shared.value:
                asked.setdefault(row["n_dims"], []).append(_unpacked(row))
            best: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    block = batch.slice(at, 1).to_pylist()[0]
                    ids, rows, exact = _unpacked(block)
                    lists = np.ascontiguousarray(np.argsort(exact, axis=0, kind="stable").T)
                    kinds: dict[type, np.ndarray] = {}
                    for query_ids, query_rows, vectors in asked.get(block["n_dims"], ()):
                        kind = kind_for(exact, vectors)
                        if kind not in kinds:
                            kinds[kind] = exact.astype(kind)
                        for query_id, own, query in zip(query_ids.tolist(), query_rows.tolist(), vectors, strict=True):
                            so_far = best.get(own)
                            least = int(so_far[2][-1]) if so_far and len(so_far[2]) == k else None
                            found, scores = threshold_top(lists, kinds[kind], ids, rows, query, own, k, least)
                            if so_far:
                                found, scores = np.concatenate([so_far[1], found]), np.concatenate([so_far[2], scores])
                                order = np.lexsort((found, -scores))[:k]
                                found, scores = found[order], scores[order]
                            best[own] = query_id, found, scores
            out = [(own, query_id, found, scores) for own, (query_id, found, scores) in best.items()]
            for at in range(0, max(1, len(out)), 4096):
                part = out[at : at + 4096]
                n = [len(x[2]) for x in part]
                columns = [np.repeat(np.asarray([x[i] for x in part], np.int64), n) for i in (0, 1)] + [np.concatenate([np.empty(0, np.int64), *(x[i] for x in part)]) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_row", "query_id", "vec_id", "score"])

        found = blocks.mapInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # One pass is planned as it is; of several, each is written, so that no two passes' queries are held at once.
    out, last = [], None
    for part in passes(asked):
        if last is not None:
            out.append(materialize(last, "topk-pass"))
        last = searched(part)
    if last is None:
        return searched([])
    for part in out:
        last = last.unionByName(part)
    return last


def search_embeddings(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by `every`."""
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"), integers(F.col("embedding")).alias("vector"))
    rows = materialize(rows.where("id is not null and vector is not null"), "topk-rows")
    return top_k(rows, rows.where(F.col("id") % every == 0), k)


#: The same search in DuckDB.
SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
