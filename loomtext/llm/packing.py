"""Best-fit packing: minimum bin slack over a histogram of piece lengths.

A document's token ids (and its end id) are cut into pieces of at most `capacity` ids; pieces are
placed in sequences of that capacity. Minimum bin slack fills one sequence after another: with the
longest available length as its seed, a bitset subset-sum dynamic programme over the available
lengths finds the fullest feasible combination, which is then removed. The programme sees only how
many pieces there are of each length, at most `capacity` numbers whatever the corpus holds; a
combination is removed as often as its lengths are available, and the placed lengths come back as
runs: "the next m*k pieces of length L go to sequences s, s+1, ... at this offset". Pieces find
their run by their rank within their length.

Defined results: a null or empty text is one piece of the end id alone; rows that are equal in all
columns are packed as often as they occur; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import extended, materialize, sliced, texts_of
from loomtext.llm.tokens import default_path, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces of one length that are ranked in one window group, about.
GROUP = 20_000
#: Bytes that the runs may have when they are sent to the workers.
MOST_RUN_BYTES = 64_000_000
RANK_BITS = 40


def pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids themselves)."""
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            docs_at = 0
            for ids, at in encoder(path).flat(texts_of(batch, 1), end_id):
                sizes = np.diff(at)
                n = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                low = (at[owner] + start).tolist()
                body = memoryview(np.ascontiguousarray(ids)).cast("B")
                parts = [body[4 * a : 4 * (a + b)] for a, b in zip(low, length.tolist(), strict=True)]
                columns = [batch.column(0).slice(docs_at, len(sizes)).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array([x.tobytes() for x in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
                docs_at += len(sizes)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def fullest(counts: dict[int, int], order: list[int], capacity: int) -> list[tuple[int, int]]:
    """The seed order[0] and the combination of the others that fills the sequence best: (length, times).

    Bit s of `reach` says that some combination sums to s; a length that is there c times is
    entered as 1, 2, 4, ... copies, so that each number of copies up to c is a sum of entries.
    """
    room = capacity - order[0]
    reach, entered, mask = 1, [], (1 << (room + 1)) - 1
    for length in order:
        if length > room:
            continue
        left = min(counts[length] - (length == order[0]), room // length)
        times = 1
        while left > 0 and not reach >> room & 1:
            k = min(times, left)
            grown = (reach | reach << (length * k)) & mask
            if grown != reach:
                entered.append((length, k, reach))
                reach = grown
            left, times = left - k, 2 * times
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {order[0]: 1}
    for length, k, before in reversed(entered):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= length * k
    return sorted(taken.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Runs (key, first sequence, pieces in a sequence, offset of the first) and the number of sequences.

    key is length << RANK_BITS | first rank, ascending.
    """
    counts = {k: v for k, v in histogram.items() if v}
    used = dict.fromkeys(counts, 0)
    order = sorted(counts, reverse=True)
    runs, sequence = [], 0
    while order:
        bin_ = fullest(counts, order, capacity)
        times = min(counts[length] // k for length, k in bin_)
        offset = 0
        for length, k in bin_:
            runs.append((length << RANK_BITS | used[length], sequence, k, offset))
            used[length] += k * times
            counts[length] -= k * times
            offset += k * length
        sequence += times
        order = [x for x in order if counts[x]] if any(not counts[x] for x, _ in bin_) else order
    runs.sort()
    key, first, k, offset = (np.asarray(x, np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 4))
    return key, first, k, offset, sequence


def pack(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """found, rows with a `length` of 1 to capacity, with sequence_id and offset appended.

    The lengths' histogram (at most `capacity` rows) is all that the driver gathers. Ranks within a
    length are counted in groups of about GROUP rows, so that a length that a third of all pieces
    have is not one task.
    """
    spark = found.sparkSession
    found = materialize(found, "pieces")
    names = found.columns
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    if bad := [x for x in histogram if x is None or not 0 < x <= capacity]:
        raise ValueError(f"piece lengths must be from 1 to {capacity}: {bad[:3]}")
    key, first, times, start, _ = minimum_bin_slack(histogram, capacity)
    if sum(x.nbytes for x in (key, first, times, start)) > MOST_RUN_BYTES:
        raise ValueError("the runs exceed the size that may be broadcast")
    shared = spark.sparkContext.broadcast((key, first, times, start))

    salts = spark.createDataFrame([(k, -(-v // GROUP)) for k, v in histogram.items()], "__length bigint, __salts bigint")
    mixed = F.xxhash64(*names)
    salted = found.join(F.broadcast(salts), F.col("length") == F.col("__length")).withColumn("__salt", F.pmod(mixed, F.col("__salts"))).drop("__length", "__salts")
    sizes = salted.groupBy(F.col("length").alias("__length"), F.col("__salt").alias("__group")).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("__length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__length", "__group", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*names)) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__group")))
    ranked = ranked.select(*names, (F.col("__base") + F.col("__rank")).alias("__rank"))
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, times, start = shared.value
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = length << RANK_BITS | batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.searchsorted(key, wanted, side="right") - 1
            step = wanted - key[run]
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array(first[run] + step // times[run]), pa.array(start[run] + step % times[run] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = extended(found.schema, "sequence_id bigint, offset bigint")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity, tokenizer, end_id), capacity)


def sequences(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, n_pieces, doc_ids, ids (little-endian unsigned 32-bit)."""
    packed = pack(pieces(docs, capacity, tokenizer, end_id, keep_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    whole = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("n_ids"), F.size("parts").alias("n_pieces"), F.col("parts.doc_id").alias("doc_ids"), whole.alias("ids"))
