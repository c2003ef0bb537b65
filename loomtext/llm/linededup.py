"""Line dedup by a log-template tree: lines whose template recurs across documents are dropped.

A line of at least `LEAST` tokens is parsed by a tree of fixed depth: first by its number of tokens,
then by its DEPTH leading tokens; tokens that hold a digit count as a variable field there. In a leaf,
lines that agree in SIMILAR of their positions (of up to SHORT tokens: in all) share a template, whose differing positions become
variable fields. A template that occurs in two or more documents keeps its lines in the first document
and loses them in all others, so no content is lost altogether. Documents are in the order of their ids; rows
of one id whose texts differ are documents of their own, in the order of a hash of the text.

Lines that are equal but for tokens with digits are merged where they are read, before anything is
shuffled, so a line that a third of all documents share reaches its leaf once per input batch. Leaves
are streamed in sorted order, a leaf's distinct lines in blocks of at most MOST that meet the templates of
all its earlier lines; so the result is that of all lines at once, whatever the leaf's size. A task holds
a leaf's templates, with its distinct tokens and the documents of each, and a hash of each line.

Defined results: a null text stays null and an empty one empty; blank lines stay; rows that are equal in
doc_id and text are one document and lose the same lines; null doc_ids come last; an empty table gives no rows;
extra columns of any name stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import partitions_for, sliced

LEAST, DEPTH, SIMILAR, MOST = 1, 3, 0.8, 1024
#: Lines of up to so many tokens share a template only where all their tokens are equal.
SHORT = 4
FIELD = "<*>"
#: A token with a digit, the same in Python and Java.
VARIABLE = r"(?<![^ \t\n])[^ \t\n0-9]*+[0-9][^ \t\n]*+"
_VARIABLE = re.compile(VARIABLE)
#: Order of a null id: after all others.
LAST = 2**63 - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_hash(line: str) -> int:
    """Spark's xxhash64 of the line."""
    return signed(xxhash.xxh64_intdigest(line.encode(), 42))


def masked(text: str) -> str:
    """text with FIELD for each token that holds a digit."""
    return _VARIABLE.sub(FIELD, text)


def leaf_of(tokens: list[str]) -> int:
    return signed(xxhash.xxh64_intdigest(f"{len(tokens)} {' '.join(tokens[:DEPTH])}".encode()))


class Leaf:
    """Templates of the lines of one leaf, which all have one number of tokens; lines come in any number of blocks.

    Greedy, in order: a line joins the template that it agrees with most, if that is enough.
    """

    def __init__(self, similar: float = SIMILAR) -> None:
        self.similar, self.count = similar, 0
        self.code: dict[str, int] = {FIELD: 0}
        self.templates = np.empty((0, 0), np.int32)

    def add(self, lines: list[list[str]]) -> list[int]:
        """Template number of each line."""
        code = self.code
        coded = np.asarray([[code.setdefault(x, len(code)) for x in line] for line in lines], np.int32).reshape(len(lines), -1)
        n = coded.shape[1]
        own = []
        for row in coded:
            if self.count:
                templates = self.templates[: self.count]
                same = (templates == row).sum(axis=1) + ((templates == 0) & (row != 0)).sum(axis=1) * 0.5
                best = int(same.argmax())
                if same[best] >= (n if n <= SHORT else self.similar * n):
                    templates[best] = np.where(templates[best] == row, row, 0)
                    own.append(best)
                    continue
            if self.count == len(self.templates):
                more = np.empty((max(16, 2 * self.count), n), np.int32)
                if self.count:
                    more[: self.count] = self.templates
                self.templates = more
            self.templates[self.count] = row
            own.append(self.count)
            self.count += 1
        return own

    def names(self) -> list[list[str]]:
        names = list(self.code)
        return [[names[x] for x in t] for t in self.templates[: self.count].tolist()]


def merge_block(lines: list[list[str]], similar: float = SIMILAR) -> tuple[list[int], list[list[str]]]:
    """Template number of each line and the templates; all lines have one number of tokens."""
    leaf = Leaf(similar)
    return leaf.add(lines), leaf.names()


def _key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells documents apart and orders them: the id (null: LAST) and a hash of the text."""
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text)).alias("own")]


ENDS = "first_doc bigint, first_own bigint, last_doc bigint, last_own bigint"


def distinct_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """leaf, line (masked), first and last document: one row for each distinct line of a batch of documents."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            found: dict[str, list] = {}
            for doc, own, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                key = (doc, own)
                for line in masked(body).split("\n") if body else ():
                    at = found.get(line)
                    if at is None:
                        found[line] = [key, key]
                    elif key < at[0]:
                        at[0] = key
                    elif key > at[1]:
                        at[1] = key
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for line, (low, high) in found.items():
                if len(tokens := line.split()) >= LEAST:
                    for column, value in zip(out, (leaf_of(tokens), line, *low, *high), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["leaf", "line", "first_doc", "first_own", "last_doc", "last_own"])

    return docs.select(*_key(doc_id, text), F.col(text).alias("text")).mapInArrow(split, f"leaf bigint, line string, {ENDS}")


Line = list  # [line, first document, last document]


def _leaf(blocks: Iterator[list[Line]]) -> Iterator[tuple[int, str, int, int]]:
    """line_hash, template, first document of each line of a leaf whose template recurs; blocks are not kept."""
    leaf, ends = Leaf(), []
    lines: list[tuple[int, int]] = []
    for block in blocks:
        for (line, low, high), k in zip(block, leaf.add([x[0].split() for x in block]), strict=True):
            if k == len(ends):
                ends.append([low, high])
            ends[k][0], ends[k][1] = min(ends[k][0], low), max(ends[k][1], high)
            lines.append((line_hash(line), k))
    templates = leaf.names()
    for line, k in lines:
        if ends[k][0] != ends[k][1]:
            yield line, " ".join(templates[k]), *ends[k][0]


def _blocks(lines: Iterator[tuple]) -> Iterator[list[Line]]:
    """A leaf's distinct lines in blocks of at most MOST; rows (leaf, line, first, last) in the order of their lines."""
    held: list[Line] = []
    for _, line, *ends in lines:
        low, high = tuple(ends[:2]), tuple(ends[2:])
        if held and held[-1][0] == line:
            held[-1][1], held[-1][2] = min(held[-1][1], low), max(held[-1][2], high)
            continue
        if len(held) == MOST:
            yield held
            held = []
        held.append([line, low, high])
    yield held


def recurring(docs: DataFrame) -> DataFrame:
    """line_hash (of the masked line), template, first document of each line whose template is in two documents or more."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["line_hash", "template", "first_doc", "first_own"])

        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        out = []
        for _, lines in groupby(rows, itemgetter(0)):
            for row in _leaf(_blocks(lines)):
                out.append(row)
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    lines = distinct_lines(docs)
    lines = lines.repartition(partitions_for(docs), "leaf").sortWithinPartitions("leaf", "line")
    return lines.mapInArrow(parse, "line_hash bigint, template string, first_doc bigint, first_own bigint")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc (LAST: null) and own, a document's key, and the positions of the lines that it loses; only documents that lose some.

    The lines of a very common line's hash are one key of the join: the planner splits it, as the other side has one row for it.
    """
    # An outer explode: before a plain one the planner filters by the array's size, which masks and splits every text twice.
    lines = docs.select(*_key(), F.posexplode_outer(F.split(F.regexp_replace("text", VARIABLE, FIELD), "\n")).alias("pos", "line")).where("pos is not null")
    own = lines.select("doc", "own", "pos", F.xxhash64("line").alias("line_hash"))
    first = recurring(docs).select("line_hash", "first_doc", "first_own")
    found = own.join(first, "line_hash").where((F.col("doc") != F.col("first_doc")) | (F.col("own") != F.col("first_own")))
    return found.groupBy("doc", "own").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _applied(docs: DataFrame) -> DataFrame:
    """`row` (docs' columns), `text`, `dropped` (empty where nothing is) and `kept`, the text that stays."""
    # The text is in the row only, so that it is shuffled once.
    keyed = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), *_key())
    joined = keyed.join(dropped_lines(docs), ["doc", "own"], "left").withColumn("text", F.col("row.text"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("dropped", i)), "\n")
    return joined.select("row", "text", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def document_lines(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, dropped (positions), text (what stays)."""
    out = _applied(docs.select("doc_id", "text"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.select("row.doc_id", F.greatest(lines, F.lit(0)).alias("n_lines"), F.size("dropped").alias("n_dropped"), "dropped", F.col("kept").alias("text"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs in their columns, texts without the recurring lines; n_chars follows where it is a column."""
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return _applied(docs).select(*(new.get(x, F.col("row")[x]).alias(x) for x in docs.columns))
