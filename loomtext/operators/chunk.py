"""Overlapping chunks: lines packed up to a size, long lines cut by a window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "array<struct<id:int,content:string,length:int,type:string>>"


def pack(text: str, most: int, overlap: int) -> Iterator[tuple[str, int, str]]:
    """content, length and type of each chunk; a packed chunk's length counts a newline after each line."""
    held: list[str] = []
    size = 0
    for line in text.split("\n"):
        cost = len(line) + 1
        if cost > most:
            if held:
                yield "\n".join(held), size, "segment"
            held, size = [], 0
            for at in range(0, len(line), most - overlap):
                yield line[at : at + most], len(line[at : at + most]), "long_line_fragment"
            continue
        if held and size + cost > most:
            yield "\n".join(held), size, "segment"
            # The last lines that fit the overlap begin the next chunk.
            keep, size = len(held), 0
            while keep and size + len(held[keep - 1]) + 1 <= overlap:
                keep -= 1
                size += len(held[keep]) + 1
            held = held[keep:]
        held.append(line)
        size += cost
    if held:
        yield "\n".join(held), size, "segment"


def check(most: int, overlap: int) -> None:
    if not 0 <= overlap < max(most, 1):
        raise ValueError(f"overlap must be from 0 to max_chars - 1: {overlap} of {most}")


def chunker(most: int = 2048, overlap: int = 200):  # noqa: ANN201
    """An Arrow function from texts to arrays of chunks; null and empty texts have none."""
    check(most, overlap)

    @F.pandas_udf(CHUNK)
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"id": i, "content": c, "length": n, "type": kind} for i, (c, n, kind) in enumerate(pack(x, most, overlap))] if x and most > 0 else [])

    return apply


def chunks(text: Column, most: int = 2048, overlap: int = 200) -> Column:
    """Chunks as an array. A text that fits in one chunk doesn't leave the JVM."""
    check(most, overlap)
    fits = F.length(text) + 1 <= most
    one = F.array(F.struct(F.lit(0).alias("id"), text.alias("content"), (F.length(text) + 1).cast("int").alias("length"), F.lit("segment").alias("type")))
    some = chunker(most, overlap)(F.when(~fits, text))
    empty = F.expr(f"cast(array() as {CHUNK})")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, empty).when(fits, one).otherwise(some)


def chunk(df: DataFrame, text: str = "text", most: int = 2048, overlap: int = 200) -> DataFrame:
    """One row per chunk: df's other columns, chunk_id, content, length, type."""
    names = [x for x in df.columns if x != text]
    # Outer explodes keep the planner from computing the arrays once more for a filter by their sizes.
    found = df.select(*names, F.explode_outer(chunks(F.col(text), most, overlap)).alias("c")).where(F.col("c").isNotNull())
    return found.select(*names, F.col("c.id").alias("chunk_id"), "c.content", "c.length", F.col("c.type").alias("chunk_type"))


def long_line_fragments(df: DataFrame, text: str = "text", most: int = 2048, overlap: int = 200) -> DataFrame:
    """The windows over lines that exceed a chunk, in the JVM: df's other columns, line_idx, frag_idx, content."""
    check(most, overlap)
    names = [x for x in df.columns if x != text]
    lines = df.select(*names, F.posexplode_outer(F.split(text, "\n", -1)).alias("line_idx", "line")).where(F.length("line") + 1 > most)
    starts = F.sequence(F.lit(0), F.length("line") - 1, F.lit(most - overlap))
    cut = lines.select(*names, "line_idx", "line", F.posexplode(starts).alias("frag_idx", "at"))
    return cut.select(*names, "line_idx", "frag_idx", F.substring("line", F.col("at") + 1, F.lit(most)).alias("content"))
