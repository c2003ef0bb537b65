"""Structured blocks of a text (headings, paragraphs, lists, code, questions, reasoning) and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import rx
from loomtext.functions.text import inline_formatting

#: Kinds of blocks; six of them occur in parsed texts.
KINDS = ("heading", "paragraph", "code_block", "list", "question", "thinking", "answer", "quote", "table", "link", "image", "instruction", "context", "example", "metadata", "system", "user")
PARSED = KINDS[:6]
LEVELS = ("maximum", "high", "medium", "low", "minimal")
BLOCK = "struct<type:string,content:string,level:int,language:string,list_type:string,items:array<string>,length:int,line_count:int>"
_BULLET, _NUMBER, _HEADING = re.compile(r"\s*[-*+]\s(.*)", re.S), re.compile(r"\s*\d+\.\s(.*)", re.S), re.compile(r"(#{1,6})\s+(.*)")


def _block(kind: str, **fields: object) -> dict:
    return dict.fromkeys(("type", "content", "level", "language", "list_type", "items", "length", "line_count")) | {"type": kind} | fields


def _prose(lines: list[str]) -> dict:
    body = "\n".join(lines).strip()
    return _block("paragraph", content=body, length=len(body), line_count=len(lines))


def _list(lines: list[str]) -> dict:
    numbered = [bool(_NUMBER.match(x)) for x in lines]
    items = [(_NUMBER.match(x) if n else _BULLET.match(x))[1].strip() for x, n in zip(lines, numbered, strict=True)]
    return _block("list", list_type="ordered" if any(numbered) else "unordered", items=items)


def _until(lines: list[str], at: int, test) -> int | None:  # noqa: ANN001
    return next((k for k in range(at + 1, len(lines)) if test(lines[k])), None)


def scan(text: str, strict: bool) -> Iterator[dict]:
    """Blocks in order. strict drops what the plain rules lose (unclosed fences, inline reasoning, headings without a space); otherwise it becomes prose."""
    lines, held, kind, at = text.split("\n"), [], "", 0

    def flush() -> Iterator[dict]:
        nonlocal held, kind
        if held:
            yield _list(held) if kind == "list" else _prose(held)
        held, kind = [], ""

    while at < len(lines):
        line = lines[at]
        body, lower, lost = line.strip(), line.lower(), False
        if body.startswith("```"):
            yield from flush()
            if (end := _until(lines, at, lambda x: x.strip().startswith("```"))) is not None:
                code = "\n".join(lines[at + 1 : end])
                opened = re.match(r"```(\w+)?", line)
                yield _block("code_block", content=code, language=(opened[1] or "") if opened else "", length=len(code), line_count=end - at - 1)
                at = end
            else:
                lost = True
        elif body.startswith("#"):
            yield from flush()
            if m := _HEADING.match(line):
                yield _block("heading", content=m[2].strip(), level=len(m[1]))
            else:
                lost = True
        elif _BULLET.match(line) or _NUMBER.match(line):
            if kind != "list":
                yield from flush()
            kind = "list"
            held.append(line)
        elif "<thinking>" in lower or "<thought>" in lower:
            yield from flush()
            end = _until(lines, at, lambda x: "</thinking>" in x.lower()) if "<thinking>" in lower else None
            if end is not None:
                inner = "\n".join(lines[at + 1 : end]).strip()
                yield _block("thinking", content=inner, length=len(inner))
                at = end
            else:
                lost = True
        elif body.endswith("?"):
            yield from flush()
            yield _block("question", content=body)
        elif body:
            if kind != "paragraph":
                yield from flush()
            kind = "paragraph"
            held.append(line)
        else:
            yield from flush()
        if lost and not strict:
            kind = "paragraph"
            held.append(line)
        at += 1
    yield from flush()


def parser(strict: bool = False):  # noqa: ANN201
    """An Arrow function from texts to arrays of blocks."""

    @F.pandas_udf(f"array<{BLOCK}>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else list(scan(x, strict)))

    return apply.asNondeterministic()  # so that the planner keeps one call where several expressions use the blocks


def fidelity_filter(blocks: Column, level: str) -> Column:
    """The two lowest levels drop reasoning and metadata."""
    if level not in LEVELS:
        raise ValueError(f"fidelity must be one of {LEVELS}: {level}")
    return F.filter(blocks, lambda b: ~b["type"].isin("thinking", "metadata")) if level in LEVELS[3:] else blocks


def of_kind(blocks: Column, *kinds: str) -> Column:
    return F.filter(blocks, lambda b: b["type"].isin(*kinds))


def fuse(*blocks: Column) -> Column:
    """The blocks of several texts, one after the other."""
    return F.concat(*blocks)


def parse(df: DataFrame, text: str = "text", level: str = "high", strict: bool = False) -> DataFrame:
    """df with `blocks` and `statistics` of its texts."""
    out = df.withColumn("blocks", fidelity_filter(parser(strict)(F.col(text)), level))
    return out.withColumn("statistics", statistics(F.col("blocks")))


def kind_counts(blocks: Column) -> Column:
    """A count for each of KINDS."""
    return F.struct(*(F.size(of_kind(blocks, k)).alias(k) for k in KINDS))


#: A document of blocks as JSON: version, fidelity, metadata, blocks, statistics.
VERSION = "1.0"


def to_document(blocks: Column, level: str = "high", metadata: Column | None = None) -> Column:
    """The JSON of a document of blocks, filtered by the level. metadata: a map of strings."""
    kept = fidelity_filter(blocks, level)
    given = metadata if metadata is not None else F.expr("cast(map() as map<string,string>)")
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(level).alias("fidelity"), given.alias("metadata"), kept.alias("blocks"), F.struct(F.size(kept).alias("total_blocks"), kind_counts(kept).alias("block_types"), statistics(kept)["total_length"].alias("total_length")).alias("statistics")))


def from_document(json: Column) -> Column:
    """version, fidelity, metadata and blocks of a document's JSON; null if it isn't one."""
    read = F.from_json(json, f"version string, fidelity string, metadata map<string,string>, blocks array<{BLOCK}>")
    return F.when(read["blocks"].isNotNull(), read)


def compress(blocks: Column, most: int) -> Column:
    """The blocks that fit in `most` characters, the kinds that say most in the fewest first: headings, code, lists, questions, then the others; in their order."""
    place = F.transform(blocks, lambda b, i: F.struct(F.coalesce(F.array_position(F.array(*(F.lit(x) for x in ("heading", "code_block", "list", "question"))), b["type"]), F.lit(0)).cast("int").alias("rank"), i.alias("at"), b.alias("b")))
    ranked = F.array_sort(F.transform(place, lambda p: F.struct(F.when(p["rank"] == 0, F.lit(9)).otherwise(p["rank"]).alias("rank"), p["at"].alias("at"), p["b"].alias("b"))))
    size = lambda b: F.length(F.coalesce(b["content"], F.array_join(b["items"], "\n"), F.lit("")))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + size(x["b"]) <= most
        return F.struct(F.when(fits, a["used"] + size(x["b"])).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(x["at"]))).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(ranked, start, step)["kept"]
    return F.filter(blocks, lambda b, i: F.array_contains(kept, i))


def meaning(blocks: Column) -> Column:
    """What a document's blocks are about: titles, questions, languages of code, items, reasoning."""
    texts = lambda *kinds: F.transform(of_kind(blocks, *kinds), lambda b: b["content"])
    return F.struct(texts("heading").alias("titles"), texts("question").alias("questions"), F.array_distinct(F.transform(of_kind(blocks, "code_block"), lambda b: b["language"])).alias("languages"), F.flatten(F.transform(of_kind(blocks, "list"), lambda b: b["items"])).alias("items"), texts("thinking").alias("reasoning"))


def formatting(block: Column) -> Column:
    return inline_formatting(F.coalesce(block["content"], F.lit("")))


def statistics(blocks: Column) -> Column:
    """total_blocks, a count for each parsed kind, total_length, has_code, has_lists, has_headings."""
    count = lambda kind: F.size(F.filter(blocks, lambda b: b["type"] == kind))
    length = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.coalesce(b["length"], F.lit(0)))
    return F.struct(
        F.size(blocks).alias("total_blocks"), *(count(k).alias(k) for k in PARSED), length.alias("total_length"),
        (count("code_block") > 0).alias("has_code"), (count("list") > 0).alias("has_lists"), (count("heading") > 0).alias("has_headings"),
    )


def reconstruct(blocks: Column, level: str = "high") -> Column:
    """The text that the blocks stand for; reasoning only at the highest level."""

    def lines(b: Column) -> Column:
        item = lambda x, i: F.when(b["list_type"] == "ordered", F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(F.concat(F.lit("- "), x))
        listed = F.array_join(F.concat(F.transform(b["items"], item), F.array(F.lit(""))), "\n")
        thought = F.concat(F.lit("<thinking>"), b["content"], F.lit("</thinking>\n")) if level == "maximum" else F.lit(None).cast("string")
        return (
            F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["content"], F.lit("\n")))
            .when(b["type"] == "code_block", F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["content"], F.lit("\n```\n")))
            .when(b["type"] == "list", listed)
            .when(b["type"].isin("paragraph", "question"), F.concat(b["content"], F.lit("\n")))
            .when(b["type"] == "thinking", thought)
        )

    return rx.strip(F.array_join(F.filter(F.transform(blocks, lines), lambda x: x.isNotNull()), "\n"))
