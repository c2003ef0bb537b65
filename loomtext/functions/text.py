"""Scalar text functions: normalisation, hashes, code blocks, response cleaning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import rx

#: Parts of code that make a text count as code when two of them occur.
CODE_PARTS = ("{", "}", "()", "=>", "function", "class", "def ", "import ", "const ", "let ", "var ")
#: Blocks of reasoning that a response loses.
THINKING = (r"<thinking>.*?</thinking>", r"<thought>.*?</thought>", r"\[THINKING\].*?\[/THINKING\]", r"Let me think.*?(?=\n\n)")
#: Traces of a system prompt that a response loses.
ARTIFACTS = (r"<system>.*?</system>", r"\[SYSTEM\].*?\[/SYSTEM\]", r"System:.*?(?=\n\n)")
#: Marks that families of models leave; removed when the family's name is in the model's.
QUIRKS = {
    "llama2": (r"^\s*\[INST\].*?\[/INST\]\s*", r"\s*</s>\s*$"),
    "mistral": (r"^\s*<\|im_start\|>.*?<\|im_end\|>\s*",),
    "codellama": (r"```output\n.*?```",),
}
HASHES = ("md5", "sha1", "sha256", "blake2b")


def normalize_whitespace(text: Column) -> Column:
    """One kind of line end, no trailing white space, at most two blank lines in a row, no ends."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = rx.replace(out, rf"{rx.WS_INLINE}+(?=\n|\z)", "")
    return rx.strip(rx.replace(out, r"\n{4,}", "\n\n\n"))


def normalize_prompt(text: Column) -> Column:
    """A prompt with plain line ends, tight fences, single blank lines and single spaces after bullets and heading marks."""
    out = rx.strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    out = rx.replace(out, r"```(\w+)?\n+", "```$1\n")
    out = rx.replace(out, r"\n+```", "\n```")
    out = rx.replace(out, r"\n{3,}", "\n\n")
    out = rx.replace(out, rf"\n([*-]){rx.WS}+", "\n$1 ")
    return rx.replace(out, rf"\n(#{{1,6}}){rx.WS}+", "\n$1 ")


def _blake2b(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode()).hexdigest())


def blake2b(text: Column) -> Column:
    """Hex digest of blake2b with 64 bytes, in Arrow batches; Spark has no built-in for it."""
    return F.pandas_udf(_blake2b, "string")(text)


def hash_chunk(text: Column, algorithm: str = "sha256") -> Column:
    """Digest of the text as it is; an unknown algorithm means sha256."""
    known: dict[str, Callable[[Column], Column]] = {"md5": F.md5, "sha1": F.sha1}
    return known.get(algorithm, lambda x: F.sha2(x, 256))(text)


def looks_like_code(text: Column) -> Column:
    return rx.flag_count(*(F.contains(text, F.lit(x)) for x in CODE_PARTS)) >= 2


def flatten_for_dedup(text: Column) -> Column:
    """Lower case, single spaces."""
    return rx.strip(rx.replace(F.lower(text), f"{rx.WS}+", " "))


def trim_for_dedup(flat: Column) -> Column:
    """A flattened text; unless it is code, without marks at its ends."""
    return F.when(looks_like_code(flat), flat).otherwise(F.btrim(flat, F.lit(".,;:!? \t\n")))


def normalize_for_dedup(text: Column) -> Column:
    """Lower case, single spaces; texts that aren't code also lose marks at their ends."""
    return trim_for_dedup(flatten_for_dedup(text))


def digest(text: Column, algorithm: str = "sha256") -> Column:
    """Hex digest by an algorithm of dedup."""
    if algorithm not in ("md5", "sha256", "blake2b"):
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return blake2b(text) if algorithm == "blake2b" else hash_chunk(text, algorithm)


def hash_text(text: Column, algorithm: str = "sha256", normalize: bool = True) -> Column:
    """Digest for dedup, of the normalised text."""
    return digest(normalize_for_dedup(text) if normalize else text, algorithm)


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("int")


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def code_blocks(text: Column) -> Column:
    """Fenced blocks: array of (language, content, start, end); offsets are of the whole fence."""
    fence = r"```(\w+)?\n(.*?)```"
    whole, language, content = (rx.all_of(text, fence, k, "s") for k in range(3))
    zipped = F.arrays_zip(whole.alias("whole"), language.alias("language"), content.alias("content"))
    empty = F.expr("cast(array() as array<struct<language:string,content:string,start:int,end:int>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.instr(F.substring(text, state["at"] + 1, F.length(text)), x["whole"]) - 1
        end = start + F.length(x["whole"])
        block = F.struct(F.when(F.coalesce(x["language"], F.lit("")) == "", F.lit("plaintext")).otherwise(x["language"]).alias("language"), rx.strip(x["content"]).alias("content"), start.alias("start"), end.alias("end"))
        return F.struct(F.concat(state["out"], F.array(block)).alias("out"), end.alias("at"))

    return F.aggregate(zipped, F.struct(empty.alias("out"), F.lit(0).alias("at")), step, lambda s: s["out"])


def remove_all(text: Column, patterns: tuple[str, ...], flags: str) -> Column:
    for pattern in patterns:
        text = rx.replace(text, pattern, "", flags)
    return text


def remove_thinking(text: Column) -> Column:
    return remove_all(text, THINKING, "is")


def remove_artifacts(text: Column) -> Column:
    return remove_all(text, ARTIFACTS, "is")


def remove_quirks(text: Column, model: Column) -> Column:
    """Marks of each family whose name is in the model's name."""
    name = F.lower(F.coalesce(model, F.lit("")))
    for family, patterns in QUIRKS.items():
        for pattern in patterns:
            # The pattern is chosen, not the text, so that the text's expression isn't doubled; (?!) matches nothing.
            chosen = F.when(F.contains(name, F.lit(family)), F.lit(rx.py(pattern, "s"))).otherwise(F.lit("(?!)"))
            text = F.regexp_replace(text, chosen, F.lit(""))
    return text


def normalize_fences(text: Column) -> Column:
    """Fences close to their code, and languages of capital letters in lower case."""
    out = rx.replace(text, rf"```(\w+)?{rx.WS}*\n+", "```$1\n")
    out = rx.replace(out, r"\n+```", "\n```")
    capitals = F.array_distinct(rx.all_of(out, r"```([A-Z]+)\n", 1))
    return F.aggregate(capitals, out, lambda acc, x: F.replace(acc, F.concat(F.lit("```"), x, F.lit("\n")), F.concat(F.lit("```"), F.lower(x), F.lit("\n"))))


def content_metadata(text: Column) -> Column:
    """has_code, code_blocks, has_lists, has_headings, line_count, paragraph_count."""
    return F.struct(
        F.contains(text, F.lit("```")).alias("has_code"),
        rx.count(text, r"```(\w+)?\n(.*?)```", "s").cast("bigint").alias("code_blocks"),
        rx.found(text, rf"^{rx.WS}*[-*+]{rx.WS}", "m").alias("has_lists"),
        rx.found(text, rf"^#{{1,6}}{rx.WS}", "m").alias("has_headings"),
        F.size(rx.lines(text)).cast("bigint").alias("line_count"),
        F.size(F.filter(F.split(text, "\n\n", -1), lambda x: ~rx.blank(x))).cast("bigint").alias("paragraph_count"),
    )


def reduction_ratio(before: Column, after: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.length(after), F.length(before)), F.lit(0.0))


def inline_formatting(text: Column) -> Column:
    return F.struct(rx.found(text, r"\*\*.*?\*\*").alias("bold"), rx.found(text, r"\*.*?\*").alias("italic"), rx.found(text, r"`.*?`").alias("code"), rx.found(text, r"\[.*?\]\(.*?\)").alias("links"))


def prompt_type(text: Column) -> Column:
    """system, code, conversation, example or instruction; the first that fits."""
    body, lower = rx.strip(text), F.lower(text)
    code = F.startswith(body, F.lit("def ")) | F.startswith(body, F.lit("class ")) | F.contains(text, F.lit("```")) | rx.found(text, rf"^{rx.WS}{{4,}}\w+", "m")
    return (
        F.when(rx.found(body, rf"^###?{rx.WS}*system:", "im"), "system")
        .when(code, "code")
        .when(rx.found(lower, r"(user:|assistant:|human:|ai:)"), "conversation")
        .when(rx.found(lower, r"\b(example|e\.g\.|for instance|such as):") | rx.found(lower, r"^(input|output):", "m"), "example")
        .otherwise("instruction")
    )


def word_set(text: Column) -> Column:
    return F.array_distinct(rx.words(F.lower(text)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared words over all words of two texts; 0 if either has none."""
    a, b = word_set(left), word_set(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
