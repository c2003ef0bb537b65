"""Fragments of DuckDB SQL that restate the library's text rules for oracles."""

from __future__ import annotations

from loomtext.functions.text import CODE_PARTS
from loomtext.operators.segment import ABBREVIATIONS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def gsub(x: str, pattern: str, by: str) -> str:
    p = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{p}', {by}, 'g')"


def looks_like_code(x: str) -> str:
    return "(" + " + ".join(f"contains({x}, '{p}')::int" for p in CODE_PARTS) + ") >= 2"


def dedup_normal(x: str) -> str:
    flat = strip(gsub(f"lower({x})", r"\s+", "' '"))
    return f"(case when {looks_like_code(flat)} then {flat} else trim({flat}, '.,;:!? ' || chr(9) || chr(10)) end)"


def whitespace_normal(x: str) -> str:
    lines = gsub(gsub(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))", r"[ \t\f\v]+\n", "chr(10)"), r"[ \t\f\v]+$", "''")
    return strip(gsub(lines, r"\n{4,}", "repeat(chr(10), 3)"))


def prompt_normal(x: str) -> str:
    out = gsub(strip(f"replace({x}, chr(13) || chr(10), chr(10))"), r"```(\w+)?\n+", r"'```\1' || chr(10)")
    out = gsub(out, r"\n+```", "chr(10) || '```'")
    out = gsub(out, r"\n{3,}", "chr(10) || chr(10)")
    out = gsub(out, r"\n([*-])\s+", r"chr(10) || '\1 '")
    return gsub(out, r"\n(#{1,6})\s+", r"chr(10) || '\1 '")


def prompt_type(x: str) -> str:
    m = lambda p, f="": f"regexp_matches({x}, '{p}', '{f}')"
    body = strip(x)
    return rf"""case when regexp_matches({body}, '(?im)^###?\s*system:') then 'system'
 when starts_with({body}, 'def ') or starts_with({body}, 'class ') or contains({x}, '```') or {m(r"(?m)^\s{4,}\w+")} then 'code'
 when {m("(?i)(user:|assistant:|human:|ai:)")} then 'conversation'
 when {m(r"(?i)(^|[^\p{L}\p{N}_])(example|e\.g\.|for instance|such as):")} or {m("(?im)^(input|output):")} then 'example' else 'instruction' end"""


def response_clean(x: str) -> str:
    """Cleaning of a response without a model's name, but for the case of fences' languages."""
    for pattern in (r"(?is)<thinking>.*?</thinking>", r"(?is)<thought>.*?</thought>", r"(?is)\[THINKING\].*?\[/THINKING\]"):
        x = gsub(x, pattern, "''")
    x = gsub(x, r"(?is)Let me think.*?(\n\n)", r"'\1'")
    for pattern in (r"(?is)<system>.*?</system>", r"(?is)\[SYSTEM\].*?\[/SYSTEM\]"):
        x = gsub(x, pattern, "''")
    x = whitespace_normal(gsub(x, r"(?is)System:.*?(\n\n)", r"'\1'"))
    x = gsub(gsub(x, r"```(\w+)?\s*\n+", r"'```\1' || chr(10)"), r"\n+```", "chr(10) || '```'")
    return f"replace({x}, '```PYTHON' || chr(10), '```python' || chr(10))"


def sentence_parts(x: str) -> str:
    """Parts between sentence breaks, untrimmed: marks after abbreviations are shielded, then breaks are marked twice, as neighbours may share white space."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    out = gsub(x, rf"(?i)({short})([.!?])", r"'\1' || chr(2) || '\2'")
    for _ in range(2):
        out = gsub(out, r"""([^\x02]|^)([.!?])(\s+)([\p{Lu}\p{Nd}"']|$)""", r"'\1\2' || chr(1) || '\3\4'")
    return f"list_transform(string_split({out}, chr(1)), lambda p: replace(p, chr(2), ''))"


def sentences(table: str = "documents", key: str = "doc_id", more: str = "", prefix: str = "") -> str:
    """Common table expressions that end in `sentences` (with a prefix): key, seg_idx, text, start_pos, end_pos and more."""
    extra = f", {more}" if more else ""
    return f"""{prefix}split_parts as (select {key}{extra}, {sentence_parts("coalesce(text, '')")} as parts from {table}),
 {prefix}each_part as (select {key}{extra}, unnest(parts) as part, generate_subscripts(parts, 1) as i from {prefix}split_parts),
 {prefix}placed as (select *, coalesce(sum(length(part)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start_pos from {prefix}each_part),
 {prefix}sentences as (select {key}{extra}, row_number() over (partition by {key} order by i) - 1 as seg_idx, {strip("part")} as text, start_pos, start_pos + length(part) as end_pos from {prefix}placed where length({strip("part")}) >= 3)"""


def word_set(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"
