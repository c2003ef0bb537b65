"""Regular-expression building blocks that behave in Java as they do for Unicode text in general.

The flags (?dU) make only a newline end a line and the classes \\s \\w \\d \\b Unicode-aware; WS adds the
four separators U+001C to U+001F, which count as white space when text is trimmed or split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
WS_INLINE = r"[\s\x1c-\x1f&&[^\n]]"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def py(pattern: str, flags: str = "") -> str:
    """pattern with the flags that every pattern here has, and more of i, m, s."""
    return f"(?dU{flags}){pattern}"


def replace(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(py(pattern, flags)), F.lit(by))


def found(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(py(pattern, flags))


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(py(pattern, flags)))


def all_of(text: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(py(pattern, flags)), F.lit(group))


def strip(text: Column) -> Column:
    return replace(text, rf"\A{WS}+|{WS}+\z", "")


def blank(text: Column) -> Column:
    return ~found(text, r"[^\s\x1c-\x1f]")


def lines(text: Column) -> Column:
    """Lines between newlines, empty ones kept."""
    return F.split(text, "\n", -1)


def split_lines(text: Column) -> Column:
    """Lines between any line ends; no last empty one."""
    parts = F.split(text, py(LINE_ENDS), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, py(f"{WS}+"), -1), lambda x: x != "")


def flag_count(*tests: Column) -> Column:
    """How many of the tests hold."""
    total = F.lit(0)
    for test in tests:
        total = total + test.cast("int")
    return total
