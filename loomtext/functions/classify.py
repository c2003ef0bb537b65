"""Heuristic content classification: eight features, three scores, one label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import rx
from loomtext.functions.validate import check_threshold

#: Words that programs use.
KEYWORDS = (
    "function", "class", "def", "return", "if", "else", "for", "while", "import", "from", "const", "let", "var", "int", "float",
    "string", "public", "private", "static", "void", "async", "await", "try", "catch", "throw", "new", "this", "self", "lambda", "yield",
)
#: Signs of code, searched in several lines.
CODE = (r"[{}\[\]()]", r"[=<>!]+", r";$", r"=>|->|\|\||&&", r"^\s*#include|^import |^from .+ import", r"^\s*(public|private|protected)\s+(class|interface|enum)")
#: Signs of prose, searched in the lower-cased text; the second needs a capital, so it never occurs there.
PROSE = (r"\b(the|a|an|and|or|but|in|on|at|to|for|of|with)\b", r"[.!?]\s+[A-Z]", r"\b(is|are|was|were|be|been|being)\b")
FEATURES = ("code_syntax", "code_keywords", "indentation", "prose_patterns", "structured_data", "punctuation", "line_length", "whitespace")


def _occurrences(text: Column, chars: str) -> Column:
    """How many of the text's characters are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def code_syntax(text: Column) -> Column:
    share = rx.flag_count(*(rx.found(text, x, "m") for x in CODE)) / F.lit(len(CODE))
    density = F.coalesce(F.try_divide(_occurrences(text, "{}[]()<>"), F.length(text)), F.lit(0.0))
    return F.least(share * 0.7 + F.least(density * 10, F.lit(1.0)) * 0.3, F.lit(1.0))


def code_keywords(lower: Column) -> Column:
    words = rx.all_of(lower, r"\b\w+\b")
    hits = F.size(F.filter(words, lambda x: x.isin(*KEYWORDS)))
    return F.least(F.coalesce(F.try_divide(hits, F.size(words)), F.lit(0.0)) * 10, F.lit(1.0))


def indentation(lines: Column) -> Column:
    """lines: those that aren't blank."""
    indented = F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin(" ", "\t")))
    depth = lambda x: F.length(x) - F.length(rx.replace(x, rf"\A{rx.WS}+", ""))
    bonus = F.when(F.forall(lines, lambda x: depth(x) % 2 == 0), F.lit(0.3)).otherwise(F.lit(0.0))
    return F.when(F.size(lines) < 3, F.lit(0.0)).otherwise(F.least(F.try_divide(indented, F.size(lines)) + bonus, F.lit(1.0)))


def prose_patterns(text: Column, lower: Column) -> Column:
    share = rx.flag_count(*(rx.found(lower, x) for x in PROSE)) / F.lit(len(PROSE))
    sentences = F.split(text, "[.!?]+", -1)
    words = F.aggregate(sentences, F.lit(0), lambda n, x: n + F.size(rx.words(x)))
    mean = words / F.size(sentences)
    length = F.when(mean.between(10, 30), F.lit(0.5)).when(mean.between(5, 40), F.lit(0.3)).otherwise(F.lit(0.0))
    return F.least(share * 0.6 + length * 0.4, F.lit(1.0))


def strict_json(text: Column) -> Column:
    """Whether the text is one JSON value with nothing around it; duplicate keys and NaN aren't."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.try_variant_get(wrapped, "$[0]", "variant").isNotNull()
    only = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.coalesce(first & only & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def structured_data(text: Column) -> Column:
    body = rx.strip(text)
    ends = lambda a, b: F.startswith(body, F.lit(a)) & F.endswith(body, F.lit(b))
    lines = rx.split_lines(body)
    pairs = F.size(F.filter(lines, lambda x: rx.found(x, rf"\A{rx.WS}*[\w-]+:{rx.WS}+")))
    return (
        F.when((ends("{", "}") | ends("[", "]")) & strict_json(body), F.lit(1.0))
        .when(ends("<", ">") & (rx.count(body, "<[^>]+>") >= 2), F.lit(0.9))
        .when(F.coalesce(F.try_divide(pairs, F.size(lines)), F.lit(0.0)) > 0.5, F.lit(0.8))
        .otherwise(F.lit(0.0))
    )


def punctuation(text: Column) -> Column:
    variety = rx.flag_count(*(F.contains(text, F.lit(x)) for x in ".,?!:;")) / F.lit(6)
    enders = F.coalesce(F.try_divide(_occurrences(text, ".?!"), F.length(text)), F.lit(0.0))
    return F.when(text == "", F.lit(0.0)).otherwise(variety * 0.4 + F.least(enders * 50, F.lit(1.0)) * 0.6)


def line_length(lines: Column) -> Column:
    """lines: those that aren't blank."""
    mean = F.try_divide(F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)), F.size(lines))
    return F.when(mean.between(60, 100), F.lit(0.8)).when(mean.between(30, 60), F.lit(0.3)).otherwise(F.lit(0.5))


def whitespace(text: Column, all_lines: Column, lines: Column) -> Column:
    share = F.coalesce(F.try_divide(_occurrences(text, " \t\n"), F.length(text)), F.lit(0.0))
    blank = F.coalesce(F.try_divide(F.size(all_lines) - F.size(lines), F.size(all_lines)), F.lit(0.0))
    return share * 0.5 + blank * 0.5


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column for each feature (f_...), the scores and the label; intermediate texts are computed once."""
    names = df.columns
    t, lower, all_lines, lines = (F.col(x) for x in ("__t", "__lower", "__all", "__lines"))
    out = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({"__lower": F.lower(t), "__all": rx.split_lines(t)})
    out = out.withColumn("__lines", F.filter(all_lines, lambda x: ~rx.blank(x)))
    out = out.withColumns({
        "f_code_syntax": code_syntax(t), "f_code_keywords": code_keywords(lower), "f_indentation": indentation(lines),
        "f_prose_patterns": prose_patterns(t, lower), "f_structured_data": structured_data(t), "f_punctuation": punctuation(t),
        "f_line_length": line_length(lines), "f_whitespace": whitespace(t, all_lines, lines), "char_count": F.length(t), "line_count": F.size(all_lines),
    })
    f = lambda x: F.col(f"f_{x}")
    out = out.withColumns({
        "code_score": f("code_syntax") * 0.3 + f("code_keywords") * 0.25 + f("indentation") * 0.2 + (1 - f("prose_patterns")) * 0.25,
        "prose_score": f("prose_patterns") * 0.4 + f("punctuation") * 0.3 + (1 - f("code_syntax")) * 0.3,
        "structured_score": f("structured_data"), "is_blank": rx.blank(t),
    })
    return out.select(*names, *(f"f_{x}" for x in FEATURES), "code_score", "prose_score", "structured_score", "char_count", "line_count", "is_blank")


def classify(df: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """df with content_type and confidence (and the features); a blank text is unknown with confidence 0."""
    check_threshold(threshold, "the least confidence")
    out = with_features(df, text)
    code, prose, structured = F.col("code_score"), F.col("prose_score"), F.col("structured_score")
    kinds = [
        (F.col("is_blank"), "unknown", F.lit(0.0)),
        (structured > 0.7, "structured_data", structured),
        ((code > prose) & (code >= threshold), "code", code),
        (prose >= threshold, "prose", prose),
        (F.abs(code - prose) < 0.2, "mixed", F.greatest(code, prose)),
    ]
    label, confidence = F, F
    for test, name, value in kinds:
        label, confidence = label.when(test, F.lit(name)), confidence.when(test, value)
    return out.withColumns({"content_type": label.otherwise(F.lit("unknown")), "confidence": confidence.otherwise(F.greatest(code, prose, structured))})
