"""Quality: a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

Statistics are column expressions of a text. On a bounded labelled sample, shallow trees are boosted on
the logistic loss; every path from a root to a node is a rule, a conjunction of "statistic <= or >
threshold". A logistic model with an L1 penalty over the rules keeps few of them, and the kept rules
become when-expressions whose weights are summed: scoring runs in the JVM, in one pass over the texts.

The sample is bounded by `most_documents` labelled ids (smallest hashes), one row for each (its greatest text); texts are
read whole for it and for scoring, and the driver gathers their statistics only.

Defined results: a null or empty text has statistics 0; without labels of both kinds the score is the
smoothed share of label 1; repeated rows are scored alike; an empty table gives no rows; columns of any name stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import fold

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)


def statistics(text: Column) -> dict[str, Column]:
    """Name and expression of each statistic; `text` should be a plain column, never null."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "words": count(r"[^ \n]+"),
        "capitals": count(r"\p{Lu}") / n,
        "symbols": count(r"[#$%&*=<>{}\[\]\\^~+_@|]") / n,
        "shouts": count(r"[!?]") / n,
        "digits": count(r"[0-9]") / n,
        "stops": count(r"[.;:,]") / n,
        "short": count(r"(?<![^ \n])[^ \n]{1,3}(?![^ \n])"),
        "lines": F.size(F.split(text, "\n")).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(text, " "))).cast("double"),
        "odd": count(r"[^\p{L}\p{N}\p{P}\p{S}\s]") / n,
    }


def _ratios(s: dict[str, Column]) -> dict[str, Column]:
    words = F.greatest(s["words"], F.lit(1.0))
    return {"word_length": F.expm1(s["chars"]) / words, "short_share": s["short"] / words, "distinct_share": s["distinct"] / words, "line_words": s["words"] / F.greatest(s["lines"], F.lit(1.0)), "stops_per_word": s["stops"] * F.expm1(s["chars"]) / words}


BASE = ("chars", "words", "capitals", "symbols", "shouts", "digits", "stops", "short", "lines", "distinct", "odd")
NAMES = (*BASE, "word_length", "short_share", "distinct_share", "line_words", "stops_per_word")


def with_statistics(docs: DataFrame, prefix: str = "__q_", row: bool = False) -> DataFrame:
    """docs with a column for each statistic of `text`, and with a row number beside them if asked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = {prefix + "row": F.monotonically_increasing_id()} if row else {}
    found = docs.withColumns({prefix + k: v for k, v in statistics(text).items()} | number)
    return found.withColumns({prefix + k: v for k, v in _ratios({k: F.col(prefix + k) for k in BASE}).items()})


def _prefix(docs: DataFrame) -> str:
    """A beginning of names that no column of docs has."""
    prefix = "__q_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = "_" + prefix
    return prefix


@dataclass
class Rules:
    """An intercept, and rules with their weights."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, prefix: str = "__q_") -> Column:
        """The score as an expression of the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, threshold in rule:
                column = F.col(prefix + NAMES[k])
                test = test & (column > threshold if above else column <= threshold)
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, threshold in rule:
        out &= x[:, k] > threshold if above else x[:, k] <= threshold
    return out


def grow(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> list[tuple[Rule, np.ndarray, float]]:
    """The nodes of one tree but its root: path, rows, value."""
    out: list[tuple[Rule, np.ndarray, float]] = []

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        g, h = gradient[rows], hessian[rows]
        base, best = g.sum() ** 2 / (h.sum() + 1), (1e-6, -1, 0.0)
        for k, edges in enumerate(bins):
            if not len(edges):
                continue
            sums = [np.bincount(codes[rows, k], w, len(edges) + 1) for w in (g, h, np.ones(len(rows)))]
            low = [np.cumsum(s)[:-1] for s in sums]
            high = [s.sum() - a for s, a in zip(sums, low, strict=True)]
            gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1) - base
            gain[(low[2] < least) | (high[2] < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, float(edges[at]))
        if best[1] < 0:
            return
        above = x[rows, best[1]] > best[2]
        for side in (False, True):
            part, rule = rows[above == side], (*path, (best[1], side, best[2]))
            out.append((rule, part, float(-gradient[part].sum() / (hessian[part].sum() + 1))))
            if left > 1:
                split(part, rule, left - 1)

    split(np.arange(len(x)), (), depth)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    scale = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1)
    w, b, vw, vb, t = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(m), 0.0, 1.0
    vb = b
    for _ in range(steps):
        d = (1 / (1 + np.exp(-(r @ vw + vb))) - y) / n
        new = vw - scale * (r.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - scale * penalty, 0)
        new_b, new_t = vb - scale * d.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return b, w


def learn(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003), seed: int = 5) -> Rules:
    """Rules of labelled statistics. A fifth of the rows choose the penalty."""
    y = y.astype(float)
    if not 0 < y.sum() < len(y):
        return Rules(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, 41)[1:-1])) for c in x.T]
    bins = [b[b < c.max()] for b, c in zip(bins, x.T, strict=True)]
    codes = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bins, x.T, strict=True)], axis=1)
    total, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        some = rng.random(len(y)) < 0.7
        gradient, hessian = np.where(some, p - y, 0), np.where(some, p * (1 - p), 0)
        for rule, rows, value in grow(x, bins, codes, gradient, hessian, depth, max(5, len(y) // 400)):
            found[tuple(sorted(rule))] = True
            if len(rule) == depth:
                total[rows] += 0.3 * value
    rules, masks, seen = [], [], set()
    for rule in found:
        mask = holds(rule, x)
        if (key := mask.tobytes()) not in seen and 0 < mask.sum() < len(mask):
            seen.add(key)
            rules.append(rule)
            masks.append(mask)
    r = np.stack(masks, axis=1).astype(float) if masks else np.zeros((len(y), 0))
    if not rules:
        return Rules(float(total[0]))
    held = rng.random(len(y)) < 0.2
    best = (np.inf, penalties[0])
    for penalty in penalties if 0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum() else ():
        b, w = lasso(r[~held], y[~held], penalty, 150)
        p = np.clip(1 / (1 + np.exp(-(r[held] @ w + b))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()), penalty))
    b, w = lasso(r, y, best[1])
    return Rules(float(b), [(rule, float(v)) for rule, v in zip(rules, w.tolist(), strict=True) if abs(v) > 1e-3])


def fit(docs: DataFrame, labels: DataFrame, most_documents: int = 12_000, folds: int = 5, held: int = 0) -> Rules:
    """Rules from at most `most_documents` labelled rows outside the held-out fold."""
    kept = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & (fold("__id", folds) != held))
    wanted = kept.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(most_documents)
    # Of a fixed bound, so it may be broadcast.
    joined = docs.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(wanted), F.col("__doc") == F.col("__id"))
    # One row for an id, so that what the driver gathers has that bound too, however often an id is repeated.
    joined = joined.groupBy("__doc").agg(F.min("__label").alias("__label"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = with_statistics(joined).select("__doc", "__label", *(f"__q_{x}" for x in NAMES)).toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy(float)
    return learn(rows[:, 2:], rows[:, 1])


def score(docs: DataFrame, rules: Rules, name: str = "quality_score") -> DataFrame:
    """docs with a column of scores; one that has its name is replaced."""
    prefix = _prefix(docs)
    return with_statistics(docs, prefix).select(*(f"`{x}`" for x in docs.columns if x.lower() != name.lower()), rules.column(prefix).alias(name))


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score of 0.3 or more)."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that the classifier doesn't reject, in docs' columns.

    The filter refers to a row number beside the statistics: without it, the planner pushes the filter below
    them and computes a statistic once for each rule that tests it.
    """
    rules, prefix = fit(docs, labels), _prefix(docs)
    found = with_statistics(docs, prefix, row=True)
    return found.where((rules.column(prefix) >= least) & (F.col(prefix + "row") >= 0)).select(*(f"`{x}`" for x in docs.columns))
