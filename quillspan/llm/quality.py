"""Quality classifier (operator 9): a sparse rule ensemble over text statistics.

Statistics of a text are Spark column expressions. On a bounded sample of labelled rows small trees are
grown over them; every path from a root to a node is a conjunctive rule. A logistic model with a lasso
penalty keeps few of the rules; those are compiled back into Spark column expressions, so scoring is one
narrow projection over whole texts, with neither Python nor a shuffle.

Fitting: at most ``ROWS`` labelled texts, half of each label as far as there are, of any length, picked by a hash of
doc_id; only their statistics reach the driver.

Defined results: a null text counts as empty, whose statistics are all 0; without labelled rows of both
kinds every score is the share of label 1 (0 without any); a score of just 0.7 is label 1. Of several labels of one doc_id the largest
counts. Repeated rows are scored each for itself; very long texts are read whole; other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.numbers import let
from quillspan.llm.common import MOST_CHARS, crc_mod, free_name, labelled_sample

ROWS = 4000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
TREES, DEPTH, CUTS, LEAST = 40, 3, 24, 8
PENALTY = 0.002


def statistics(text: Column) -> Column:
    """Statistics of a text as one struct column of doubles, with the fields ``NAMES``.

    Words and lines are bound once, so the cost is the same in a filter, where Spark shares no subexpressions.
    """
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    count = lambda t, p: F.regexp_count(t, F.lit(p)).cast("double")

    def of(p: Column) -> Column:
        n_chars, n_words, n_lines = F.length(p["text"]).cast("double"), F.size(p["words"]).cast("double"), F.size(p["lines"]).cast("double")
        values = [
            n_chars,
            n_words,
            over(n_chars, n_words),
            over(count(p["text"], r"[#$%&*|!@^~=<>{}\[\]\\_+]"), n_chars),
            over(count(p["text"], r"\p{Lu}"), n_chars),
            over(count(p["text"], r"[.,;:?]"), n_words),
            over(F.size(F.array_distinct(p["words"])).cast("double"), n_words),
            over(F.size(F.array_distinct(p["lines"])).cast("double"), n_lines),
            over(n_words, n_lines),
        ]
        return F.struct(*(v.alias(n) for v, n in zip(values, NAMES, strict=True)))

    parts = lambda pattern: F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda w: w != "")
    return let(F.struct(F.coalesce(text, F.lit("")).alias("text"), parts(r"\s+").alias("words"), parts("\n").alias("lines")), of)


#: The statistics in the order of the model.
NAMES = [
    "n_chars", "n_words", "chars_per_word", "symbols", "capitals", "stops", "distinct_words", "distinct_lines", "words_per_line",
]

#: One test of a rule: statistic, cut, and whether the value must be above it.
Test = tuple[int, float, bool]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple[Test, ...]]:
    """The paths of one small tree on a random half of the rows and two thirds of the statistics."""
    rows = rng.choice(len(x), size=max(2, len(x) // 2), replace=False)
    columns = rng.choice(x.shape[1], size=max(1, 2 * x.shape[1] // 3), replace=False)
    paths: list[tuple[Test, ...]] = []
    todo = [(rows, ())]
    while todo:
        at, path = todo.pop()
        if path:
            paths.append(path)
        if len(path) == DEPTH or len(at) < 2 * LEAST or y[at].min() == y[at].max():
            continue
        best = None
        for c in columns:
            v = x[at, c]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))):
                up = v > cut
                n = int(up.sum())
                if LEAST <= n <= len(at) - LEAST:
                    p, q = y[at][up].mean(), y[at][~up].mean()
                    impurity = n * p * (1 - p) + (len(at) - n) * q * (1 - q)
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, int(c), float(cut), up)
        if best:
            _, c, cut, up = best
            todo += [(at[~up], (*path, (c, cut, False))), (at[up], (*path, (c, cut, True)))]
    return paths


def holds(x: np.ndarray, rule: tuple[Test, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, c] > cut) == above for c, cut, above in rule])


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal steps; the intercept is not penalised."""
    z = np.hstack([np.ones((len(r), 1)), r])
    share = weight / weight.sum()
    step = 4 / np.linalg.norm(z * np.sqrt(share)[:, None], 2) ** 2
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - step * (z.T @ (share * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, list[tuple[float, tuple[Test, ...]]]]:
    """(intercept, weighted rules); ``share``: of label 1 among all labelled rows."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(share, 1e-12), 1 - 1e-12)
        return float(np.log(p / (1 - p))), []
    rng = np.random.default_rng(5)
    rules = sorted({p for _ in range(TREES) for p in grow(x, y, rng)})
    distinct: dict[bytes, tuple[Test, ...]] = {}
    for rule in sorted(rules, key=lambda p: (len(p), p)):
        distinct.setdefault(holds(x, rule).tobytes(), rule)
    rules = list(distinct.values())
    if not rules:
        p = min(max(share, 1e-12), 1 - 1e-12)
        return float(np.log(p / (1 - p))), []
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    start, w = lasso(np.array([holds(x, r) for r in rules], dtype=float).T, y, weight, PENALTY)
    return start, [(float(a), r) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-6]


def compiled(model: tuple[float, list[tuple[float, tuple[Test, ...]]]], columns: list[Column]) -> Column:
    """The score as one column expression over the statistics' columns."""
    start, rules = model
    total = F.lit(start)
    for weight, rule in rules:
        test = F.lit(True)
        for c, cut, above in rule:
            test = test & (columns[c] > cut if above else columns[c] <= cut)
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit_from(docs: DataFrame, labels: DataFrame) -> tuple[float, list]:
    known = labels.filter((crc_mod("doc_id", FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    rows, counts = labelled_sample(docs, known, {1: ROWS // 2, 0: ROWS // 2}, MOST_CHARS, [statistics(F.col("text"))])
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit(np.array([tuple(r[1]) for r in rows], dtype=float).reshape(len(rows), len(NAMES)), np.array([r[0] for r in rows], dtype=float), share)


def with_score(docs: DataFrame, model: tuple, out: str) -> DataFrame:
    """``docs`` with a column of scores."""
    score = let(statistics(F.col("text")), lambda s: compiled(model, [s[n] for n in NAMES]))
    return docs.withColumn(out, score)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    return with_score(rows, fit_from(docs, labels), "score").select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of predicted quality 1, with all their columns."""
    mark = free_name("_quality", docs)
    return with_score(docs, fit_from(docs, labels), mark).filter(F.col(mark) >= THRESHOLD).drop(mark)
