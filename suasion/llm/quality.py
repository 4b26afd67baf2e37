"""Operator 4 — quality score from a sparse rule ensemble.

Text statistics (one Arrow pass over whole texts) feed a small forest of shallow trees;
every path of every tree is a rule, a conjunction of threshold tests on statistics.  A
lasso logistic regression over the rules' 0/1 values keeps few of them, and the kept rules
and their weights are compiled into one Spark column expression.

Fitting reads labelled rows only, at most ``sample_rows`` of them (a documented bound,
lowest id hashes first; of an id with several rows the text with the lowest hash).  Scoring is one pass without a shuffle; the expression's size is
bounded by TREES * 2**(DEPTH + 1) rules.

Cases: null and empty texts have all statistics 0 and get a score like any other; without
labelled rows, or with one label only, every score is the smoothed share of label 1 (0.5
without rows); null labels and null ids are not read; repeated rows and ids
each get a score; an empty table gives no rows; other columns are not inputs and stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm.shared import labelled_texts, written
from suasion.llm.trees import paths, plain

SAMPLE_ROWS, TREES, DEPTH, LASSO = 20_000, 20, 3, 0.002
THRESHOLD = 0.3
STATS = ("chars", "words", "word_len", "upper", "digits", "symbols", "space", "non_ascii", "distinct_words", "top_word",
         "short_words", "symbol_ends", "bare_symbols", "distinct_pairs", "distinct_lines", "line_words", "closed_lines")
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\f\v"
_HIGH = bytes(range(128, 256))
_PROSE = b".,;:'\"?-()" + _LETTERS + _DIGITS + _SPACE + _HIGH


def statistics(text: str) -> tuple[float, ...]:
    """The STATS of a text."""
    words = text.split()
    if not words:
        return (float(len(text)), *(0.0,) * (len(STATS) - 1))
    raw = text.encode()
    size, n = len(raw), len(words)

    def share_of(chars: bytes) -> float:
        return 1 - len(raw.translate(None, chars)) / size
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    letters = len(raw) - len(raw.translate(None, _LETTERS + _HIGH))
    lines = [x for x in text.split("\n") if x]
    n_lines = max(1, len(lines))
    ends = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:'\"?)")
    bare = sum(1 for w in words if not any(map(str.isalnum, w)))
    return (float(len(text)), float(n), sum(map(len, words)) / n, (size - len(raw.translate(None, _UPPER))) / max(1, letters),
            share_of(_DIGITS), len(raw.translate(None, _PROSE)) / size, share_of(_SPACE), share_of(_HIGH),
            len(count) / n, max(count.values()) / n, sum(c for w, c in count.items() if len(w) < 4) / n, ends / n, bare / n,
            len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), len(set(lines)) / n_lines, n / n_lines,
            sum(1 for x in lines if x.rstrip()[-1:] in ".!?\"") / n_lines)


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "__stats") -> DataFrame:
    """Adds the struct column ``into`` of the STATS."""
    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([statistics(t or "") for t in s], columns=list(STATS))
    return docs.withColumn(into, run(F.coalesce(F.col(text_col), F.lit(""))))


Rule = tuple[tuple[int, float, bool], ...]


@dataclass
class Rules:
    """bias + Σ weight of the rules that hold."""
    bias: float
    rules: list[Rule]
    weights: list[float]

    def score(self, stats: str = "__stats") -> Column:
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(holds(rule, stats), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, stats: str) -> Column:
    """A rule as a Spark condition."""
    out = F.lit(True)
    for f, threshold, low in rule:
        c = F.col(f"{stats}.{STATS[f]}")
        out = out & (c <= threshold if low else c > threshold)
    return out


def _shortest(rule: Rule) -> Rule:
    """One test per statistic and direction: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for f, t, low in rule:
        old = tight.get((f, low))
        tight[f, low] = t if old is None else (min if low else max)(old, t)
    return tuple(sorted((f, t, low) for (f, low), t in tight.items()))


def fit(docs: DataFrame, labelled: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Rules:
    """Fit on at most ``sample_rows`` rows of ``labelled`` (id, label 0/1): the caller has left out held-out rows."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    sample = with_statistics(labelled_texts(docs, labelled, F.col(label_col).cast("double"), id_col, text_col, sample_rows))
    rows = written(sample.select("label", F.col("__stats")), "labelled-statistics").coalesce(4)
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = count.get(1.0, 0), count.get(0.0, 0)
    if not n1 or not n0:
        return Rules(math.log((n1 + 0.5) / (n0 + 0.5)), [], [])
    stats = rows.select("label", array_to_vector(F.array(*[F.col(f"__stats.{s}") for s in STATS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, seed=5).fit(stats)
    rules = sorted({_shortest(r) for tree in forest._call_java("trees") for r in paths(plain(tree.rootNode()))})
    if not rules:
        return Rules(math.log((n1 + 0.5) / (n0 + 0.5)), [], [])
    table = rows.select("label", array_to_vector(F.array(
        *[F.when(holds(r, "__stats"), 1.0).otherwise(0.0) for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(table)
    w = model.coefficients.toArray()
    return Rules(float(model.intercept), [r for r, x in zip(rules, w, strict=True) if x], [float(x) for x in w if x])


def scored(docs: DataFrame, model: Rules, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score column ``into`` (an existing column of that name is replaced)."""
    return with_statistics(docs, text_col).withColumn(into, model.score()).drop("__stats")
