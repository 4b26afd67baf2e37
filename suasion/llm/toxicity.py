"""Operator 9 — toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their first 4, 5 and 6 letters (insults take many
endings), hashed to 64 bits.  How often a term occurs is part of it: besides the term itself,
a document has one feature per number of occurrences reached (``COUNTS``) and, for a term
that occurs more than once, per share of the text's words reached (``SHARES``).  The machine
adds a weight per feature and, for every pair of features of a document, the inner product of
their factors, so "insult with group mention" can weigh more than both apart.

Fitting reads labelled rows only: at most ``sample_rows`` of them (a documented bound,
lowest id hashes first; of an id with several rows the text with the lowest hash).  Feature counts by label are a Spark aggregate; features that are more
frequent under label 1 (G² at least ``min_g2``, at most ``max_terms``, strongest first)
make the model, whose weights come from full-batch Adam steps on the driver over the
bounded sample's kept terms, both labels weighing the same.  Scoring is one Arrow pass over the texts, no shuffle;
the model (bounded by ``max_terms``) travels with the function.

Cases: null and empty texts score as documents without terms; without labelled rows, or
with one label only, every score is the smoothed share of label 1 (0.5 without rows);
labels of unknown ids or null labels are not read; repeated rows and ids each
get a score; extra columns stay as they are in ``scored`` and ``without_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm.shared import labelled_texts, texts_of, written

SAMPLE_ROWS, MAX_TERMS, MIN_G2, FACTORS = 20_000, 4096, 25.0, 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
COUNTS = (2, 3, 5)  # a term occurs at least so often
SHARES = (800, 400, 200, 100)  # a term is at least one of so many words
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    """Signed 64-bit hashes of a word and its prefixes."""
    names = ["=" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in names]


def _marks(kind: str, steps: tuple[int, ...]) -> list[tuple[int, int]]:
    """(mark, step): a term's hash xor the mark is its feature "this step is reached"."""
    return [(xxhash.xxh64_intdigest(f"{kind}{n}") - (1 << 63), n) for n in steps]


_COUNTS, _SHARES = _marks("count", COUNTS), _marks("share", SHARES)


class _Terms(dict):
    """word → its terms (only those with a wanted feature), worked out once per worker task."""

    def __init__(self, wanted: dict[int, int] | None):
        super().__init__()
        self.wanted = wanted
        self.known = None if wanted is None else {x ^ m for x in wanted for m in (0, *(m for m, _ in _COUNTS + _SHARES))}

    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        t = terms_of(word)
        if self.known is not None:
            t = [x for x in t if x in self.known]
        self[word] = t
        return t

    def of(self, text: str) -> set:
        """The text's features: hashes, or the wanted ones' numbers."""
        words = Counter(_WORD.findall(text.lower()))
        total = words.total()
        count: dict[int, int] = {}
        for word, k in words.items():
            for t in self[word]:
                count[t] = count.get(t, 0) + k
        out = set(count)
        for t, k in count.items():
            if k < 2:
                continue
            for mark, least in _COUNTS:
                if k < least:
                    break
                out.add(t ^ mark)
            for mark, among in _SHARES:
                if k * among < total:
                    break
                out.add(t ^ mark)
        return out if self.wanted is None else {self.wanted[x] for x in out if x in self.wanted}


@dataclass
class Machine:
    """bias + Σ w + Σ of pairwise factor products over a document's features (``terms``: their hashes)."""
    bias: float
    terms: list[int]
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        n = np.array([len(r) for r in rows], np.int64)
        full = np.flatnonzero(n)
        if len(full):
            idx = np.concatenate([np.asarray(rows[i], np.int64) for i in full])
            at = np.cumsum(n[full]) - n[full]
            out[full] += np.add.reduceat(self.w[idx], at)
            f = self.v[idx]
            out[full] += 0.5 * (np.add.reduceat(f, at) ** 2 - np.add.reduceat(f * f, at)).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _fit(rows: list[list[int]], y: np.ndarray, terms: list[int], factors: int, steps: int = 150,
         rate: float = 0.1, l2: float = 1e-5) -> Machine:
    n = np.array([len(r) for r in rows], np.int64)
    idx = np.concatenate([np.asarray(r, np.int64) for r in rows]) if n.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    d = len(terms)
    rng = np.random.default_rng(7)
    theta = np.concatenate([[0.0], np.zeros(d), 0.01 * rng.standard_normal(d * factors)])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels weigh the same

    def summed(values, by, size):
        return np.stack([np.bincount(by, values[:, k], size) for k in range(values.shape[1])], 1)
    for t in range(1, steps + 1):
        w, v = theta[1:1 + d], theta[1 + d:].reshape(d, factors)
        f = v[idx]
        total = summed(f, row, len(rows))
        z = theta[0] + np.bincount(row, w[idx], len(rows)) + 0.5 * (total ** 2 - summed(f * f, row, len(rows))).sum(1)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.concatenate([[e.sum()], np.bincount(idx, e[row], d),
                            summed(e[row, None] * (total[row] - f), idx, d).ravel()])
        g[1:] += l2 * theta[1:]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return Machine(float(theta[0]), terms, theta[1:1 + d], theta[1 + d:].reshape(d, factors))


def fit(docs: DataFrame, labelled: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, min_g2: float = MIN_G2,
        factors: int = FACTORS) -> Machine:
    """Fit on at most ``sample_rows`` rows of ``labelled`` (id, label 0/1): the caller has left out held-out rows."""
    sample = labelled_texts(docs, labelled, F.col(label_col).cast("int"), id_col, text_col, sample_rows)

    def extract(batches):
        of = _Terms(None)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(of.of(t)) for t in texts_of(b.column(1))], pa.list_(pa.int64()))], ["y", "terms"])
    rows = written(sample.mapInArrow(extract, "y int, terms array<long>"), "labelled-terms")
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if n1 + n0 > sample_rows:
        raise ValueError(f"{n1 + n0} labelled texts, more than {sample_rows}")
    if not n1 or not n0:
        return Machine(float(np.log((n1 + 0.5) / (n0 + 0.5))), [], np.zeros(0), np.zeros((0, factors)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")  # documents with the term, by label
    share = (a + b) / F.lit(float(n1 + n0))

    def cell(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    g2 = 2 * (cell(a, n1 * share) + cell(n1 - a, n1 * (1 - share)) + cell(b, n0 * share) + cell(n0 - b, n0 * (1 - share)))
    chosen = (rows.select("y", F.explode("terms").alias("term"))
              .groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
              .select("term", g2.alias("g2"), (a / F.lit(n1) > b / F.lit(n0)).alias("more")).where((F.col("g2") >= min_g2) & (F.col("more")))
              .orderBy(F.desc("g2"), "term").limit(max_terms).collect())
    terms = sorted(r["term"] for r in chosen)
    number = {t: i for i, t in enumerate(terms)}
    kept = rows.select("y", F.array_intersect("terms", F.lit(terms).cast("array<long>")).alias("terms")).toPandas() \
        if terms else rows.select("y", F.array().cast("array<long>").alias("terms")).toPandas()
    lists = [[number[t] for t in r] for r in kept["terms"]]
    return _fit(lists, kept["y"].to_numpy(float), terms, factors)


def score(model: Machine, text: Column) -> Column:
    """Score column of a text column (Arrow pass, whole texts)."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _Terms({t: i for i, t in enumerate(model.terms)})
        for s in batches:
            yield pd.Series(model.scores([list(of.of(t)) if t else [] for t in s]))
    return run(F.coalesce(text, F.lit("")))


def without_toxic(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows scoring below ``threshold``, all columns as they came."""
    return docs.where(score(model, F.col(text_col)) < F.lit(threshold))
