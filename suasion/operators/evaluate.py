"""Evaluation (EVL01-06, MTH05/06) as aggregates over scored rows.

Everything is grouped by optional keys (split, fold, epoch, run) so one job
evaluates many models.  Exact ROC-AUC is the tie-aware Mann-Whitney statistic over
distinct scores; its running negative count uses the distributed prefix sum.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.operators.numbering import prefix_sums


def softmax2(l0: str, l1: str):
    """MTH05: p(class 1) of two logits, computed stably."""
    d = F.col(l1) - F.col(l0)
    return F.when(d >= 0, 1.0 / (1.0 + F.exp(-d))).otherwise(F.exp(d) / (1.0 + F.exp(d)))


def argmax2(l0: str, l1: str):
    """MTH05: class 1 only if its logit is strictly larger (tie → class 0)."""
    return F.when(F.col(l1) > F.col(l0), 1).otherwise(0)


def cross_entropy2(l0: str, l1: str, label: str):
    """MTH06: -log softmax(true class) via log-sum-exp."""
    m = F.greatest(F.col(l0), F.col(l1))
    lse = m + F.log(F.exp(F.col(l0) - m) + F.exp(F.col(l1) - m))
    return lse - F.when(F.col(label) == 1, F.col(l1)).otherwise(F.col(l0))


def accuracy(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """EVL01."""
    g = df.groupBy(*(by or []))
    return g.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """EVL02: mean over the classes seen in truth or prediction; F1 of a class with no
    support and no prediction is 0 (sklearn's zero_division)."""
    by = by or []
    table = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("_n"))  # the confusion table
    per = table.select(*by, F.explode(F.array_distinct(F.array(F.col(label), F.col(pred)))).alias("_c"), label, pred, "_n")

    def rows(condition):
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))
    true, said = F.col(label) == F.col("_c"), F.col(pred) == F.col("_c")
    counts = per.groupBy(*by, "_c").agg(rows(true & said).alias("tp"), rows(~true & said).alias("fp"),
                                        rows(true & ~said).alias("fn"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(
        2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return counts.groupBy(*by).agg(F.avg(f1).alias("f1_macro"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """EVL03: exact ROC-AUC with ties counted half; one class only → 0.0."""
    by = by or []
    per_score = df.groupBy(*by, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"),
        F.sum((F.col(label) != 1).cast("long")).alias("q"))
    ranked = prefix_sums(per_score, [F.col(score).asc()], ["q"], by)
    p, q, before = (F.col(c).cast("double") for c in ("p", "q", "q_before"))  # products pass 2**63
    agg = ranked.groupBy(*by).agg(F.sum(p * (before + q / 2.0)).alias("_u"), F.sum(p).alias("_P"), F.sum(q).alias("_N"))
    auc = F.when((F.col("_P") == 0) | (F.col("_N") == 0), 0.0).otherwise(
        F.col("_u") / (F.col("_P") * F.col("_N")))
    return agg.select(*by, auc.alias("roc_auc"))


def most_frequent_class(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """EVL04: max class count / total."""
    by = by or []
    c = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*by).agg((F.max("_n") / F.sum("_n")).alias("mfc"))


def t_two_sided_p(t: float | None, dof: float | None) -> float:
    """Two-sided p of Student's t.  With t = sqrt(dof) * tan(a) the density is cos(a)**(dof - 1),
    so p is its integral from a to pi/2 over the one from 0 (a gamma quotient); the tail is
    summed by Gauss-Legendre nodes over the 40 widths 1/sqrt(dof) that matter."""
    import math

    import numpy as np
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    start = math.atan(abs(t) / math.sqrt(dof))
    stop = min(math.pi / 2, start + 40 / math.sqrt(dof))
    nodes, weights = np.polynomial.legendre.leggauss(64)
    total = 0.0
    for k in range(20):
        a, h = start + (stop - start) * k / 20, (stop - start) / 20
        angle = np.minimum(a + h * (nodes + 1) / 2, math.pi / 2 - 1e-15)
        total += float((weights * np.exp((dof - 1) * np.log(np.cos(angle)))).sum()) * h / 2
    whole = 0.5 * math.sqrt(math.pi) * math.exp(math.lgamma(dof / 2) - math.lgamma((dof + 1) / 2))
    return min(1.0, total / whole)


def paired_t(df: DataFrame, loss_a: str, loss_b: str, by: list[str] | None = None) -> DataFrame:
    """EVL05: paired t statistic of per-row loss differences, its n and two-sided p.

    The statistic is one aggregate; the p-value is computed on the aggregated rows
    (one per group) by an Arrow-batched function.
    """
    d = F.col(loss_a) - F.col(loss_b)
    g = df.groupBy(*(by or []))
    error = F.stddev_samp(d) / F.sqrt(F.count(d))
    # equal losses everywhere: no difference, t = 0 and p = 1; a constant difference has no t
    t = F.when((F.min(d) == 0) & (F.max(d) == 0), 0.0).otherwise(F.avg(d) / F.nullif(error, F.lit(0.0)))
    agg = g.agg(t.alias("t_stat"), F.count(d).alias("n"))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), float(b) - 1.0) for a, b in zip(t, n)])

    return agg.withColumn("p_value", p_value("t_stat", "n"))


def flip_signs(ids: list[str], flips: int, seed: int) -> np.ndarray:
    """(rows x flips) of -1 and 1: the bits of md5(seed:block:id), 128 flips to a block."""
    blocks = [np.frombuffer(b"".join(hashlib.md5(f"{seed}:{b}:{i}".encode()).digest() for i in ids), np.uint8).reshape(len(ids), 16)
              for b in range(-(-flips // 128))]
    return 1 - 2 * np.unpackbits(np.hstack(blocks), axis=1)[:, :flips].astype(np.int8) if ids else np.zeros((0, flips), np.int8)


def permutation_p(df: DataFrame, loss_a: str, loss_b: str, id_col: str, by: list[str] | None = None, flips: int = 1000, seed: int = 42) -> DataFrame:
    """EVL05: sign-flip permutation test of per-row loss differences, against a model on the controls say.

    Under the hypothesis that the models are equally good a difference's sign is a coin toss.  ``flips`` times all
    signs are drawn (bits of a hash of seed and id, so the draw doesn't depend on partitions) and the sums compared
    with the one that was seen: p = (1 + sums as far from 0) / (1 + flips), two-sided.  One pass and one aggregate:
    a task adds up its rows' sums per group, a group's row has ``flips`` numbers.  Rows with a null loss are left out.
    Returns ``by``, the mean difference, n and p_value."""
    by = by or []
    d = (F.col(loss_a) - F.col(loss_b)).alias("_d")
    rows = df.select(*by, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), d).filter(F.col("_d").isNotNull())
    keyed = rows.withColumn("_key", F.to_json(F.struct(*by)) if by else F.lit(""))

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for a in range(0, len(pdf), 8192):
                part = pdf.iloc[a:a + 8192]
                diff, signs = part["_d"].to_numpy(), flip_signs(part["_id"].tolist(), flips, seed)
                for key, at in part.groupby("_key").indices.items():
                    own = diff[at]
                    sums = np.concatenate([[len(own), own.sum(), np.abs(own).sum()], own @ signs[at]])
                    held[key] = held[key] + sums if key in held else sums
        if held:
            yield pd.DataFrame({"_key": [k for k in held for _ in range(flips + 3)], "pos": np.tile(np.arange(flips + 3), len(held)),
                                "v": np.concatenate(list(held.values()))})
    parts = keyed.select("_key", "_id", "_d").mapInPandas(run, "_key string, pos int, v double")
    sums = parts.groupBy("_key", "pos").agg(F.sum("v").alias("v")).groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))  # flips + 3 numbers a group
    slack = F.col("m")[2] * 1e-12  # sums that differ by their rounding alone are as far
    as_far = F.size(F.filter(F.map_entries(F.col("m")), lambda e: (e["key"] > 2) & (F.abs(e["value"]) >= F.abs(F.col("m")[1]) - slack)))
    found = sums.select("_key", (F.col("m")[1] / F.col("m")[0]).alias("mean_difference"), F.col("m")[0].cast("long").alias("n"),
                        ((as_far + 1) / F.lit(flips + 1)).alias("p_value"))
    if not by:
        return found.drop("_key")
    names = keyed.select(*by, "_key").distinct()  # one row per group
    return names.join(found, "_key").drop("_key")


def split_metrics(df: DataFrame, l0: str, l1: str, label: str, by: list[str]) -> DataFrame:
    """EVL06: row-mean loss, accuracy and AUC per group of ``by`` (e.g. split, epoch)."""
    s = df.select(*by, label, cross_entropy2(l0, l1, label).alias("_loss"),
                  argmax2(l0, l1).alias("_pred"), softmax2(l0, l1).alias("_p1"))
    base = s.groupBy(*by).agg(F.avg("_loss").alias("loss"),
                              F.avg((F.col("_pred") == F.col(label)).cast("double")).alias("accuracy"))
    auc = roc_auc(s, label, "_p1", by).withColumnsRenamed({b: f"_b{i}" for i, b in enumerate(by)})
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    return base.join(auc, reduce(and_, same)).drop(*[f"_b{i}" for i in range(len(by))])
