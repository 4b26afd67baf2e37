"""FEA06 and TRN05 by sufficient statistics: one pass over the rows serves every fold and every penalty.

``fold_moments`` adds up the outer products of the rows' vectors per fold; a training set is the sum of
all folds less some, so least squares and ridge for any folds and penalties are small solves on the
driver.  ``fit_logistic`` takes Newton steps for many columns (a penalty, a set of left-out folds) at
once: one pass per step adds up every column's gradient and Hessian.  What reaches the driver is
folds x width² or columns x width² numbers, whatever the number of rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 21  # numbers in work at once


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    got = parts.groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[got["pos"].to_numpy(dtype=np.int64)] = got["v"].to_numpy()
    return out


def fold_moments(data: DataFrame, vector: str, fold: str, folds: list, width: int) -> np.ndarray:
    """(folds x width x width): the sum of u u' over each fold's rows.  One pass."""
    def run(batches):
        total = np.zeros((len(folds), width, width))
        for pdf in batches:
            if len(pdf):
                u, f = np.vstack(pdf[vector].to_numpy()), pdf[fold].to_numpy(dtype="float64")
                for k, value in enumerate(folds):
                    own = u[f == float(value)]
                    total[k] += own.T @ own
        yield pd.DataFrame({"pos": np.arange(total.size), "v": total.ravel()})
    size = len(folds) * width * width
    return _summed(data.select(vector, fold).mapInPandas(run, "pos long, v double"), size).reshape(len(folds), width, width)


def solve(moments: np.ndarray, x: np.ndarray, y: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Coefficients (intercept first) of ``y`` on ``x`` from the moments of vectors that begin with 1.  ``x``, ``y``: each a
    matrix whose columns are combinations of the vector's entries.  The penalty, ``penalty`` / 2 times the squared
    coefficients of the standardised columns, is added to half the mean squared error; the intercept is free, and
    columns that follow from others share their coefficient."""
    n = moments[0, 0]
    if not n:
        return np.zeros((x.shape[1] + 1, y.shape[1]))
    mean_x, mean_y = moments[0] @ x / n, moments[0] @ y / n
    cov = x.T @ moments @ x / n - np.outer(mean_x, mean_x)
    both = x.T @ moments @ y / n - np.outer(mean_x, mean_y)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    spread = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean_x)), spread, np.inf)  # a constant column gets 0
    b = np.linalg.pinv(cov / spread[:, None] / spread[None, :] + penalty * np.diag(np.isfinite(spread).astype(float)), rcond=1e-12, hermitian=True) \
        @ (both / spread[:, None]) / spread[:, None]
    return np.vstack([mean_y - mean_x @ b, b])


def dots(column, weights: np.ndarray, fold=None, folds: list | None = None):
    """Products of a vector column with (width x columns) weights or, with folds, with the row's fold's
    (folds x width x columns)."""
    if fold is None:
        @F.pandas_udf("array<double>")
        def product(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.vstack(x.tolist()) @ weights)) if len(x) else pd.Series([], dtype=object)
        return product(column)
    place = {float(f): k for k, f in enumerate(folds)}

    @F.pandas_udf("array<double>")
    def product_of(x: pd.Series, f: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.einsum("nd,ndc->nc", np.vstack(x.tolist()), weights[[place[float(v)] for v in f]])))
    return product_of(column, fold)


def ridge_kfold(data: DataFrame, label: str, features: str, fold_col: str, penalties: list[float], keep: list[str] | None = None) -> DataFrame:
    """Out-of-fold predictions of every penalty: ``keep``, fold, label, penalty, prediction.  Two passes in all, one for the
    moments and one for the predictions.  Rows without a fold or label are left out."""
    from suasion.operators.train import fold_values
    keep = keep or []
    rows = data.filter(F.col(fold_col).isNotNull() & F.col(label).isNotNull())
    u = F.concat(F.array(F.lit(1.0)), F.col(features), F.array(F.col(label).cast("double")))
    rows = rows.select(*keep, F.col(fold_col).alias("fold"), F.col(label).cast("double").alias(label), u.alias("_u"))
    folds, width = fold_values(rows, "fold"), rows.select(F.max(F.size("_u"))).first()[0] or 2
    moments = fold_moments(rows, "_u", "fold", folds, width)
    eye = np.eye(width)
    weights = np.zeros((len(folds), width, len(penalties)))
    for k in range(len(folds)):
        for j, penalty in enumerate(penalties):
            weights[k, :-1, j] = solve(moments.sum(0) - moments[k], eye[:, 1:-1], eye[:, -1:], penalty)[:, 0]
    of = F.array(*[F.lit(float(p)) for p in penalties])
    return (rows.withColumn("_p", dots(F.col("_u"), weights, F.col("fold"), folds))
            .select(*keep, "fold", label, F.inline(F.arrays_zip(of.alias("penalty"), F.col("_p").alias("prediction")))))


def rfa_weights(moments: np.ndarray, n_factors: int, penalty: float) -> np.ndarray:
    """(folds x width x 2) weights of step 1 and step 2 on vectors (1, factors, features and products, outcome), each fit
    on the other folds: the residual's moments follow from the outcome's, so no second pass is needed."""
    folds, width, _ = moments.shape
    eye, out = np.eye(width), np.zeros((folds, width, 2))
    for k in range(folds):
        rest = moments.sum(0) - moments[k]
        one = solve(rest, eye[:, 1:1 + n_factors], eye[:, -1:])[:, 0]
        out[k, :1 + n_factors, 0] = one
        residual = eye[:, -1:].copy()
        residual[:1 + n_factors, 0] -= one
        two = solve(rest, eye[:, 1 + n_factors:-1], residual, penalty)[:, 0]
        out[k, 0, 1] = two[0]
        out[k, 1 + n_factors:-1, 1] = two[1:]
    return out


# logistic regression ---------------------------------------------------------------------
def _logistic_pass(data: DataFrame, width: int, folds: list, beta: np.ndarray, out_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loss sums, gradient sums, Hessian sums, rows) of every column over the folds it doesn't leave out."""
    count = beta.shape[1]
    sent = data.sparkSession.sparkContext.broadcast(beta)  # width x columns

    def run(batches):
        beta = sent.value
        loss, grad, hess, n = np.zeros(count), np.zeros((count, width)), np.zeros((count, width, width)), np.zeros(count)
        for pdf in batches:
            if not len(pdf):
                continue
            every, label, fold = np.vstack(pdf["x"].to_numpy()), pdf["y"].to_numpy(dtype="float64"), pdf["fold"].to_numpy(dtype="float64")
            step = max(1, CELLS // (count + width))
            for a in range(0, len(every), step):
                x, y, f = every[a:a + step], label[a:a + step, None], fold[a:a + step]
                held = np.stack([out_of[k] for k in range(len(folds))])[np.searchsorted(np.array(folds, float), f)]
                use = (~held).astype("float64")  # rows x columns
                h = x @ beta
                e = np.exp(-np.abs(h))
                p = np.where(h >= 0, 1 / (1 + e), e / (1 + e))
                loss += ((np.logaddexp(0.0, h) - y * h) * use).sum(0)
                n += use.sum(0)
                grad += ((p - y) * use).T @ x
                w = p * (1 - p) * use
                for c in range(count):
                    hess[c] += x.T @ (x * w[:, c:c + 1])
        flat = np.concatenate([loss, grad.ravel(), hess.ravel(), n])
        yield pd.DataFrame({"pos": np.arange(len(flat)), "v": flat})
    size = count * (2 + width + width * width)
    flat = _summed(data.select("x", "y", "fold").mapInPandas(run, "pos long, v double"), size)
    sent.unpersist()
    loss, grad, hess, n = np.split(flat, np.cumsum([count, count * width, count * width * width]))
    return loss, grad.reshape(count, width), hess.reshape(count, width, width), n


def fit_logistic(data: DataFrame, folds: list, penalties: np.ndarray, left_out: list[tuple], tolerance: float = 1e-9, most_steps: int = 50):
    """Minimise mean log loss + penalty / 2 |b|² (the intercept, the vector's first entry, is free) for every column at
    once: column c has ``penalties[c]`` and trains on the folds not in ``left_out[c]``.  ``data``: (x, y, fold), x beginning
    with 1.  A Newton step that raises a column's loss is halved.  Returns (weights, gradients at them, passes); a column
    whose data a hyperplane separates has no minimum without a penalty and stops after ``most_steps``."""
    width = data.select(F.max(F.size("x"))).first()[0] or 1
    count = len(penalties)
    out_of = np.array([[f in left for left in left_out] for f in folds], dtype=bool).reshape(len(folds), count)
    ridge = np.ones(width)
    ridge[0] = 0.0
    beta, step = np.zeros((width, count)), np.zeros((width, count))
    good, best, gradient = beta.copy(), np.full(count, np.inf), np.zeros((count, width))
    done = np.zeros(count, bool)
    for passes in range(1, most_steps + 1):
        loss, grad, hess, n = _logistic_pass(data, width, folds, beta, out_of)
        n = np.maximum(n, 1)
        value = loss / n + penalties / 2 * (ridge[:, None] * beta ** 2).sum(0)
        g = grad / n[:, None] + (penalties[:, None] * ridge) * beta.T
        worse = value > best + 1e-13 * np.maximum(1, np.abs(best))
        for c in np.flatnonzero(~done):
            if worse[c]:
                step[:, c] /= 2
                beta[:, c] = good[:, c] + step[:, c]
                done[c] = np.abs(step[:, c]).max() < 1e-15
                continue
            good[:, c], best[c], gradient[c] = beta[:, c], value[c], g[c]
            if np.abs(g[c]).max() <= tolerance:
                done[c] = True
                continue
            h = hess[c] / n[c] + np.diag(penalties[c] * ridge)
            step[:, c] = -np.linalg.lstsq(h, g[c], rcond=1e-12)[0]
            beta[:, c] = good[:, c] + step[:, c]
        if done.all():
            break
    return good, gradient, passes


def nested_columns(folds: list, reg_params: list[float]) -> tuple[np.ndarray, list[tuple]]:
    """Every penalty with every fold left out and with every two (outer and inner fold share a model either way round)."""
    sets = [(f,) for f in folds] + list(combinations(folds, 2))
    return np.repeat(np.array(reg_params, float), len(sets)), sets * len(reg_params)
