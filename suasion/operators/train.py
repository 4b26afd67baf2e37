"""Classifiers on frozen vectors (TRN01-05, SCO01, SNK07).

(a) Classifiers for the k-fold paths: ``lr`` and ``rf`` are Spark ML's, ``etc`` the
    extremely randomised trees of ``extra_trees`` (all folds in one growth).
(b) An own epoch loop for the reference's trainer: a 2-logit softmax head with
    coupled L2 (``weight_decay``) and Adam, zero-initialised (so the two logits
    stay antisymmetric and one weight vector suffices).  One epoch = one full-batch
    gradient job over the persisted vectors; many settings (a grid) share that
    one job — each task multiplies its Arrow batch by the stacked weight matrix.
    Only weights (d × settings) and per-epoch sums reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.operators import extra_trees, minibatch, newton
from suasion.operators.evaluate import roc_auc
from suasion.session import checkpointed, stored


# TRN01 (a) / TRN03 / TRN04 -----------------------------------------------------------
def make_estimator(model: str = "lr", reg_param: float = 0.0, seed: int = 42, max_iter: int = 100,
                   trees: int = 100, max_depth: int = 8):
    """``lr``: logistic regression; ``rf``: random forest of ``trees`` trees up to ``max_depth`` (Spark's own
    bound is 30).  ``etc`` has no Spark estimator: see ``extra_trees``."""
    if model == "lr":
        # multinomial regParam = wd equals binomial regParam = wd / 2 (intercept not penalised)
        return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg_param, elasticNetParam=0.0,
                                  standardization=False, maxIter=max_iter, family="binomial")
    if model == "rf":
        return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=max_depth,
                                      featureSubsetStrategy="sqrt", seed=seed)
    raise ValueError(f"no model is called {model!r}")


def _ml_input(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(features)).withColumn("_y", F.col(label).cast("double"))


def fit(df: DataFrame, features: str = "features", label: str = "persuaded", model: str = "lr",
        reg_param: float = 0.0, seed: int = 42, **params):
    """Fit on the rows that have a label; ``params`` go to ``make_estimator`` or, for ``etc``, to ``extra_trees.fit``."""
    if model == "etc":
        return extra_trees.fit(df, features, label, seed=seed, **params)
    return make_estimator(model, reg_param, seed, **params).fit(_ml_input(df.filter(F.col(label).isNotNull()), features, label))


def score(model, df: DataFrame, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Class-1 probability and prediction; ``keep`` columns pass through."""
    keep = keep or [c for c in df.columns if c != features]
    if isinstance(model, extra_trees.Forest):
        return extra_trees.score(model, df, features, keep)
    out = model.transform(df.withColumn("_x", array_to_vector(features)))
    return out.select(*keep, vector_to_array("probability")[1].alias("p1"),
                      F.col("prediction").cast("int").alias("pred"))


MAX_FOLDS = 100


def fold_values(df: DataFrame, fold_col: str) -> list:
    """The folds in order; raises beyond MAX_FOLDS (a fold column has few values)."""
    found = [r[0] for r in df.select(fold_col).filter(F.col(fold_col).isNotNull()).distinct()
             .orderBy(fold_col).limit(MAX_FOLDS + 1).collect()]
    if len(found) > MAX_FOLDS:
        raise ValueError(f"{fold_col} has more than {MAX_FOLDS} values")
    return found


def kfold_scores(df: DataFrame, fold_col: str, features: str = "features", label: str = "persuaded",
                 model: str = "lr", reg_param: float = 0.0, keep: list[str] | None = None, **params) -> DataFrame:
    """Out-of-fold scores: for each fold fit on the others, score it; union of all folds.  The input is
    written once to the shared folder, and every fold re-reads it (``etc`` grows all folds' trees together)."""
    if model == "etc":
        return extra_trees.kfold_scores(df, fold_col, features, label, keep, **params)
    data = checkpointed(df)
    keep = keep or [c for c in df.columns if c != features]
    out = None
    for k in fold_values(data, fold_col):
        m = fit(data.filter(F.col(fold_col) != k), features, label, model, reg_param, **params)
        s = score(m, data.filter(F.col(fold_col) == k), features, keep)
        out = s if out is None else out.unionByName(s)
    return out


# TRN05 ------------------------------------------------------------------------------
def nested_fits(df: DataFrame, fold_col: str, reg_params: list[float], features: str = "features", label: str = "persuaded"):
    """Logistic fits of every strength without each fold and without each two folds, all in common Newton passes.
    Returns (stored rows (x, y, fold), folds, strengths and left-out folds per column, weights, gradients, passes)."""
    x = F.concat(F.array(F.lit(1.0)), F.col(features))
    data = stored(df.filter(F.col(fold_col).isNotNull() & F.col(label).isNotNull()).select(
        x.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold_col).cast("int").alias("fold")), "nested")
    folds = fold_values(data, "fold")
    if len(folds) < 3:
        raise ValueError("a nested search needs three folds")
    penalties, left_out = newton.nested_columns(folds, reg_params)
    return data, folds, penalties, left_out, *newton.fit_logistic(data, folds, penalties, left_out)


def l2_search(df: DataFrame, fold_col: str, reg_params: list[float], features: str = "features",
              label: str = "persuaded") -> DataFrame:
    """Nested choice of the L2 strength: for each outer fold, every strength is fitted without it and each
    inner fold in turn and ranked by its mean AUC on the inner folds; the best (ties → weaker penalty),
    fitted on all other folds, is scored on the outer fold.

    Returns (outer_fold, inner_folds, reg_param, inner_auc, chosen, outer_auc)."""
    data, folds, penalties, left_out, weights, _, _ = nested_fits(df, fold_col, reg_params, features, label)
    mine = [[c for c, left in enumerate(left_out) if f in left] for f in folds]  # the columns that a fold's rows test
    columns = F.array(*[F.array(*[F.lit(c) for c in own]) for own in mine])
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")).cast("int") - 1
    tested = data.select("fold", F.col("y").cast("int").alias("y"), newton.dots(F.col("x"), weights).alias("_h"), F.explode(columns[place]).alias("column"))
    scored = tested.select("fold", "column", "y", F.col("_h")[F.col("column")].alias("h"))
    auc = {(r["column"], r["fold"]): float(r["roc_auc"]) for r in roc_auc(scored, "y", "h", ["column", "fold"]).collect()}  # folds x columns
    strengths = {(p, left): c for c, (p, left) in enumerate(zip(penalties.tolist(), left_out, strict=True))}
    rows = []
    for outer in folds:
        inner = [f for f in folds if f != outer]
        means = [float(np.mean([auc[strengths[float(p), tuple(sorted((outer, i)))], i] for i in inner])) for p in reg_params]
        best = min(range(len(reg_params)), key=lambda j: (-means[j], reg_params[j]))
        rows += [(int(outer), len(inner), float(p), means[j], j == best, auc[strengths[float(p), (outer,)], outer] if j == best else None)
                 for j, p in enumerate(reg_params)]
    # one row per (fold, strength)
    return df.sparkSession.createDataFrame(rows, "outer_fold int, inner_folds int, reg_param double, inner_auc double, "
                                                 "chosen boolean, outer_auc double")


def l2_search_heads(df: DataFrame, fold_col: str, weight_decays: list[float], features: str = "features",
                    label: str = "persuaded", lr: float = 0.05, epochs: int = 15) -> DataFrame:
    """TRN05 on the one-pass trainer: every L2 strength × every fold trained together;
    ranked by out-of-fold AUC (ties → weaker penalty)."""
    settings = [HeadSetting(f"wd={wd:g}", lr=lr, weight_decay=float(wd)) for wd in weight_decays]
    _, oof = kfold_heads(df, fold_col, settings, features, label, epochs)
    auc = roc_auc(oof, label, "p1", ["run_id"])
    wd_of = F.element_at(F.create_map(*[x for s in settings for x in (F.lit(s.run_id), F.lit(s.weight_decay))]),
                         F.col("run_id"))
    return auc.select("run_id", wd_of.alias("weight_decay"), "roc_auc").orderBy(
        F.desc("roc_auc"), F.asc("weight_decay"))


# TRN02 ------------------------------------------------------------------------------
def early_stopping(losses: DataFrame, group: str, epoch: str = "epoch", loss: str = "eval_loss",
                   patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """Apply the stopping rule to a per-group epoch-loss table.

    Improvement iff ``loss + min_delta < best``; stop once ``patience`` epochs in a row
    did not improve (``patience <= 0`` never stops).  Per group the epoch list is
    folded in epoch order with ``aggregate`` — a group holds one row per epoch.
    """
    ordered = losses.groupBy(group).agg(F.array_sort(F.collect_list(
        F.struct(F.col(epoch).cast("int").alias("e"), F.col(loss).cast("double").alias("l")))).alias("_s"))
    init = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("bad"),
                    F.lit(False).alias("stopped"), F.lit(0).alias("last"))

    def step(acc, x):
        better = (x["l"] + F.lit(float(min_delta))) < acc["best"]
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        nxt = F.struct(F.when(better, x["l"]).otherwise(acc["best"]).alias("best"),
                       F.when(better, x["e"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
                       bad.alias("bad"),
                       ((F.lit(patience) > 0) & (bad >= F.lit(patience))).alias("stopped"),
                       x["e"].alias("last"))
        return F.when(acc["stopped"], acc).otherwise(nxt)

    r = ordered.select(group, F.aggregate("_s", init, step).alias("_r"))
    return r.select(group, F.col("_r.best_epoch").alias("best_epoch"), F.col("_r.best").alias("best_loss"),
                    F.col("_r.last").alias("stop_epoch"), F.col("_r.stopped").alias("stopped_early"))


# TRN01 (b) / GRD02 -------------------------------------------------------------------
@dataclass
class HeadSetting:
    run_id: str
    lr: float = 0.001
    weight_decay: float = 0.0
    patience: int = 3
    min_delta: float = 0.0
    epochs: int | None = None
    load_best: bool = True
    batch_size: int | None = None  # None: one step per epoch over all rows
    seed: int = 42  # of the batches
    extra: dict = field(default_factory=dict)


def _epoch_sums(data: DataFrame, features: str, label: str, split: str, theta, col_folds=None):
    """One distributed pass over the persisted vectors for all C weight columns.

    Split mode (``col_folds`` None): every column trains on ``split = 'train'`` rows and
    is validated on ``split = 'validation'``.  Fold mode: column c trains on rows whose
    fold (in ``split``) differs from ``col_folds[c]`` and is validated on that fold.
    Returns gradient sums ((d+1) × C) and per-column loss / hit / row sums for the
    training and validation rows.
    """
    th = data.sparkSession.sparkContext.broadcast(np.asarray(theta))  # (d+1) × C, bounded by d·C
    C = th.value.shape[1]
    folds = None if col_folds is None else np.asarray(col_folds, dtype="float64")[None, :]

    def run(it):
        w = th.value
        G = np.zeros_like(w)
        acc = np.zeros((6, C))  # loss_tr, hit_tr, n_tr, loss_va, hit_va, n_va
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf[features].to_numpy())
            X1 = np.hstack([X, np.ones((X.shape[0], 1))])
            y = pdf[label].to_numpy().astype("float64")[:, None]
            d = 2.0 * (X1 @ w)  # logit difference z1 - z0, rows × C
            e = np.exp(-np.abs(d))
            p = np.where(d >= 0, 1.0 / (1.0 + e), e / (1.0 + e))
            loss = np.where(y > 0, np.logaddexp(0.0, -d), np.logaddexp(0.0, d))
            hit = ((d > 0).astype("float64") == y).astype("float64")
            if folds is None:
                sv = pdf[split].to_numpy()
                tr = np.repeat((sv == "train")[:, None], C, axis=1)
                va = np.repeat((sv == "validation")[:, None], C, axis=1)
            else:
                fv = pd.to_numeric(pdf[split]).to_numpy(dtype="float64")[:, None]
                va = fv == folds
                tr = ~va & ~np.isnan(fv)
            tr, va = tr.astype("float64"), va.astype("float64")
            G += X1.T @ ((p - y) * tr)
            acc += np.vstack([(loss * tr).sum(0), (hit * tr).sum(0), tr.sum(0),
                              (loss * va).sum(0), (hit * va).sum(0), va.sum(0)])
        flat = np.concatenate([G.ravel(), acc.ravel()])
        yield pd.DataFrame({"pos": np.arange(len(flat)), "v": flat})

    # summed by position: a reducer's rows are numbers, however many tasks there are
    parts = data.select(features, label, split).mapInPandas(run, "pos long, v double")
    summed = parts.groupBy("pos").agg(F.sum("v").alias("v")).collect()  # the size of the weights
    th.unpersist()
    flat = np.zeros(theta.shape[0] * C + 6 * C)
    flat[[r["pos"] for r in summed]] = [r["v"] for r in summed]
    w_size = (theta.shape[0]) * C
    a = flat[w_size:].reshape(6, C)
    return {"grad": flat[:w_size].reshape(theta.shape), "loss_tr": a[0], "hit_tr": a[1], "n_tr": a[2],
            "loss_va": a[3], "hit_va": a[4], "n_va": a[5]}


def _adam_loop(data: DataFrame, settings: list[HeadSetting], features: str, label: str, split: str,
               epochs: int, col_folds=None, col_runs=None):
    """Adam with coupled L2 and per-column early stopping and epoch limit (a setting's own
    ``epochs``, else ``epochs``); one distributed pass per epoch serves every column together."""
    d = data.select(F.max(F.size(features))).first()[0]
    col_runs = col_runs if col_runs is not None else list(range(len(settings)))
    C = len(col_runs)
    lr = np.array([settings[r].lr for r in col_runs])
    wd = np.array([settings[r].weight_decay for r in col_runs])
    theta = np.zeros((d + 1, C))
    m = np.zeros_like(theta)
    v = np.zeros_like(theta)
    b1, b2, eps = 0.9, 0.999, 1e-8
    active = np.ones(C, dtype=bool)
    best = np.full(C, math.inf)
    best_epoch = np.zeros(C, dtype=int)
    bad = np.zeros(C, dtype=int)
    best_theta = theta.copy()
    stopped = np.zeros(C, dtype=bool)
    rows = []
    # one pass per epoch: the sums at the new weights give this epoch's validation
    # metrics *and* the next epoch's gradient (epochs + 1 passes in total)
    before = _epoch_sums(data, features, label, split, theta, col_folds)
    limit = np.array([settings[r].epochs or epochs for r in col_runs])
    for ep in range(1, int(limit.max(initial=0)) + 1):
        active &= ep <= limit
        if not active.any():
            break
        g = before["grad"] / np.maximum(before["n_tr"], 1.0) + wd * theta
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        step = lr * (m / (1 - b1 ** ep)) / (np.sqrt(v / (1 - b2 ** ep)) + eps)
        theta = np.where(active, theta - step, theta)
        after = _epoch_sums(data, features, label, split, theta, col_folds)
        for c in range(C):
            if not active[c]:
                continue
            s = settings[col_runs[c]]
            ntr, nva = max(before["n_tr"][c], 1.0), after["n_va"][c]
            el = after["loss_va"][c] / nva if nva else float("nan")
            ea = after["hit_va"][c] / nva if nva else float("nan")
            rows.append((s.run_id, None if col_folds is None else int(col_folds[c]), ep,
                         float(before["loss_tr"][c] / ntr), float(before["hit_tr"][c] / ntr), float(el), float(ea)))
            if el + s.min_delta < best[c]:
                best[c], best_epoch[c], bad[c] = el, ep, 0
                best_theta[:, c] = theta[:, c]
            else:
                bad[c] += 1
            if s.patience > 0 and bad[c] >= s.patience:
                active[c] = False
                stopped[c] = True
        before = after
    return rows, theta, best_theta, best_epoch, stopped


METRICS_SCHEMA = ("run_id string, fold int, epoch int, train_loss double, train_acc double, "
                  "eval_loss double, eval_acc double")


def _train_columns(data: DataFrame, settings: list[HeadSetting], features: str, label: str, split: str, key: str, epochs: int,
                   col_folds: list | None = None, col_runs: list[int] | None = None, rows_per_block: int | None = None):
    """``_adam_loop`` for the columns without a batch size, mini-batches for the others; one result."""
    runs = col_runs if col_runs is not None else list(range(len(settings)))
    small = np.array([settings[r].batch_size is not None for r in runs])
    parts = []
    if (~small).any() or not len(small):
        at = np.flatnonzero(~small)
        parts.append((at, _adam_loop(data, settings, features, label, split, epochs, None if col_folds is None else [col_folds[c] for c in at],
                                     [runs[c] for c in at])))
    if small.any():
        at = np.flatnonzero(small)
        mine = [settings[runs[c]] for c in at]
        columns = minibatch.Columns(*[np.array([getattr(s, n) for s in mine]) for n in ("lr", "weight_decay", "batch_size", "seed")],
                                    [None if col_folds is None else col_folds[c] for c in at])
        blocks = minibatch.packed(data, features, label, split, key, rows_per_block)
        width = data.select(F.max(F.size(features))).first()[0] or 0
        rows, *rest = minibatch.train(blocks, width, columns, np.array([s.epochs or epochs for s in mine]),
                                      np.array([s.patience for s in mine]), np.array([s.min_delta for s in mine]))
        named = [(mine[c].run_id, columns.fold[c], ep, *map(float, values)) for c, ep, *values in rows]
        parts.append((at, (named, *rest)))
    rows = [r for _, (found, *_) in parts for r in found]
    shape = parts[0][1][1].shape[0]
    theta, best = np.zeros((shape, len(runs))), np.zeros((shape, len(runs)))
    best_epoch, stopped = np.zeros(len(runs), dtype=int), np.zeros(len(runs), dtype=bool)
    for at, (_, last, good, epoch, early) in parts:
        theta[:, at], best[:, at], best_epoch[at], stopped[at] = last, good, epoch, early
    return rows, theta, best, best_epoch, stopped


def _with_key(df: DataFrame, features: str, label: str, id_col: str | None):
    """The row's key of the batches' order: an id or, without one, a hash of the row."""
    return F.xxhash64(features, label).cast("string") if id_col is None else F.col(id_col).cast("string")


def train_heads(df: DataFrame, settings: list[HeadSetting], features: str = "features",
                label: str = "persuaded", split: str = "split", epochs: int = 30, id_col: str | None = None,
                rows_per_block: int | None = None) -> tuple[DataFrame, dict]:
    """Train one head per setting on rows with split 'train', validate on 'validation'.

    Returns (epoch metrics DataFrame, {run_id: final state}).  Early stopping per
    run watches eval loss (TRN02).  A state has the weights of the best and of the last
    epoch; ``theta`` is the one the setting's ``load_best`` asks for.  Rows without a label
    are left out.  A setting with a ``batch_size`` takes mini-batches (``minibatch``), whose order
    follows its ``seed`` and ``id_col`` (a hash of the row without one).
    """
    spark = df.sparkSession
    data = checkpointed(df.select(features, F.col(label).cast("int").alias(label), split, _with_key(df, features, label, id_col).alias("_key"))
                        .filter(F.col(label).isNotNull()))
    rows, theta, best_theta, best_epoch, stopped = _train_columns(
        data.filter(F.col(split).isin("train", "validation")), settings, features, label, split, "_key", epochs, rows_per_block=rows_per_block)
    metrics = spark.createDataFrame(rows, METRICS_SCHEMA).drop("fold")
    last = {r[0]: r[2] for r in rows}
    final = {s.run_id: {"theta": (best_theta if s.load_best else theta)[:, c].tolist(), "best_epoch": int(best_epoch[c]),
                        "stopped_early": bool(stopped[c]), "best_theta": best_theta[:, c].tolist(),
                        "last_theta": theta[:, c].tolist(), "last_epoch": last.get(s.run_id, 0)}
             for c, s in enumerate(settings)}
    return metrics, final


def kfold_heads(df: DataFrame, fold_col: str, settings: list[HeadSetting], features: str = "features",
                label: str = "persuaded", epochs: int = 30, keep: list[str] | None = None,
                use_best: bool = True, id_col: str | None = None, rows_per_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K-fold × grid in one pass per epoch: column (setting s, fold f) trains on the
    other folds and validates on f.  Returns (epoch metrics, out-of-fold scores with
    one row per input row and setting: ``run_id, <keep>, p1, pred``)."""
    spark = df.sparkSession
    data = checkpointed(df.select(*(keep or []), features, F.col(label).cast("int").alias(label),
                                  F.col(fold_col).cast("int").alias(fold_col), _with_key(df, features, label, id_col).alias("_key"))
                        .filter(F.col(label).isNotNull()))
    folds = fold_values(data, fold_col)
    col_runs = [r for r in range(len(settings)) for _ in folds]
    col_folds = [f for _ in settings for f in folds]
    rows, theta, best_theta, _, _ = _train_columns(data, settings, features, label, fold_col, "_key", epochs,
                                                   col_folds, col_runs, rows_per_block)
    W = best_theta if use_best else theta
    metrics = spark.createDataFrame(rows, METRICS_SCHEMA)
    # one scan scores every setting: a row's own fold picks the column; the weights are d × settings × folds
    sent = spark.sparkContext.broadcast(W.reshape(W.shape[0], len(settings), len(folds)))
    place = {f: i for i, f in enumerate(folds)}

    @F.pandas_udf("array<double>")
    def dots(x: pd.Series, fold: pd.Series) -> pd.Series:
        w = sent.value
        X = np.hstack([np.vstack(x.tolist()), np.ones((len(x), 1))])
        z = np.einsum("nd,dsk->nsk", X, w)[np.arange(len(x)), :, [place[f] for f in fold]]
        return pd.Series(list(z))
    names = F.array(*[F.lit(s.run_id) for s in settings])
    rows_ = data.filter(F.col(fold_col).isNotNull()).select(
        *(keep or []), F.col(fold_col), F.col(label), F.posexplode(dots(features, fold_col)).alias("_i", "_dot"))
    scored = rows_.select(F.element_at(names, F.col("_i") + 1).alias("run_id"), *(keep or []), F.col(fold_col), F.col(label),
                          (1.0 / (1.0 + F.exp(-2.0 * F.col("_dot")))).alias("p1"),
                          F.when(F.col("_dot") > 0, 1).otherwise(0).alias("pred"))
    return metrics, scored


def head_logit(theta: list[float], features: str = "features"):
    """w·x + b of a vector column, one matrix product per Arrow batch (the weights go with the function)."""
    w = np.asarray(theta, dtype="float64")

    @F.pandas_udf("double")
    def dot(x: pd.Series) -> pd.Series:
        return pd.Series(np.vstack(x.tolist()) @ w[:-1] + w[-1]) if len(x) else pd.Series([], dtype="float64")
    return dot(F.col(features))


def head_scores(df: DataFrame, theta: list[float], features: str = "features") -> DataFrame:
    """Score rows with a trained head: p1 = sigmoid(2·(w·x + b)); argmax tie → 0."""
    out = df.withColumn("_dot", head_logit(theta, features))
    return (out.withColumn("p1", 1.0 / (1.0 + F.exp(-2.0 * F.col("_dot"))))
            .withColumn("pred", F.when(F.col("_dot") > 0, 1).otherwise(0)).drop("_dot"))


# SNK07 ------------------------------------------------------------------------------
def save_head(spark, theta: list[float], epoch: int, path: str) -> None:
    spark.createDataFrame([(list(map(float, theta[:-1])), float(theta[-1]), int(epoch))],
                          "weights array<double>, bias double, epoch int").write.mode("overwrite").parquet(path)


def load_head(spark, path: str) -> tuple[list[float], int]:
    r = spark.read.parquet(path).first()
    return list(r["weights"]) + [r["bias"]], r["epoch"]


# SCO01 ------------------------------------------------------------------------------
def predictions_to_features(scored: DataFrame, group_id: str, feat_name: str = "persuaded_p1") -> DataFrame:
    """Class probabilities as a long feature table (D4)."""
    return scored.select(F.col(group_id).alias("group_id"), F.lit(feat_name).alias("feat"),
                         F.col("p1").alias("value"), F.col("p1").alias("group_norm"))
