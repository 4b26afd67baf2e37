"""TRN01 — mini-batch Adam on frozen vectors, many columns (settings x folds) at once.

The rows are put into blocks once: positions in the order of md5(key) are cut every
``rows_per_block`` rows, and a block is one row of the written table, its vectors packed end to
end (at most BLOCK_BYTES).  An epoch is one distributed pass: each task starts its blocks from
the common weights, shuffles a block's training rows by md5(seed:epoch:key) and takes Adam steps
over batches of ``batch_size``; weights, both moments and the number of steps are then averaged
over the blocks by their training rows.  A table of one block is plain mini-batch Adam; one of
more blocks is the same with averaging after each epoch.  Blocks follow from the rows alone, so
the result depends neither on the partitions nor on the number of tasks.

The pass of an epoch also validates the weights it starts from, so ``epochs + 1`` passes serve
all columns.  Rows with equal keys are told apart by nothing: they may swap places.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.operators.numbering import global_index
from suasion.session import checkpointed

BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 26
B1, B2, EPS = 0.9, 0.999, 1e-8
PACKED = "block long, keys array<string>, y array<double>, part array<string>, x binary"


def packed(data: DataFrame, features: str, label: str, part: str, key: str, rows_per_block: int | None = None) -> DataFrame:
    """Blocks of rows, training rows first where ``part`` names splits.  Written."""
    width = data.select(F.max(F.size(features))).first()[0] or 0
    rows = rows_per_block or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (width + 1))))
    named = data.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(part).cast("string").alias("part"),
                        F.col(key).cast("string").alias("key"))
    order = [(F.col("part") == "validation").cast("int"), F.md5(F.coalesce("key", F.lit("")).cast("binary")), F.col("key")]
    placed = global_index(named.filter(F.col("part").isNotNull()), order, "_i")
    cells = F.struct("_i", "key", "y", "part", "x")
    blocks = placed.groupBy(F.floor(F.col("_i") / rows).alias("block")).agg(F.array_sort(F.collect_list(cells)).alias("r"))  # ``rows`` of them

    def pack(batches):
        for pdf in batches:
            out = [{"block": b, "keys": [c["key"] or "" for c in r], "y": [c["y"] for c in r], "part": [c["part"] for c in r],
                    "x": np.array([c["x"] for c in r], dtype="<f8").tobytes()} for b, r in zip(pdf["block"], pdf["r"], strict=True)]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PACKED.split(", ")])
    return checkpointed(blocks.mapInPandas(pack, PACKED))


@dataclass
class Columns:
    """What the columns of the stacked weights stand for."""
    lr: np.ndarray
    decay: np.ndarray
    batch: np.ndarray
    seed: np.ndarray
    fold: list  # the fold a column leaves out and is validated on; None: the splits say it

    def groups(self, chosen: np.ndarray):
        """Columns that see the same batches."""
        found: dict[tuple, list[int]] = {}
        for c in np.flatnonzero(chosen):
            found.setdefault((self.fold[c], int(self.batch[c]), int(self.seed[c])), []).append(int(c))
        return [(*k, np.array(v)) for k, v in found.items()]


def shuffled(keys: list[str], seed: int, epoch: int) -> np.ndarray:
    digests = [(hashlib.md5(f"{seed}:{epoch}:{k}".encode()).digest(), k) for k in keys]
    return np.array(sorted(range(len(keys)), key=digests.__getitem__), dtype=np.int64)


def losses(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """(probability of label 1, loss, hit) of each row and column: two logits -h and h, h = x w."""
    return losses_at(x @ w, y)


def losses_at(h: np.ndarray, y: np.ndarray):
    d = 2.0 * h
    e = np.exp(-np.abs(d))
    p = np.where(d >= 0, 1.0 / (1.0 + e), e / (1.0 + e))
    return p, np.where(y > 0, np.logaddexp(0.0, -d), np.logaddexp(0.0, d)), ((d > 0) == (y > 0)).astype("float64")


def _trained(x, y, keys, parts, state, columns: Columns, chosen, epoch):
    """One block's epoch: weights, moments and steps after it (times its training rows), and sums of loss, hits, rows."""
    theta, m, v, t = (s.copy() for s in state)
    sums = np.zeros((3, theta.shape[1]))
    orders: dict[int, np.ndarray] = {}
    for fold, batch, seed, cols in columns.groups(chosen):
        if seed not in orders:
            orders[seed] = shuffled(keys, seed, epoch)
        order = orders[seed]
        order = order[parts[order] == "train"] if fold is None else order[parts[order] != str(fold)]
        w, mc, vc, tc = theta[:, cols], m[:, cols], v[:, cols], t[cols]
        lr, decay = columns.lr[cols], columns.decay[cols]
        for a in range(0, len(order), batch):
            at = order[a:a + batch]
            p, loss, hit = losses(x[at], y[at, None], w)
            sums[:, cols] += np.stack([loss.sum(0), hit.sum(0), np.full(len(cols), len(at))])
            g = x[at].T @ (p - y[at, None]) / len(at) + decay * w
            tc = tc + 1
            mc, vc = B1 * mc + (1 - B1) * g, B2 * vc + (1 - B2) * g * g
            w = w - lr * (mc / (1 - B1 ** tc)) / (np.sqrt(vc / (1 - B2 ** tc)) + EPS)
        theta[:, cols], m[:, cols], v[:, cols], t[cols] = w, mc, vc, tc
    n = sums[2]
    return np.concatenate([(theta * n).ravel(), (m * n).ravel(), (v * n).ravel(), t * n, sums.ravel()])


def _validated(x, y, parts, theta, columns: Columns):
    sums = np.zeros((3, theta.shape[1]))
    for fold in dict.fromkeys(columns.fold):
        cols = np.array([c for c, f in enumerate(columns.fold) if f == fold])
        at = np.flatnonzero(parts == ("validation" if fold is None else str(fold)))
        if len(at):
            _, loss, hit = losses(x[at], y[at, None], theta[:, cols])
            sums[:, cols] = np.stack([loss.sum(0), hit.sum(0), np.full(len(cols), len(at))])
    return sums.ravel()


def _pass(blocks: DataFrame, state, columns: Columns, chosen: np.ndarray, epoch: int) -> np.ndarray:
    """Summed over the blocks: validation sums at the start, then what ``_trained`` gives for the chosen columns."""
    sent = blocks.sparkSession.sparkContext.broadcast((state, columns, chosen))  # the size of the weights

    def run(batches):
        state, columns, chosen = sent.value
        total = None
        for pdf in batches:
            for keys, y, parts, x in zip(pdf["keys"], pdf["y"], pdf["part"], pdf["x"], strict=True):
                y, parts = np.asarray(y, dtype="float64"), np.asarray(parts)
                x = np.frombuffer(x, "<f8").reshape(len(y), -1)
                x = np.hstack([x, np.ones((len(y), 1))])
                flat = np.concatenate([_validated(x, y, parts, state[0], columns),
                                       _trained(x, y, list(keys), parts, state, columns, chosen, epoch)])
                total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total)), "v": total})
    summed = blocks.mapInPandas(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    sent.unpersist()
    size, count = state[0].shape
    out = np.zeros(3 * count + 3 * size * count + count + 3 * count)
    out[summed["pos"].to_numpy(dtype=np.int64)] = summed["v"].to_numpy()
    return out


def train(blocks: DataFrame, width: int, columns: Columns, limit: np.ndarray, patience: np.ndarray, min_delta: np.ndarray):
    """Train every column for up to ``limit`` epochs with its own early stopping.  Returns (metrics: (column, epoch,
    train loss, train accuracy, validation loss, validation accuracy), last weights, best weights, best epoch,
    stopped)."""
    count = len(columns.lr)
    theta, m, v = (np.zeros((width + 1, count)) for _ in range(3))
    t = np.zeros(count)
    active, stopped = limit > 0, np.zeros(count, bool)
    best, best_epoch, bad, best_theta = np.full(count, math.inf), np.zeros(count, int), np.zeros(count, int), theta.copy()
    rows, size = [], theta.size
    found = _pass(blocks, (theta, m, v, t), columns, active, 1)
    for epoch in range(1, int(limit.max(initial=0)) + 1):
        if not active.any():
            break
        parts = np.split(found[3 * count:], np.cumsum([size, size, size, count]))
        loss, hit, n = parts[4].reshape(3, count)
        took = active & (n > 0)
        weight = np.maximum(n, 1)
        for held, new in ((theta, parts[0]), (m, parts[1]), (v, parts[2])):
            held[:, took] = (new.reshape(held.shape) / weight)[:, took]
        t = np.where(took, parts[3] / weight, t)
        after = active & (limit > epoch)
        found = _pass(blocks, (theta, m, v, t), columns, after, epoch + 1)
        loss_va, hit_va, n_va = found[:3 * count].reshape(3, count)
        with np.errstate(invalid="ignore", divide="ignore"):
            eval_loss, eval_hit = loss_va / n_va, hit_va / n_va
        for c in np.flatnonzero(active):
            rows.append((int(c), epoch, loss[c] / weight[c], hit[c] / weight[c], eval_loss[c], eval_hit[c]))
            if eval_loss[c] + min_delta[c] < best[c]:
                best[c], best_epoch[c], bad[c] = eval_loss[c], epoch, 0
                best_theta[:, c] = theta[:, c]
            else:
                bad[c] += 1
            if patience[c] > 0 and bad[c] >= patience[c]:
                stopped[c] = True
        active = after & ~stopped
    return rows, theta, best_theta, best_epoch, stopped
