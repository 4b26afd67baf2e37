"""TRN04 — extremely randomised trees, all trees of all folds grown together.

A tree sees every training row (no bootstrap).  At each node ``max_features`` features are
drawn, each with one threshold drawn between the node's smallest and largest value of that
feature, and the draw with the lowest Gini impurity splits the node.  All draws are hashes
of (seed, tree, path to the node, feature), so a forest does not depend on how the rows are
partitioned.

Each level is two distributed aggregates, whatever the number of trees and folds: the ranges
of the drawn features in every open node, then the label counts on both sides of every
threshold.  A task goes through the trees with open nodes one by one, sorts its rows by node and
emits one row per open node it meets.  Every ``REWRITE`` levels the table is written anew with
the open node of each (row, tree), so vectors are routed (broadcast forest) from where they
stood then, not from the roots, and those in closed leaves are left out.  A node is a leaf when
it is pure, when no draw leaves ``min_leaf`` rows on both sides, or, after all features were
tried, when all are constant.

Size: ``min_leaf`` is a share of the training rows (at least one row), so a tree has fewer than
``2 / min_leaf_share`` nodes and the driver and a broadcast hold at most
``trees x folds x 2 / min_leaf_share`` of them at any size of the table; there is no cap on depth.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.session import checkpointed, drop_stored, stored

CELLS = 1 << 20  # (row, tree) pairs in work at once
PLACES = 1 << 23  # (row, tree) places of a block of rows
REWRITE = 3  # levels
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps around silently."""
    x = np.asarray(x, np.uint64) + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def node_key(seed: int, tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Hash of a node; ``path`` is 1 at the root and ``2 p`` / ``2 p + 1`` left / right of ``p``."""
    start = mix(np.full(len(tree), seed % (1 << 64), np.uint64))
    return mix(mix(start ^ tree.astype(np.uint64)) ^ path)


def draw(key: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """A number in [0, 1) with 53 bits for each (node, feature)."""
    return (mix(mix(key) ^ feature.astype(np.uint64)) >> np.uint64(11)) * 2.0 ** -53


@dataclass
class Forest:
    """Nodes of all trees end to end; column c (a tree of one fold) starts at node c.  ``feature`` is -1 at
    leaves; the right child lies behind the left one."""
    folds: np.ndarray  # per column: the fold it leaves out, NaN for none
    tree: np.ndarray  # per column
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    column: np.ndarray
    path: np.ndarray
    n: np.ndarray
    p1: np.ndarray

    @classmethod
    def seedlings(cls, trees: int, folds: list) -> Forest:
        count = trees * len(folds)
        none = np.array([math.nan if f is None else float(f) for f in folds])
        return cls(np.repeat(none, trees), np.tile(np.arange(trees), len(folds)), np.full(count, -1, np.int32), np.zeros(count),
                   np.zeros(count, np.int64), np.arange(count), np.ones(count, np.uint64), np.zeros(count, np.int64), np.full(count, 0.5))

    def leaf_of(self, x: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaves in which vectors ``x[row]`` end that start at ``node``."""
        node, on = node.copy(), np.flatnonzero(self.feature[node] >= 0)
        while len(on):
            at = node[on]
            node[on] = self.left[at] + (x[row[on], self.feature[at]] > self.threshold[at])
            on = on[self.feature[node[on]] >= 0]
        return node

    def grown(self, at: np.ndarray, feature: np.ndarray, threshold: np.ndarray, n: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Split nodes ``at``; ``n`` and ``p1`` are (nodes x 2) of the children.  Returns the children."""
        first = len(self.feature)
        self.feature[at], self.threshold[at], self.left[at] = feature, threshold, first + 2 * np.arange(len(at))
        more = 2 * len(at)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int32)])
        self.threshold = np.concatenate([self.threshold, np.zeros(more)])
        self.left = np.concatenate([self.left, np.zeros(more, np.int64)])
        self.column = np.concatenate([self.column, np.repeat(self.column[at], 2)])
        self.path = np.concatenate([self.path, (self.path[at, None] * np.uint64(2) + np.arange(2, dtype=np.uint64)).ravel()])
        self.n, self.p1 = np.concatenate([self.n, n.ravel()]), np.concatenate([self.p1, p1.ravel()])
        return first + np.arange(more)

    def table(self, spark) -> DataFrame:
        """One row per node, for saving and looking at a forest."""
        rows = pd.DataFrame({"fold": self.folds[self.column], "tree": self.tree[self.column], "node": np.arange(len(self.feature)),
                             "feature": self.feature, "threshold": self.threshold, "left": self.left, "path": self.path.view(np.int64),
                             "n": self.n, "p1": self.p1})
        return spark.createDataFrame(rows, "fold double, tree long, node long, feature int, threshold double, left long, path long, n long, p1 double")

    @classmethod
    def load(cls, nodes: DataFrame) -> Forest:
        rows = nodes.orderBy("node").toPandas()  # bounded as the forest is
        roots = rows[rows.path == 1]
        column, left, feature = np.arange(len(rows)), rows.left.to_numpy(), rows.feature.to_numpy(np.int32)
        for at in np.flatnonzero(feature >= 0):  # the roots come first, parents before their children
            column[left[at]:left[at] + 2] = column[at]
        return cls(roots.fold.to_numpy(float), roots.tree.to_numpy(), feature, rows.threshold.to_numpy(float), left, column,
                   rows.path.to_numpy().view(np.uint64), rows.n.to_numpy(), rows.p1.to_numpy(float))


def _elements(forest: Forest, x: np.ndarray, folds: np.ndarray):
    """Chunks of (row, leaf) pairs: every row with the columns that left its fold out."""
    step = max(1, CELLS // max(1, len(forest.folds)))
    whole = np.isnan(forest.folds)
    for a in range(0, len(x), step):
        row, column = np.nonzero((folds[a:a + step, None] == forest.folds) | whole)
        row = row + a
        yield row, forest.leaf_of(x, row, column)


class Places:
    """Open nodes by column, as numbers within their column: what a row keeps of where it stands."""

    def __init__(self, forest: Forest, open_: np.ndarray):
        self.nodes = open_  # ascending by column
        self.first = np.searchsorted(forest.column[open_], np.arange(len(forest.folds) + 1))
        most = int(np.diff(self.first).max(initial=0))
        self.kind = next(k for k in (np.uint16, np.uint32) if most < np.iinfo(k).max)
        self.none = np.iinfo(self.kind).max
        self.slot = np.full(len(forest.feature), -1, np.int64)
        self.slot[open_] = np.arange(len(open_))


@dataclass
class _Block:
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    at: np.ndarray | None  # (columns x rows) places in ``held``; None before the first are written


def _blocks(batches, width: int, held: Places | None):
    """Arrow batches as blocks of at most about ``PLACES`` places."""
    def block(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        x = t["x"].combine_chunks()
        if isinstance(x, pa.ChunkedArray):
            x = x.chunk(0)
        if x.null_count or set(np.diff(x.offsets.to_numpy()).tolist()) - {width}:
            raise ValueError(f"vectors must have {width} numbers each")
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
        at = None
        if held is not None:
            at = np.frombuffer(b"".join(t["at"].to_pylist()), held.kind).reshape(t.num_rows, -1).T.copy()
        return _Block(flat, t["y"].to_numpy(), t["fold"].to_numpy().astype(np.float64), at)
    parts, rows = [], 0
    for batch in batches:
        most = PLACES // max(1, 1 if held is None else len(held.first) - 1)
        for a in range(0, batch.num_rows, max(1, most)):
            part = batch.slice(a, max(1, most))
            if rows and rows + part.num_rows > most:
                yield block(parts)
                parts, rows = [], 0
            parts.append(part)
            rows += part.num_rows
    if rows:
        yield block(parts)


def _standing(forest: Forest, held: Places | None, now: Places, block: _Block):
    """Per column with open nodes: the rows in them and their slots in ``now``."""
    rows_of = {}
    for c in np.flatnonzero(np.diff(now.first)):
        if held is None:  # every row starts at the root of each column it trains: their fold is another one
            out = forest.folds[c]
            if out not in rows_of and not math.isnan(out):
                rows_of[out] = np.flatnonzero((block.fold != out) & ~np.isnan(block.fold))
            row = np.arange(len(block.x)) if math.isnan(out) else rows_of[out]
            node = np.full(len(row), c)
        else:
            row = np.flatnonzero(block.at[c] != held.none)
            node = held.nodes[held.first[c] + block.at[c, row]]
        slot = now.slot[forest.leaf_of(block.x, row, node)]
        inside = slot >= 0
        yield c, row[inside], slot[inside]


def _rewritten(data: DataFrame, forest: Forest, held: Places | None, now: Places, width: int) -> DataFrame:
    """``data`` with the open node of every (row, column)."""
    sent = data.sparkSession.sparkContext.broadcast((forest, held, now))

    def run(batches):
        forest, held, now = sent.value
        for block in _blocks(batches, width, held):
            n, columns = len(block.x), len(forest.folds)
            at = np.full((n, columns), now.none, now.kind)
            for c, row, slot in _standing(forest, held, now, block):
                at[row, c] = slot - now.first[c]
            size = columns * at.itemsize
            step = max(1, (1 << 22) // max(width * 8, size, 1))
            for a in range(0, n, step):
                part = slice(a, min(n, a + step))
                m = part.stop - a
                x = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(block.x[part].ravel()))
                places = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * size), pa.py_buffer(at[part].tobytes())])
                yield pa.RecordBatch.from_arrays([x, pa.array(block.y[part], pa.int64()), pa.array(block.fold[part], pa.float64()), places], ["x", "y", "fold", "at"])
    out = stored(data.mapInArrow(run, "x array<double>, y long, fold double, at binary"), "extra-trees")
    sent.unpersist()
    return out


def _tally(forest: Forest, held: Places | None, now: Places, drawn: np.ndarray, thresholds: np.ndarray | None, blocks) -> tuple[np.ndarray, np.ndarray]:
    """(nodes x 2m) smallest and largest values of each drawn feature or, with ``thresholds``, (nodes x (2m + 2))
    rows and label-1 rows right of each, then of the node itself; of the rows of ``blocks``."""
    m = drawn.shape[1]
    if thresholds is None:
        out = np.hstack([np.full(drawn.shape, np.inf), np.full(drawn.shape, -np.inf)])
    else:
        out = np.zeros((len(drawn), 2 * m + 2), np.int64)
    seen = np.zeros(len(drawn), bool)
    for block in blocks:
        flat, width = block.x.ravel(), block.x.shape[1]
        one = 1 + (block.y.astype(np.int64) << 32)  # counts rows and label-1 rows at once
        for c, row, slot in _standing(forest, held, now, block):
            if not len(row):
                continue
            order = np.argsort((slot - now.first[c]).astype(now.kind), kind="stable")  # 16 bits: a radix sort
            row, slot = row[order], slot[order]
            start = np.flatnonzero(np.diff(slot, prepend=-1))
            node, count = slot[start], np.diff(start, append=len(slot))
            seen[node] = True
            base = row * width
            both = one[row] if thresholds is not None else None
            for j in range(m):
                value = flat[base + np.repeat(drawn[node, j], count)]
                if thresholds is None:
                    out[node, j] = np.minimum(out[node, j], np.minimum.reduceat(value, start))
                    out[node, m + j] = np.maximum(out[node, m + j], np.maximum.reduceat(value, start))
                else:
                    got = np.add.reduceat(both * (value > np.repeat(thresholds[node, j], count)), start)
                    out[node, j] += got & 0xFFFFFFFF
                    out[node, m + j] += got >> 32
            if thresholds is not None:
                got = np.add.reduceat(both, start)
                out[node, -2] += got & 0xFFFFFFFF
                out[node, -1] += got >> 32
    return np.flatnonzero(seen), out[seen]


def _pass(data: DataFrame, forest: Forest, held: Places | None, now: Places, drawn: np.ndarray, width: int, thresholds: np.ndarray | None = None) -> np.ndarray:
    """One distributed aggregate over the open nodes: ``_tally`` of all rows."""
    sent = data.sparkSession.sparkContext.broadcast((forest, held, now, drawn, thresholds))
    m, ranges = drawn.shape[1], thresholds is None
    names = [f"lo{j}" for j in range(m)] + [f"hi{j}" for j in range(m)] if ranges else \
        [f"n{j}" for j in range(m)] + [f"p{j}" for j in range(m)] + ["n", "p"]

    def run(batches):
        forest, held, now, drawn, thresholds = sent.value
        node, rows = _tally(forest, held, now, drawn, thresholds, _blocks(batches, width, held))
        step = max(1, (1 << 19) // len(names))
        for a in range(0, len(node), step):
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(v)) for v in rows[a:a + step].T], pa.array(node[a:a + step])], [*names, "node"])
    number = "double" if ranges else "long"
    parts = data.mapInArrow(run, ", ".join(f"{n} {number}" for n in names) + ", node long")
    how: list[Callable] = [F.min] * m + [F.max] * m if ranges else [F.sum] * len(names)
    got = parts.groupBy("node").agg(*[f(n).alias(n) for f, n in zip(how, names, strict=True)]).toPandas()  # one row per open node
    sent.unpersist()
    out = np.zeros((len(drawn), len(names)))
    out[got["node"].to_numpy(dtype=np.int64)] = got[names].to_numpy()
    return out


def _candidates(forest: Forest, seed: int, nodes: np.ndarray, attempt: np.ndarray, d: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes x m) drawn features of each node's ``attempt`` and the draws of their thresholds.  A node's features
    are an order of all by hash, taken m at a time (the last attempt is filled from the front)."""
    key = node_key(seed, forest.tree[forest.column[nodes]], forest.path[nodes])
    features, draws = np.zeros((len(nodes), m), np.int64), np.zeros((len(nodes), m))
    step = max(1, CELLS // d)
    for a in range(0, len(nodes), step):
        k = key[a:a + step, None]
        order = np.argsort(mix(k ^ mix(np.arange(d, dtype=np.uint64))), axis=1, kind="stable")
        at = (attempt[a:a + step, None] * m + np.arange(m)) % d
        features[a:a + step] = np.take_along_axis(order, at, 1)
        draws[a:a + step] = draw(k, features[a:a + step])
    return features, draws


def gini_gain(n: np.ndarray, p: np.ndarray, n_right: np.ndarray, p_right: np.ndarray) -> np.ndarray:
    """Weighted drop of the Gini impurity, times the node's rows."""
    def impure(n, p):
        n = np.maximum(n, 1)
        return 2 * p * (n - p) / n
    return impure(n, p) - impure(n - n_right, p - p_right) - impure(n_right, p_right)


def fit(df: DataFrame, features: str = "features", label: str = "persuaded", fold_col: str | None = None, trees: int = 100,
        max_features: int | None = None, min_leaf_share: float = 0.001, max_depth: int | None = None, seed: int = 42) -> Forest:
    """Grow ``trees`` trees on all labelled rows or, with ``fold_col``, for each fold on the rows of the other
    folds (rows without a fold train nothing).  ``max_features``: drawn per node, the square root of the width by
    default.  Every random choice follows ``seed``."""
    from suasion.operators.train import fold_values
    fold = F.lit(None).cast("double") if fold_col is None else F.col(fold_col).cast("double")
    data = checkpointed(df.filter(F.col(label).isNotNull()).select(
        F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), fold.alias("fold")))
    folds = [None] if fold_col is None else fold_values(data, "fold")
    sizes = {r["fold"]: (r["n"], r["p"]) for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    total = [sum(v[k] or 0 for f, v in sizes.items() if fold_col is None or f is not None) for k in (0, 1)]
    width = data.select(F.max(F.size("x"))).first()[0]
    forest = Forest.seedlings(trees, folds)
    if not width:
        return forest
    own = np.array([[0, 0] if f is None else sizes.get(f, (0, 0)) for f in folds], dtype=np.int64)
    forest.n = np.repeat(total[0] - own[:, 0], trees)
    forest.p1 = np.repeat((total[1] - own[:, 1]) / np.maximum(total[0] - own[:, 0], 1), trees)
    m = min(width, max_features or max(1, math.isqrt(width)))
    least = np.maximum(1, np.ceil(min_leaf_share * forest.n)).astype(np.int64)  # by column

    def splittable(nodes):
        return nodes[(forest.n[nodes] >= 2 * least[forest.column[nodes]]) & (forest.p1[nodes] > 0) & (forest.p1[nodes] < 1)]
    open_ = splittable(np.arange(len(forest.folds)))
    attempt = np.zeros(len(open_), np.int64)
    depth = np.zeros(len(open_), np.int64)
    held, level = None, 0
    while len(open_):
        now = Places(forest, open_)
        if level and level % REWRITE == 0:
            older, data = data, _rewritten(data, forest, held, now, width)
            if held is not None:
                drop_stored(older)
            held = now
        level += 1
        drawn, draws = _candidates(forest, seed, open_, attempt, width, m)
        found = _pass(data, forest, held, now, drawn, width)
        low, high = found[:, :m], found[:, m:]
        at = low + draws * (high - low)
        at = np.where(at >= high, low, at)
        counts = _pass(data, forest, held, now, drawn, width, at).astype(np.int64)
        n_right, p_right, n, p = counts[:, :m], counts[:, m:2 * m], counts[:, -2:-1], counts[:, -1:]
        enough = least[forest.column[open_], None]
        fits = (low < high) & (n_right >= enough) & (n - n_right >= enough)
        gain = np.where(fits, gini_gain(n, p, n_right, p_right), -np.inf)
        best = gain.argmax(1)
        i = np.flatnonzero(fits.any(1))
        b = best[i]
        right_n, right_p = n_right[i, b], p_right[i, b]
        child_n = np.stack([n[i, 0] - right_n, right_n], 1)
        child_p = np.stack([p[i, 0] - right_p, right_p], 1)
        children = forest.grown(open_[i], drawn[i, b], at[i, b], child_n, child_p / child_n)
        child_depth = np.repeat(depth[i] + 1, 2)
        again = np.flatnonzero(~fits.any(1) & ((attempt + 1) * m < width))
        fresh = splittable(children)
        fresh_depth = child_depth[fresh - children[0]] if len(children) else child_depth
        if max_depth is not None:
            fresh, fresh_depth = fresh[fresh_depth < max_depth], fresh_depth[fresh_depth < max_depth]
        open_ = np.concatenate([fresh, open_[again]])
        attempt = np.concatenate([np.zeros(len(fresh), np.int64), attempt[again] + 1])
        depth = np.concatenate([fresh_depth, depth[again]])
        order = np.argsort(forest.column[open_], kind="stable")
        open_, attempt, depth = open_[order], attempt[order], depth[order]
    if held is not None:
        drop_stored(data)
    return forest


def score(forest: Forest, df: DataFrame, features: str = "features", keep: list[str] | None = None, fold_col: str | None = None) -> DataFrame:
    """``keep`` columns, ``p1`` (mean over the trees of the leaf's share of label 1) and ``pred`` (a tie is 0).  With
    ``fold_col`` a row is scored by the trees that left its fold out; rows of other folds are left out."""
    keep = keep or [c for c in df.columns if c != features]
    sent = df.sparkSession.sparkContext.broadcast(forest)
    known = df
    if fold_col is not None:
        known = df.filter(F.col(fold_col).cast("double").isin([float(f) for f in np.unique(forest.folds) if not math.isnan(f)]))

    @F.pandas_udf("double")
    def p1(x: pd.Series, fold: pd.Series) -> pd.Series:
        forest = sent.value
        if not len(x):
            return pd.Series([], dtype="float64")
        total, trees = np.zeros(len(x)), np.zeros(len(x))
        for row, leaf in _elements(forest, np.vstack(x.tolist()), fold.to_numpy(dtype="float64")):
            total += np.bincount(row, forest.p1[leaf], len(x))
            trees += np.bincount(row, minlength=len(x))
        return pd.Series(total / np.maximum(trees, 1))
    fold = F.lit(None).cast("double") if fold_col is None else F.col(fold_col).cast("double")
    out = known.withColumn("p1", p1(F.col(features), fold))
    return out.select(*keep, "p1", (F.col("p1") > 0.5).cast("int").alias("pred"))


def kfold_scores(df: DataFrame, fold_col: str, features: str = "features", label: str = "persuaded",
                 keep: list[str] | None = None, **params) -> DataFrame:
    """Out-of-fold scores of every row with a fold; all folds' trees grow in the same passes."""
    data = checkpointed(df)
    return score(fit(data, features, label, fold_col, **params), data, features, keep or [c for c in df.columns if c != features], fold_col)
