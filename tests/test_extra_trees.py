"""TRN04: the distributed grower against a tree grown row by row, and its defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from suasion.operators import extra_trees as et
from suasion.operators import train as tr


def grow_plainly(x, y, seed, tree, m, least):
    """(function vector → share of label 1): one tree, node by node, with the module's draws."""
    d = x.shape[1]

    def node(rows, path):
        n, p = len(rows), int(y[rows].sum())
        share = p / n
        if n < 2 * least or p in (0, n):
            return share
        key = et.node_key(seed, np.array([tree]), np.array([path], np.uint64))
        order = np.argsort(et.mix(key ^ et.mix(np.arange(d, dtype=np.uint64))), kind="stable")
        for a in range(0, d, m):
            best = None
            for j in order[np.arange(a, a + m) % d]:
                v = x[rows, j]
                lo, hi = v.min(), v.max()
                t = lo + et.draw(key, np.array([j]))[0] * (hi - lo)
                t = lo if t >= hi else t
                right = rows[v > t]
                if lo == hi or len(right) < least or n - len(right) < least:
                    continue
                q = int(y[right].sum())
                gain = (2 * p * (n - p) / n - 2 * (p - q) * (n - len(right) - p + q) / (n - len(right)) - 2 * q * (len(right) - q) / len(right))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, j, t
            if best:
                _, j, t = best
                goes = x[rows, j] > t
                return j, t, node(rows[~goes], 2 * path % (1 << 64)), node(rows[goes], (2 * path + 1) % (1 << 64))
        return share
    root = node(np.arange(len(x)), 1)

    def value(v, at=root):
        while isinstance(at, tuple):
            at = at[3] if v[at[0]] > at[1] else at[2]
        return at
    return value


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 7)), 2)
    x[:, 5] = 1.0  # constant
    x[:, 6] = (x[:, 0] > 0)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=120) / 4) > 0).astype(int)
    return x, y


def frame(spark, x, y, parts=3, fold=None):
    rows = [(i, [float(v) for v in x[i]], None if y[i] is None else int(y[i]), None if fold is None else fold[i]) for i in range(len(x))]
    return spark.createDataFrame(rows, "i int, features array<double>, persuaded int, fold int").repartition(parts)


@pytest.mark.parametrize(("m", "share"), [(2, 0.001), (1, 0.05), (7, 0.001)])
def test_forest_equals_plain_trees(spark, table, m, share):
    x, y = table
    forest = et.fit(frame(spark, x, y), trees=4, max_features=m, min_leaf_share=share)
    got = {r["i"]: r["p1"] for r in et.score(forest, frame(spark, x, y, 5), keep=["i"]).collect()}
    least = max(1, math.ceil(share * len(x)))
    plain = [grow_plainly(x, y, 42, t, m, least) for t in range(4)]
    for i in range(len(x)):
        assert got[i] == pytest.approx(np.mean([p(x[i]) for p in plain]), abs=1e-12)
    again = et.fit(frame(spark, x, y, 1), trees=4, max_features=m, min_leaf_share=share)
    assert np.array_equal(again.threshold, forest.threshold) and np.array_equal(again.feature, forest.feature)


def test_folds_grow_as_if_alone(spark, table):
    x, y = table
    fold = [None if i % 11 == 0 else i % 3 for i in range(len(x))]
    df = frame(spark, x, y, 4, fold)
    got = {r["i"]: (r["fold"], r["p1"]) for r in tr.kfold_scores(df, "fold", model="etc", keep=["i", "fold"], trees=3).collect()}
    assert set(got) == {i for i in range(len(x)) if fold[i] is not None}
    for k in range(3):
        alone = et.fit(df.filter(F.col("fold") != k), trees=3)
        want = {r["i"]: r["p1"] for r in et.score(alone, df.filter(F.col("fold") == k), keep=["i"]).collect()}
        assert {i: p for i, (f, p) in got.items() if f == k} == pytest.approx(want)


def test_forest_is_saved_and_read(spark, table, tmp_path):
    x, y = table
    df = frame(spark, x, y, fold=[i % 2 for i in range(len(x))])
    forest = et.fit(df, fold_col="fold", trees=3)
    forest.table(spark).write.parquet(str(tmp_path / "f"))
    back = et.Forest.load(spark.read.parquet(str(tmp_path / "f")))
    for name in ("folds", "tree", "feature", "threshold", "left", "column", "path", "n", "p1"):
        assert np.array_equal(getattr(back, name), getattr(forest, name)), name
    assert et.score(back, df, keep=["i"], fold_col="fold").exceptAll(et.score(forest, df, keep=["i"], fold_col="fold")).count() == 0


def test_forest_learns_and_its_size_is_bounded(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = frame(spark, x, y, 4, [i % 3 for i in range(len(x))])
    s = tr.kfold_scores(df, "fold", model="etc", keep=["i", "persuaded"], trees=20).toPandas()
    assert (s.pred == s.persuaded).mean() > 0.9
    forest = et.fit(df, trees=5, min_leaf_share=0.01)
    assert np.bincount(forest.column).max() < 2 / 0.01 and forest.n[forest.feature < 0].min() >= 30


def test_defined_cases(spark, table):
    x, y = table
    few = et.fit(frame(spark, x[:0], y[:0]), trees=2)
    assert et.score(few, frame(spark, x[:2], y[:2]), keep=["i"]).count() == 2
    same = et.fit(frame(spark, np.ones((9, 3)), [1, 0, 1, 1, 1, 0, None, None, 1]), trees=2)  # nothing to split on
    assert [r["p1"] for r in et.score(same, frame(spark, np.ones((1, 3)), [0]), keep=[]).collect()] == [pytest.approx(5 / 7)]
    assert len(same.feature) == 2
    pure = et.fit(frame(spark, x, np.ones(len(x), int)), trees=2)
    assert len(pure.feature) == 2 and pure.p1.tolist() == [1, 1]
