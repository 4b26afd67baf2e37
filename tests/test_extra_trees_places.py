"""TRN04: rows are routed from the nodes where they stood when the table was last written, and only those in open nodes."""

import os

import numpy as np
import pyarrow as pa
import pytest

from suasion.operators import extra_trees as et
from suasion.session import ensure_checkpoint_dir


def small_forest():
    """Two columns: one of fold 0, one of fold 1; roots split at 0 on feature 0, their children at 0 on feature 1."""
    forest = et.Forest.seedlings(1, [0, 1])
    none = np.zeros((2, 2), np.int64)
    kids = forest.grown(np.arange(2), np.zeros(2, np.int32), np.zeros(2), none, none * 0.5)
    held = et.Places(forest, kids[[0, 1, 3]])  # the left child of column 1 is a closed leaf
    forest.grown(kids[[0, 1, 3]], np.ones(3, np.int32), np.zeros(3), np.zeros((3, 2), np.int64), np.zeros((3, 2)))
    return forest, held, et.Places(forest, np.flatnonzero(forest.path > 3))


def test_rows_start_where_they_stood():
    rng = np.random.default_rng(5)
    x, fold = rng.normal(size=(60, 2)), rng.integers(0, 3, 60).astype(float)
    fold[7] = np.nan
    forest, held, now = small_forest()
    plain = {c: (row, slot) for c, row, slot in et._standing(forest, None, now, et._Block(x, fold, fold, None))}
    at = np.full((2, 60), held.none, held.kind)
    for c in (0, 1):
        row = np.flatnonzero((fold != c) & ~np.isnan(fold))
        node = forest.left[c] + (x[row, 0] > 0)
        inside = held.slot[node] >= 0
        at[c, row[inside]] = held.slot[node[inside]] - held.first[c]
    forest.threshold[:2] = 99.0  # the roots are not asked again
    again = {c: (row, slot) for c, row, slot in et._standing(forest, held, now, et._Block(x, fold, fold, at))}
    assert set(plain) == set(again) == {0, 1}
    for c in plain:
        assert all(np.array_equal(a, b) for a, b in zip(plain[c], again[c], strict=True)) and len(plain[c][0])


def test_tally_counts_each_node():
    rng = np.random.default_rng(6)
    x, y, fold = np.round(rng.normal(size=(80, 2)), 1), rng.integers(0, 2, 80), rng.integers(0, 2, 80).astype(float)
    forest, _, now = small_forest()
    drawn, t = np.tile([1, 0], (len(now.nodes), 1)), rng.normal(size=(len(now.nodes), 2))
    parts = [et._Block(x[a:a + 30], y[a:a + 30], fold[a:a + 30], None) for a in (0, 30, 60)]
    ends = [(forest.leaf_of(x, np.flatnonzero(fold != c), np.full((fold != c).sum(), c)), np.flatnonzero(fold != c)) for c in (0, 1)]
    for kind in (None, t):
        node, got = et._tally(forest, None, now, drawn, kind, parts)
        for i, row in zip(node, got, strict=True):
            mine = np.concatenate([r[leaf == now.nodes[i]] for leaf, r in ends])
            v = x[mine][:, drawn[i]]
            want = [*v.min(0), *v.max(0)] if kind is None else [*(v > t[i]).sum(0), *((v > t[i]) & (y[mine, None] == 1)).sum(0), len(mine), y[mine].sum()]
            assert np.array_equal(row, want)


def test_written_places_change_nothing_and_are_deleted(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4)], int(rng.integers(0, 2)), i % 3 or None) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, features array<double>, persuaded int, fold int").repartition(3)
    found = []
    for levels in (1, 99):
        monkeypatch.setattr(et, "REWRITE", levels)
        found.append(et.fit(df, fold_col="fold", trees=2, max_depth=4))
    for name in ("feature", "threshold", "left", "n", "p1"):
        assert np.array_equal(getattr(found[0], name), getattr(found[1], name)), name
    scratch = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "suasion-scratch")
    assert not [p for p in (os.listdir(scratch) if os.path.isdir(scratch) else []) if p.startswith("extra-trees")]


def test_blocks_are_bounded_and_widths_equal(monkeypatch):
    monkeypatch.setattr(et, "PLACES", 4)
    x = pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0]] * 3, pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([x, pa.array([0, 1, 1] * 3), pa.array([0.0, None, 2.0] * 3)], ["x", "y", "fold"])
    got = list(et._blocks([batch, batch.slice(0, 2)], 2, None))
    assert [len(b.x) for b in got] == [4, 4, 3] and np.isnan(got[0].x[1, 1]) and np.isnan(got[0].fold[1]) and got[1].x[0].tolist()[0] == 3.0
    with pytest.raises(ValueError, match="3 numbers"):
        list(et._blocks([batch], 3, None))
