"""EVL05: sign flips against all flips, and their defined cases."""

from itertools import product

import numpy as np
import pytest

from suasion.operators import evaluate as ev


def frame(spark, d, parts=3, group=None):
    rows = [(f"r{i}", x, 0.0, None if group is None else group[i]) for i, x in enumerate(d)]
    return spark.createDataFrame(rows, "id string, a double, b double, g string").repartition(parts)


def test_flips_approach_all_flips(spark):
    d = [0.9, 0.4, -0.2, 0.7, 0.1, 0.5, -0.3, 0.8, 0.2, 0.6]
    every = np.array(list(product([1, -1], repeat=10))) @ np.array(d)
    exact = (np.abs(every) >= abs(sum(d)) - 1e-9).mean()
    got = ev.permutation_p(frame(spark, d), "a", "b", "id", flips=20_000).first()
    assert got["n"] == 10 and got["mean_difference"] == pytest.approx(0.37)
    assert got["p_value"] == pytest.approx(exact, abs=4 * (exact / 20_000) ** 0.5)
    signs = ev.flip_signs([f"r{i}" for i in range(10)], 300, 42)
    p = (1 + (np.abs(np.array(d) @ signs) >= abs(sum(d)) - 1e-9).sum()) / 301
    assert all(ev.permutation_p(frame(spark, d, n), "a", "b", "id", flips=300).first()["p_value"] == pytest.approx(p) for n in (1, 5))


def test_groups_nulls_and_no_difference(spark):
    d = [0.5] * 30 + [0.0] * 10 + [None] * 3
    g = ["x"] * 30 + [None] * 10 + ["x"] * 3
    got = {r["g"]: r for r in ev.permutation_p(frame(spark, d, 4, g), "a", "b", "id", ["g"], flips=400).collect()}
    assert got["x"]["n"] == 30 and got["x"]["p_value"] == pytest.approx(1 / 401)  # no flip of thirty is as far
    assert got[None]["n"] == 10 and got[None]["p_value"] == 1.0
    assert ev.permutation_p(frame(spark, []).limit(0), "a", "b", "id").count() == 0
    signs = ev.flip_signs([f"r{i}" for i in range(4000)], 200, 1)
    assert abs(signs.mean()) < 0.01 and set(np.unique(signs)) == {-1, 1}
