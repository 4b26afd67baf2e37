"""FEA06 and TRN05: fold-wise moments and stacked Newton steps against one fit at a time."""

import numpy as np
import pytest

from suasion.operators import features as fe
from suasion.operators import newton
from suasion.operators import train as tr


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2] + [0, 10, 1]
    y = x @ [0.5, -0.2, 2] + rng.normal(size=240)
    return x, y


def frame(spark, x, y, label="y", kind="double", parts=4):
    rows = [(i, x[i].tolist(), None if i == 7 else (float if kind == "double" else int)(y[i]), None if i == 9 else i % 4) for i in range(len(x))]
    return spark.createDataFrame(rows, f"i int, features array<double>, {label} {kind}, fold int").repartition(parts)


def plain_ridge(x, y, penalty):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    b = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(z)) / s
    return y.mean() - m @ b, b


def test_ridge_of_all_folds_and_penalties(spark, table):
    x, y = table
    out = newton.ridge_kfold(frame(spark, x, y), "y", "features", "fold", [0.0, 0.3, 5.0], keep=["i"]).collect()
    assert len(out) == 238 * 3
    fits = {(f, p): plain_ridge(*(a[[i for i in range(240) if i % 4 != f and i not in (7, 9)]] for a in (x, y)), p) for f in range(4) for p in (0.0, 0.3, 5.0)}
    for r in out:
        a, b = fits[r["fold"], r["penalty"]]
        assert r["prediction"] == pytest.approx(a + x[r["i"]] @ b, abs=1e-9)


def test_constant_and_dependent_columns(spark, table):
    x, y = table
    more = np.hstack([x, np.full((240, 1), 3.0), x[:, :1] * 2])
    got, want = ({(r["i"]): r["prediction"] for r in newton.ridge_kfold(frame(spark, a, y), "y", "features", "fold", [0.0], keep=["i"]).collect()} for a in (more, x))
    assert all(got[i] == pytest.approx(want[i], abs=1e-7) for i in want)


def test_rfa_equals_two_fits(spark, table):
    x, y = table
    rng = np.random.default_rng(1)
    z = rng.normal(size=(240, 2))
    rows = [(i, *z[i].tolist(), x[i].tolist(), None if i == 7 else float(y[i]), i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "i int, z0 double, z1 double, features array<double>, y double, fold int")
    out = {r["i"]: r for r in fe.rfa_kfold(df, "y", ["z0", "z1"], "features", "fold", reg_param=0.2, keep=["i"]).collect()}
    assert len(out) == 240 and out[7]["y"] is None
    for f in range(3):
        rest = [i for i in range(240) if i % 3 != f and i != 7]
        one = np.linalg.lstsq(np.hstack([np.ones((len(rest), 1)), z[rest]]), y[rest], rcond=None)[0]
        crossed = np.hstack([x, x * z[:, :1], x * z[:, 1:]])
        a, b = plain_ridge(crossed[rest], y[rest] - one[0] - z[rest] @ one[1:], 0.2)
        for i in range(f, 240, 3):
            assert out[i]["step1"] == pytest.approx(one[0] + z[i] @ one[1:], abs=1e-8)
            assert out[i]["step2"] == pytest.approx(a + crossed[i] @ b, abs=1e-8)


def test_newton_equals_one_fit_at_a_time(spark, table):
    x, _ = table
    y = (x @ [1.0, 0.3, -1] + np.random.default_rng(2).normal(size=240) > 1.8).astype(int)
    df = frame(spark, x, y, "persuaded", "int")
    data, folds, penalties, left_out, weights, gradients, passes = tr.nested_fits(df, "fold", [0.0, 0.1])
    assert len(left_out) == 2 * (4 + 6) and passes < 15 and np.abs(gradients).max() < 1e-8
    for c in (0, 5, 12, 19):
        rows = df.filter(~df.fold.isin(*left_out[c])).filter("persuaded is not null")
        m = tr.fit(rows, "features", "persuaded", "lr", penalties[c])
        assert np.allclose(weights[1:, c], m.coefficients.toArray(), atol=2e-3) and weights[0, c] == pytest.approx(m.intercept, abs=2e-2)


def test_separable_rows_need_a_penalty(spark):
    x = np.arange(-6, 6, dtype=float)[:, None] + 0.5
    y = (x[:, 0] > 0).astype(int)
    rows = [([1.0, *x[i].tolist()], float(y[i]), i % 3) for i in range(12)]
    data = spark.createDataFrame(rows, "x array<double>, y double, fold int")
    weights, gradients, passes = newton.fit_logistic(data, [0, 1, 2], np.array([0.0, 0.5]), [(0,), (0,)], most_steps=30)
    assert np.isfinite(weights).all() and np.abs(gradients[1]).max() < 1e-9 and weights[1, 0] > weights[1, 1] > 0
    none, _, _ = newton.fit_logistic(data, [0, 1, 2], np.array([0.5]), [(0, 1, 2)])  # nothing to train on
    assert np.abs(none).max() == 0


def test_search_takes_the_mean_of_all_inner_folds(spark, table):
    x, _ = table
    y = (x[:, 0] + np.random.default_rng(2).normal(size=240) > 0).astype(int)
    df = frame(spark, x, y, "persuaded", "int")
    got = tr.l2_search(df, "fold", [0.0, 0.1, 10.0]).collect()
    assert len(got) == 12 and all(r["inner_folds"] == 3 for r in got)
    for outer in range(4):
        mine = sorted((r for r in got if r["outer_fold"] == outer), key=lambda r: (-r["inner_auc"], r["reg_param"]))
        assert [r["chosen"] for r in mine] == [True, False, False] and mine[0]["outer_auc"] > 0.6
        aucs = []
        for inner in set(range(4)) - {outer}:
            m = tr.fit(df.filter(~df.fold.isin(outer, inner)), "features", "persuaded", "lr", 0.1)
            s = tr.score(m, df.filter((df.fold == inner) & df.persuaded.isNotNull()), "features", ["persuaded"])
            from suasion.operators.evaluate import roc_auc
            aucs.append(roc_auc(s, "persuaded", "p1").first()[0])
        assert next(r["inner_auc"] for r in mine if r["reg_param"] == 0.1) == pytest.approx(np.mean(aucs), abs=2e-3)
    with pytest.raises(ValueError, match="three folds"):
        tr.l2_search(df.filter("fold < 2"), "fold", [0.1])
