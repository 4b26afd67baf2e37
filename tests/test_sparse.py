"""Sparse vectors, heads on them and principal components: against the dense forms and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from suasion.operators import features as fe
from suasion.operators import shape as sh
from suasion.operators import sparse
from suasion.operators import train as tr


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(2)
    x = np.where(rng.random((60, 9)) < 0.5, rng.normal(size=(60, 9)) * np.arange(1, 10), 0)
    x[:, 8] = 0
    x[0, 8] = 3.0  # a feature that one row has
    return x


def long(spark, x, parts=3):
    rows = [(f"g{i:02d}", f"f{j}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame(rows, "group_id string, feat string, value double").repartition(parts)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK_CELLS", 37)  # a few rows each


def test_long_to_sparse_and_back(spark, cells):
    vectors, dictionary = sparse.long_to_sparse(long(spark, cells))
    for r in vectors.collect():
        i = int(r["group_id"][1:])
        assert r["idx"] == np.flatnonzero(cells[i]).tolist() and np.allclose(r["val"], cells[i][r["idx"]])
    back = sparse.sparse_to_long(vectors, dictionary)
    assert back.exceptAll(long(spark, cells)).count() == 0 == long(spark, cells).exceptAll(back).count()
    odd = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", None), (None, "x", 5.0), ("b", "new", 1.0)], "group_id string, feat string, value double")
    given = spark.createDataFrame([("x", 7), ("y", 2)], "feat string, feat_idx long")
    got = {r["group_id"]: (r["idx"], r["val"]) for r in sparse.long_to_sparse(odd, given)[0].collect()}
    assert got == {"a": ([7], [2.0]), None: ([7], [5.0])}


def test_zscored_vectors_have_the_dense_values_and_no_filled_cell(spark, cells):
    df = long(spark, cells)
    dense, names = fe.zscore_dense_vectors(df)
    want = {r["group_id"]: r["features"] for r in dense.collect()}
    vectors, dictionary = sparse.long_to_sparse(sparse.zscore_cells(df))
    for r in vectors.collect():
        i = int(r["group_id"][1:])
        assert r["idx"] == np.flatnonzero(cells[i]).tolist()
        assert np.allclose(np.array(want[r["group_id"]])[r["idx"]], r["val"])


def labelled(spark, cells):
    y = (cells[:, 0] - cells[:, 3] > 0).astype(int)
    return spark.createDataFrame([(f"g{i:02d}", None if i % 13 == 0 else int(y[i]), None if i % 17 == 1 else i % 3) for i in range(len(cells))],
                                 "group_id string, persuaded int, folds_col int")


def test_heads_equal_the_dense_heads(spark, cells, small_blocks):
    settings = [tr.HeadSetting("a", lr=0.3, patience=2), tr.HeadSetting("b", lr=0.05, weight_decay=0.05, patience=0, epochs=5)]
    vectors, dictionary = sparse.long_to_sparse(long(spark, cells))
    rows = vectors.join(labelled(spark, cells), "group_id")
    dense, _ = sh.long_to_dense(long(spark, cells), dictionary)
    both = dense.join(labelled(spark, cells), "group_id").filter("folds_col is not null")
    for use_best in (True, False):
        m1, oof1 = sparse.kfold_heads(rows, dictionary.select("feat_idx"), "group_id", "folds_col", settings, epochs=7, use_best=use_best)
        m2, oof2 = tr.kfold_heads(both, "folds_col", settings, epochs=7, keep=["group_id"], use_best=use_best)
        order = ["run_id", "fold", "epoch"]
        a, b = (m.orderBy(*order).toPandas() for m in (m1, m2))
        assert np.allclose(a.drop(columns="run_id"), b.drop(columns="run_id"), atol=1e-9) and list(a.run_id) == list(b.run_id)
        got, want = ({(r["run_id"], r["group_id"]): (r["folds_col"], r["p1"], r["pred"]) for r in o.collect()} for o in (oof1, oof2))
        assert got.keys() == want.keys() and got
        assert all(got[k][0] == want[k][0] and got[k][2] == want[k][2] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


@pytest.mark.parametrize("spare", [61, 2])
def test_components_equal_numpy(spark, cells, small_blocks, spare):
    x = cells.copy()
    x[:, 1] += 20  # a far mean, so that centring matters
    vectors, dictionary = sparse.long_to_sparse(long(spark, x))
    blocks = sparse.pack(vectors, "group_id")
    assert blocks.n_rows == 60 and blocks.table.count() > 5
    found = sparse.principal_components(blocks, dictionary.select("feat_idx"), 3, spare=spare)
    values, vectors_ = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(found.variances, values[::-1][:3], rtol=1e-9)
    v = np.array([r["v"] for r in found.loadings.orderBy("feat").collect()])
    want = vectors_[:, ::-1][:, :3]
    want = want * np.sign(want[np.abs(want).argmax(0), range(3)])
    assert np.allclose(v, want, atol=1e-7)
    scores = {r["id"]: r["features"] for r in sparse.pca_scores(blocks, found).collect()}
    assert np.allclose([scores[f"g{i:02d}"] for i in range(60)], (x - x.mean(0)) @ want, atol=1e-6)


def test_components_of_the_long_table_equal_the_dense_form(spark, cells):
    df = long(spark, cells)
    got, want = ({(r["group_id"], r["feat"]): r["value"] for r in f(df, 4).collect()} for f in (sparse.pca_reduce, fe.pca_reduce))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_a_vocabulary_beyond_dense_vectors(spark):
    rng = np.random.default_rng(7)
    words = sh.MAX_DENSE + 5000
    rows = [(f"g{i:03d}", f"w{j}", 1.0) for i in range(300) for j in set(rng.integers(2, words, 150).tolist())]
    rows += [(f"g{i:03d}", f"w{i % 2}", 40.0) for i in range(300)]
    rows += [(f"g{j % 300:03d}", f"w{j}", 1.0) for j in range(2, words)]
    df = spark.createDataFrame(rows, "group_id string, feat string, value double")
    vectors, dictionary = sparse.long_to_sparse(df)
    assert dictionary.count() == words > sh.MAX_DENSE
    labels = spark.createDataFrame([(f"g{i:03d}", i % 2, i % 5) for i in range(300)], "group_id string, persuaded int, folds_col int")
    _, oof = sparse.kfold_heads(vectors.join(labels, "group_id"), dictionary.select("feat_idx"), "group_id", "folds_col", [tr.HeadSetting("r", lr=0.1)], epochs=4)
    assert oof.count() == 300 and oof.filter("pred = persuaded").count() > 290


def test_nothing_and_one_row(spark):
    none = spark.createDataFrame([], "group_id string, feat string, value double")
    vectors, dictionary = sparse.long_to_sparse(none)
    blocks = sparse.pack(vectors, "group_id")
    found = sparse.principal_components(blocks, dictionary.select("feat_idx"), 3)
    assert blocks.n_rows == 0 and found.variances.size == 0 and sparse.pca_scores(blocks, found).count() == 0
    one = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0)], "group_id string, feat string, value double")
    assert [r["value"] for r in sparse.pca_reduce(one, 1).collect()] == [0.0]
    metrics, oof = sparse.kfold_heads(vectors.withColumns({"persuaded": F.lit(1), "f": F.lit(0)}), dictionary.select("feat_idx"), "group_id", "f", [tr.HeadSetting("r")])
    assert oof.count() == 0 == metrics.count()


def test_components_of_a_slowly_falling_spectrum(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((300, 120)) < 0.3, rng.random((300, 120)) * np.linspace(1.3, 1, 120), 0)
    x[:, 0] += 5
    vectors, dictionary = sparse.long_to_sparse(long(spark, x))
    blocks = sparse.pack(vectors, "group_id")
    found = sparse.principal_components(blocks, dictionary.select("feat_idx"), 3, spare=5, most_rounds=60)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert found.rounds < 60 and np.allclose(found.variances, values[:3], rtol=1e-9)


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_cells_of_groups_that_lie_together_are_not_shuffled(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i:03d}", f"f{j}", float(v)) for i in range(120) for j, v in zip(rng.choice(900, 700, replace=False).tolist(), rng.random(700), strict=True)]
    df = spark.createDataFrame(rows, "group_id string, feat string, value double").coalesce(1)
    before = shuffled(spark)
    vectors, dictionary = sparse.long_to_sparse(df)
    got = {r["group_id"]: dict(zip(r["idx"], r["val"], strict=True)) for r in vectors.collect()}
    left = shuffled(spark) - before
    names = {r["feat_idx"]: r["feat"] for r in dictionary.collect()}
    assert {(g, names[i], v) for g, row in got.items() for i, v in row.items()} == set(rows)
    assert left < 4 * len(rows)  # features only: less than half of the cells' numbers


def test_groups_in_several_places_are_joined(spark, small_blocks):
    rows = [(f"g{i % 5}", f"f{i % 7}", float(i)) for i in range(210)] + [("g0", None, 9.0), ("only", "null value", None)]
    vectors, dictionary = sparse.long_to_sparse(spark.createDataFrame(rows, "group_id string, feat string, value double").repartition(4))
    names = {r["feat_idx"]: r["feat"] for r in dictionary.collect()}
    want = {}
    for g, f, x in rows[:210]:
        want.setdefault((g, f), []).append(x)
    got = {(r["group_id"], names[i]): x for r in vectors.collect() for i, x in zip(r["idx"], r["val"], strict=True)}
    assert set(names.values()) == {None, "null value", *[f"f{j}" for j in range(7)]}
    assert got == {k: pytest.approx(sum(x) / len(x)) for k, x in want.items()}


def spread(spark, cells):
    """Features in several slices."""
    at = [0, 1, sparse.SLICE - 1, sparse.SLICE, sparse.SLICE + 7, 5 * sparse.SLICE, 5 * sparse.SLICE + 1, 9 * sparse.SLICE + 3, 9 * sparse.SLICE + 9]
    return at, spark.createDataFrame([(f"f{j}", i) for j, i in enumerate(at)], "feat string, feat_idx long")


def test_a_pass_moves_packages_and_leaves_blocks_where_they_lie(spark, cells, small_blocks):
    at, dictionary = spread(spark, cells)
    blocks = sparse.pack(sparse.long_to_sparse(long(spark, cells), dictionary)[0], "group_id")
    weights = np.random.default_rng(1).normal(size=(9, 2))
    numbers = spark.createDataFrame([(i, weights[j].tolist()) for j, i in enumerate(at)], "feat long, w array<double>")
    got = {r["id"]: r["dot"] for r in sparse.dots(blocks, numbers, 2).collect()}
    assert np.allclose([got[f"g{i:02d}"] for i in range(60)], cells @ weights)
    sent = spark.createDataFrame([(r["block"], -1, None, None) for r in blocks.table.select("block").collect()], sparse.REPLIES)
    plan = sparse._at_blocks(blocks, sent, lambda d, sent: None, "id string")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    routes = blocks.routes.collect()
    assert {r["slice"] for r in routes} == {0, 1, 5, 9} and all(len(r["idx"]) <= 2 * sparse.SLICE for r in routes)


def test_heads_and_components_of_features_in_several_slices(spark, cells, small_blocks):
    _, far = spread(spark, cells)
    settings = [tr.HeadSetting("a", lr=0.3, patience=1, weight_decay=0.01)]
    results = []
    for dictionary in (None, far):
        vectors, names = sparse.long_to_sparse(long(spark, cells), dictionary)
        metrics, oof = sparse.kfold_heads(vectors.join(labelled(spark, cells), "group_id"), names.select("feat_idx"), "group_id", "folds_col", settings, epochs=3)
        found = sparse.principal_components(sparse.pack(vectors, "group_id"), names.select("feat_idx"), 2)
        results.append([metrics.orderBy("fold", "epoch").drop("run_id").toPandas().to_numpy(float), oof.orderBy("group_id").select("p1").toPandas().to_numpy(),
                        np.array([r["v"] for r in found.loadings.orderBy("feat").collect()]), found.variances])
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*results, strict=True))


def test_nothing_of_a_run_stays_in_the_shared_folder(spark, cells):
    import glob
    import os
    from suasion.session import ensure_checkpoint_dir
    folder = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "suasion-scratch")
    before = set(glob.glob(folder + "/*"))
    sparse.pca_reduce(long(spark, cells), 2).count()
    new = {os.path.basename(p).rsplit("-", 1)[0] for p in set(glob.glob(folder + "/*")) - before}
    assert new <= {"dots", "loadings"}


def test_vectors_go_when_heads_have_packed_them(spark, cells):
    import os
    from suasion import session
    vectors, names = sparse.long_to_sparse(long(spark, cells))
    path = session._STORED[vectors].removeprefix("file:")
    rows = vectors.join(labelled(spark, cells), "group_id")
    assert os.path.exists(path)
    _, oof = sparse.kfold_heads(rows, names.select("feat_idx"), "group_id", "folds_col", [tr.HeadSetting("a")], epochs=1, spent=vectors)
    assert not os.path.exists(path) and oof.count() == sum(i % 13 != 0 and i % 17 != 1 for i in range(60))
