"""Edge rows of FIXTURES §3, one group of tests per operator family."""

import json
import math

import pytest
from pyspark.sql import functions as F

from suasion.functions import text as tx
from suasion.operators import evaluate as ev
from suasion.operators import features as fe
from suasion.operators import grid as gr
from suasion.operators import relational as rel
from suasion.operators import shape as sh
from suasion.operators import splits as sp
from suasion.operators import train as tr
from suasion.sources import files as io

FEAT = "group_id string, feat string, value double"


# z-score ------------------------------------------------------------------------------
def test_zscore_sql_form_constant_single_and_absent(spark):
    rows = [("g1", "a", 1.0), ("g2", "a", 3.0), ("g1", "c", 5.0), ("g2", "c", 5.0), ("g1", "one", 2.0)]
    z = {(r.group_id, r.feat): r.value for r in fe.zscore_sql_form(spark.createDataFrame(rows, FEAT)).collect()}
    assert z[("g1", "a")] == pytest.approx(-1.0) and z[("g2", "a")] == pytest.approx(1.0)
    assert z[("g1", "c")] is None and z[("g1", "one")] is None  # stddev 0 → NULLIF → null
    assert ("g2", "one") not in z  # absent stays absent


def test_zscore_dense_form_fills_zero(spark):
    rows = [("g1", "a", 1.0), ("g2", "a", 3.0), ("g1", "c", 5.0), ("g2", "c", 5.0), ("g1", "b", None),
            ("g2", "b", 4.0), ("g3", "a", 2.0)]
    z = {(r.group_id, r.feat): r.value for r in fe.zscore_dense_form(spark.createDataFrame(rows, FEAT)).collect()}
    assert len(z) == 9  # full grid 3 groups × 3 feats
    assert z[("g1", "c")] == 0.0  # constant feature → 0
    assert z[("g3", "c")] == 0.0 and z[("g1", "b")] == 0.0  # absent / null cells → 0
    assert z[("g2", "b")] == 0.0  # single present value: sd 0
    assert z[("g1", "a")] == pytest.approx((1 - 2) / math.sqrt(2 / 3))


def test_fit_on_train_apply_elsewhere(spark):
    train = spark.createDataFrame([("g1", "a", 0.0), ("g2", "a", 2.0)], FEAT)
    test = spark.createDataFrame([("g9", "a", 4.0), ("g9", "zz", 1.0)], FEAT)
    out = fe.apply_zscore(test, fe.feature_stats(train)).collect()
    assert [(r.feat, r.value) for r in out] == [("a", 3.0)]


# pivot / dense --------------------------------------------------------------------------
def test_duplicate_cells_raise_and_average(spark):
    df = spark.createDataFrame([("g1", "a", 1.0), ("g1", "a", 3.0), ("g1", "b", 2.0), ("g2", "b", 4.0)], FEAT)
    with pytest.raises(ValueError):
        sh.assert_unique_cells(df)
    dense, dic = sh.long_to_dense(df)
    got = {r.group_id: r.features for r in dense.collect()}
    assert got == {"g1": [2.0, 2.0], "g2": [0.0, 4.0]}
    assert [r.feat for r in dic.orderBy("feat_idx").collect()] == ["a", "b"]


def test_vector_to_long_four_digits(spark):
    df = spark.createDataFrame([("g", [float(i) for i in range(1001)])], "group_id string, features array<double>")
    names = {r.feat for r in sh.vector_to_long(df).collect()}
    assert "dim_feat_000" in names and "dim_feat_999" in names and "dim_feat_1000" in names


def test_wide_to_long_roundtrip(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0)], "group_id string, x double, y double")
    assert sorted((r.feat, r.value) for r in sh.wide_to_long(df).collect()) == [("x", 1.0), ("y", 2.0)]


# PCA ----------------------------------------------------------------------------------
def test_pca_orthogonal_ordered_signed(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    X = rng.normal(size=(40, 5)) * np.array([5.0, 3.0, 1.0, 0.5, 0.1])
    rows = [(f"g{i:02d}", f"f{j}", float(X[i, j])) for i in range(40) for j in range(5)]
    out = fe.pca_reduce(spark.createDataFrame(rows, FEAT), 3).collect()
    P = np.zeros((40, 3))
    for r in out:
        P[int(r.group_id[1:]), int(r.feat[-3:])] = r.value
    assert np.allclose(P.mean(axis=0), 0, atol=1e-6)  # centred
    var = P.var(axis=0)
    assert var[0] >= var[1] >= var[2]
    C = np.cov(P.T)
    assert abs(C[0, 1]) < 1e-6 * max(1, var[0])
    k1 = fe.pca_reduce(spark.createDataFrame(rows, FEAT), 1).select("feat").distinct().collect()
    assert [r.feat for r in k1] == ["dim_feat_000"]


# ids ----------------------------------------------------------------------------------
@pytest.mark.parametrize("n,width", [(9, 1), (10, 2), (11, 2), (100, 3)])
def test_prompt_id_width(spark, n, width):
    df = spark.createDataFrame([(f"prompt {i:03d}", i) for i in range(n)], "prompt string, i int")
    ids = [r.prompt_id for r in sh.add_prompt_ids(df).orderBy("prompt").collect()]
    assert ids[0] == "p" + "0" * width and all(len(x) == width + 1 for x in ids)
    assert ids == sorted(ids)


def test_prompt_ids_equal_prompts_and_code_point_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("é",), ("Z",), ("a",)], "prompt string")
    got = {(r.prompt, r.prompt_id) for r in sh.add_prompt_ids(df).collect()}
    assert got == {("Z", "p0"), ("a", "p1"), ("b", "p2"), ("é", "p3")}


def test_ids_skipped_if_present(spark):
    df = spark.createDataFrame([("a", "x")], "prompt string, prompt_id string")
    assert sh.add_prompt_ids(df).collect()[0].prompt_id == "x"


def test_row_ids_follow_sort(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "2"), ("a", "1")], "prompt string, message string")
    got = [(r.prompt, r.message, r.message_id) for r in
           sh.add_row_ids(df, ["prompt", "message"]).orderBy("message_id").collect()]
    assert got == [("a", "1", "m0"), ("a", "2", "m1"), ("b", "1", "m2")]


# time cut -----------------------------------------------------------------------------
def test_time_cut_null_and_boundary(spark):
    df = spark.createDataFrame([(1, 99), (2, 100), (3, None)], "id int, t bigint")
    a, b = rel.time_cut(df, 100, "t")
    assert [r.id for r in a.collect()] == [1] and [r.id for r in b.collect()] == [2]


# splits -------------------------------------------------------------------------------
def _groups_df(spark, sizes, label_fn=lambda g, i: i % 2):
    rows = [(f"g{g}", label_fn(g, i)) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "grp string, y int")


def test_group_kfold_properties(spark):
    sizes = [30] + [3] * 40 + [1] * 17
    df = _groups_df(spark, sizes)
    f = sp.group_kfold(df, "grp", 5)
    per = f.groupBy("grp").agg(F.countDistinct("folds_col").alias("k")).collect()
    assert all(r.k == 1 for r in per)
    counts = [r["count"] for r in f.groupBy("folds_col").count().collect()]
    assert sum(counts) == sum(sizes) and len(counts) == 5
    assert max(counts) - min(counts) <= 30
    again = sp.group_kfold(df.repartition(7), "grp", 5)
    a = {(r.grp, r.folds_col) for r in f.select("grp", "folds_col").distinct().collect()}
    b = {(r.grp, r.folds_col) for r in again.select("grp", "folds_col").distinct().collect()}
    assert a == b  # independent of partitioning


def test_fewer_groups_than_folds_and_one_group(spark):
    f = sp.group_kfold(_groups_df(spark, [4, 2]), "grp", 5)
    assert {r.folds_col for r in f.collect()} == {0, 1}
    f1 = sp.group_kfold(_groups_df(spark, [5]), "grp", 5)
    assert {r.folds_col for r in f1.collect()} == {0}


def test_stratified_raises_when_classes_too_small(spark):
    df = _groups_df(spark, [1, 1, 1], lambda g, i: g % 2)
    with pytest.raises(ValueError):
        sp.stratified_group_kfold(df, "grp", "y", 5)


def test_stratified_balance_and_one_class(spark):
    df = _groups_df(spark, [4] * 50, lambda g, i: 1 if (g * 7 + i) % 3 == 0 else 0)
    f = sp.stratified_group_kfold(df, "grp", "y", 5)
    pos = [r.p for r in f.groupBy("fold").agg(F.sum("y").alias("p")).collect()]
    assert max(pos) - min(pos) <= 4
    one = sp.stratified_group_kfold(_groups_df(spark, [2] * 10, lambda g, i: 0), "grp", "y", 5)
    assert one.filter(F.col("fold").isNull()).count() == 0


def test_holdout_exact_size_and_disjoint(spark):
    df = _groups_df(spark, [2] * 23)
    h = sp.group_holdout(df, "grp")
    held = h.filter("held_out").select("grp").distinct().count()
    assert held == int(0.2 * 23)
    rel.assert_disjoint(h.filter("held_out"), h.filter(~F.col("held_out")), "grp")


def test_three_way_sizes(spark):
    s = sp.three_way_split(_groups_df(spark, [1] * 17), "grp")
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": int(0.6 * 17), "validation": int(0.2 * 17), "test": 17 - 10 - 3}


def test_best_fold_first_on_ties(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (2,)], "fold int")
    b = sp.best_fold(df, "fold", 4).collect()[0]
    assert (b.fold, b.size, b.diff) == (0, 1, 0)


def test_anti_join_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted(r.id for r in rel.anti(df, keys, "k").collect()) == [2, 3]


# pair melt ----------------------------------------------------------------------------
def test_pair_melt_duplicates_and_null_body(spark):
    schema = io.PAIR_DUMP
    rows = [("c1", "claim", 1, "r1", "same", 2, "r2", None, 3), ("c2", "claim2", 4, "r1", "same", 5, "r3", "x", 6)]
    m = sh.melt_pairs(spark.createDataFrame(rows, schema))
    assert m.count() == 4 and m.filter(F.col("message_id") == "r1").count() == 2
    assert m.filter(F.col("message").isNull()).collect()[0].persuaded == 0
    u = sh.melt_pairs_union(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, u.collect()))


# token merge and words -----------------------------------------------------------------
@pytest.mark.parametrize("prompt,message,budget,want", [
    ("p1 p2 p3", "m1 m2", 4, "p1 p2 m1 m2"),
    ("p1 p2", "m1 m2 m3", 3, "m1 m2 m3"),
    ("p1 p2", "m1 m2 m3 m4", 3, "m1 m2 m3 m4"),
    ("", "m1", 4, "m1"),
    ("p1 p2", "", 1, "p1"),
])
def test_token_budget_merge(spark, prompt, message, budget, want):
    df = spark.createDataFrame([(prompt, message)], "p string, m string")
    assert df.select(tx.token_budget_merge("p", "m", budget).alias("x")).collect()[0].x == want


def test_word_count_edges(spark):
    df = spark.createDataFrame([("",), ("   ",), ("a\tb\nc  d",), (None,), (" x ",)], "t string")
    assert [r.n for r in df.select(tx.word_count("t").alias("n")).collect()] == [0, 0, 4, None, 1]


def test_sentences_keep_punctuation(spark):
    df = spark.createDataFrame([("One. Two! Three? Four",)], "t string")
    assert df.select(tx.sentences("t").alias("s")).collect()[0].s == ["One.", "Two!", "Three?", "Four"]


def test_fill_time_columns_versions(spark):
    df = spark.createDataFrame([("m", 5)], "message_id string, message_created_utc bigint")
    v2 = sh.fill_time_columns(df, "cmv_v002").collect()[0]
    assert v2.message_created_utc == 5 and v2.claim_created_utc is None
    v1 = sh.fill_time_columns(df, "cmv_v001").collect()[0]
    assert v1.message_created_utc is None
    with pytest.raises(ValueError):
        sh.fill_time_columns(df, "other")


# metrics ------------------------------------------------------------------------------
SC = "y int, s double, p int"


def test_auc_edges(spark):
    one = spark.createDataFrame([(1, 0.2, 1), (1, 0.4, 1)], SC)
    assert ev.roc_auc(one, "y", "s").collect()[0].roc_auc == 0.0
    flat = spark.createDataFrame([(1, 0.5, 1), (0, 0.5, 0), (1, 0.5, 1), (0, 0.5, 0)], SC)
    assert ev.roc_auc(flat, "y", "s").collect()[0].roc_auc == 0.5
    ties = spark.createDataFrame([(0, 0.1, 0), (1, 0.4, 0), (0, 0.4, 0), (1, 0.8, 1)], SC)
    assert ev.roc_auc(ties, "y", "s").collect()[0].roc_auc == pytest.approx(0.875)


def test_f1_macro_never_predicted(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (1, 0.0, 0), (0, 0.0, 0), (0, 0.0, 0), (0, 0.0, 0)], SC)
    f = ev.macro_f1(df, "y", "p").collect()[0].f1_macro
    assert f == pytest.approx(0.5 * (2 * 3 / (2 * 3 + 2)))
    assert ev.most_frequent_class(df, "y").collect()[0].mfc == pytest.approx(0.6)


def test_paired_t(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.0)], "a double, b double")
    r = ev.paired_t(df, "a", "b").collect()[0]
    d = [0.5, 1.0, 1.0]
    m = sum(d) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in d) / 2)
    assert r.t_stat == pytest.approx(m / (sd / math.sqrt(3)))


# early stopping -----------------------------------------------------------------------------
def _stop(spark, losses, patience=3, delta=0.002):
    df = spark.createDataFrame([("g", i + 1, l) for i, l in enumerate(losses)], "g string, epoch int, eval_loss double")
    return tr.early_stopping(df, "g", patience=patience, min_delta=delta).collect()[0]


def test_early_stopping_rule(spark):
    r = _stop(spark, [0.9, 0.8, 0.799, 0.7995, 0.81])
    assert (r.best_loss, r.best_epoch, r.stop_epoch, r.stopped_early) == (0.8, 2, 5, True)
    r0 = _stop(spark, [0.9, 0.95, 0.97, 0.99], patience=0)
    assert (r0.stop_epoch, r0.stopped_early, r0.best_epoch) == (4, False, 1)
    exact = _stop(spark, [0.5, 0.498], patience=1, delta=0.002)  # not strictly better
    assert (exact.best_epoch, exact.stopped_early) == (1, True)
    last = _stop(spark, [0.9, 0.95, 0.96, 0.5], patience=5)
    assert (last.best_epoch, last.stopped_early) == (4, False)


# grid -----------------------------------------------------------------------------------
def test_grid_expand(spark):
    cfg = {"method": "grid", "parameters": {"min_delta": {"value": 0.002}, "weight_decay": {"values": [0.005, 0.001]},
                                            "lr": {"values": [0.01]}, "new_key": {"value": "x"}}}
    rows = gr.expand_grid(spark, cfg).collect()
    assert len(rows) == 2 and len({r.run_id for r in rows}) == 2
    s = [{k: json.loads(v) for k, v in r.settings.items()} for r in rows]
    assert {x["weight_decay"] for x in s} == {0.005, 0.001}
    assert all(x["min_delta"] == 0.002 and x["lr"] == 0.01 and x["new_key"] == "x" and x["patience"] == 3 for x in s)
    with pytest.raises(ValueError):
        gr.expand_grid(spark, {"method": "random", "parameters": {}})


# training -------------------------------------------------------------------------------
def test_heads_learn_and_roundtrip(spark, tmp_path):
    import numpy as np
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = i % 2
        x = (rng.normal(size=4) + (1.5 if y else -1.5)).tolist()
        rows.append((f"g{i}", x, y, "train" if i < 300 else "validation"))
    df = spark.createDataFrame(rows, "group_id string, features array<double>, persuaded int, split string")
    settings = [tr.HeadSetting("a", lr=0.05), tr.HeadSetting("b", lr=0.05, weight_decay=0.01)]
    metrics, final = tr.train_heads(df, settings, epochs=15)
    last = {r.run_id: r for r in metrics.filter("epoch = 15").collect()}
    assert last["a"].eval_acc > 0.9 and last["a"].train_loss < math.log(2)
    path = str(tmp_path / "head")
    tr.save_head(spark, final["a"]["theta"], final["a"]["best_epoch"], path)
    theta, _ = tr.load_head(spark, path)
    s1 = tr.head_scores(df, final["a"]["theta"]).select("p1").collect()
    s2 = tr.head_scores(df, theta).select("p1").collect()
    assert s1 == s2


# sources -------------------------------------------------------------------------------
def test_json_array_and_lines(spark, tmp_path):
    p = tmp_path / "arr.json"
    p.write_text(json.dumps([{"prompt": "a", "message": "b", "outcome_label": 1},
                             {"prompt": None, "message": "c", "outcome_label": 0}]))
    df = io.read_json_records(spark, str(p), io.LABELLED_RECORDS, array_form=True)
    assert df.count() == 2 and df.filter(F.col("prompt").isNull()).count() == 1
    out = str(tmp_path / "arrays")
    io.write_json_array_files(df.repartition(3), out)
    back = io.read_json_records(spark, out, io.LABELLED_RECORDS, array_form=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_vec_combine_width_check(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    ok = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert ok.select(fe.vec_average("a", "b").alias("v")).collect()[0].v == [2.0, 3.0]
    with pytest.raises(Exception):
        df.select(fe.vec_sum("a", "b").alias("v")).collect()


def test_token_threshold_fast_path_equals_table_path(spark):
    df = spark.createDataFrame([("a", "One, two. 'three' -- four"), ("b", "x"), ("c", None), ("d", "... ?")],
                               "message_id string, message string")
    grams = rel.ngram_counts(df, "message", "message_id")
    for n in (1, 2, 4, 5):  # positive thresholds: token-less groups fail both ways
        slow = {r.message_id for r in rel.keep_frequent_groups(df, grams, n, "group_id", "message_id").collect()}
        fast = {r.message_id for r in rel.keep_min_tokens(df, n, "message").collect()}
        assert slow == fast, n


def test_residualize_orthogonal(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        z = rng.normal(size=2)
        rows.append((float(z[0]), float(z[1]), float(2 * z[0] - z[1] + rng.normal() * 0.1 + 1.0)))
    df = spark.createDataFrame(rows, "a double, b double, y double")
    r = fe.residualize(df, "y", ["a", "b"]).toPandas()
    assert abs(r["residual"].mean()) < 1e-6
    assert abs((r["residual"] * r["a"]).mean()) < 1e-6 and abs((r["residual"] * r["b"]).mean()) < 1e-6


def test_factor_interactions(spark):
    f = spark.createDataFrame([("g", "x", 2.0)], FEAT)
    z = spark.createDataFrame([("g", "z0", 3.0), ("g", "z1", -1.0)], "group_id string, factor string, fvalue double")
    got = {(r.feat, r.value) for r in fe.factor_interactions(f, z).collect()}
    assert got == {("x", 2.0), ("x*z0", 6.0), ("x*z1", -2.0)}


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    if not pos or not neg:
        return 0.0
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_with_hot_key(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 != 0 else f"k{i % 5}"  # two thirds of the rows in one key
        y = int(rng.random() < 0.4)
        s = round(float(rng.normal(0.3 * y, 1.0)), 1)  # rounded: many ties
        rows.append((key, y, s))
    df = spark.createDataFrame(rows, "key string, y int, s double").repartition(5)
    got = {r.key: r.roc_auc for r in ev.roc_auc(df, "y", "s", ["key"]).collect()}
    for key in {r[0] for r in rows}:
        ys = [r[1] for r in rows if r[0] == key]
        ss = [r[2] for r in rows if r[0] == key]
        assert got[key] == pytest.approx(_auc_brute(ys, ss), abs=1e-12)
    overall = ev.roc_auc(df, "y", "s").first()[0]
    assert overall == pytest.approx(_auc_brute([r[1] for r in rows], [r[2] for r in rows]), abs=1e-12)


def test_zscore_dense_vectors_equal_dense_form(spark):
    rows = [("g1", "a", 1.0), ("g2", "a", 3.0), ("g1", "c", 5.0), ("g2", "c", 5.0), ("g1", "b", None),
            ("g2", "b", 4.0), ("g3", "a", 2.0), ("g3", "b", float("nan"))]
    df = spark.createDataFrame(rows, FEAT)
    long = {(r.group_id, r.feat): r.value for r in fe.zscore_dense_form(df).collect()}
    dense, dic = fe.zscore_dense_vectors(df)
    names = {r.feat_idx: r.feat for r in dic.collect()}
    vec = {(r.group_id, names[i]): x for r in dense.collect() for i, x in enumerate(r.features)}
    assert vec.keys() == long.keys()
    for k in vec:
        assert vec[k] == pytest.approx(long[k])


def test_kfold_heads_equal_separate_fits(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((f"g{i}", (rng.normal(size=3) + (0.8 if y else -0.8)).tolist(), y, i % 3))
    df = spark.createDataFrame(rows, "group_id string, features array<double>, persuaded int, fold int")
    settings = [tr.HeadSetting("a", lr=0.05, patience=2, min_delta=0.001), tr.HeadSetting("b", lr=0.02)]
    _, oof = tr.kfold_heads(df, "fold", settings, epochs=12, keep=["group_id"])
    got = {(r.run_id, r.group_id): r.p1 for r in oof.collect()}
    assert len(got) == 600
    for s in settings:
        for f in range(3):
            part = df.withColumn("split", F.when(F.col("fold") == f, "validation").otherwise("train"))
            _, final = tr.train_heads(part, [s], epochs=12)
            ref = tr.head_scores(part.filter(F.col("fold") == f), final[s.run_id]["theta"]).collect()
            for r in ref:
                assert got[(s.run_id, r.group_id)] == pytest.approx(r.p1, abs=1e-9)


def test_replace_table_catalog_and_path(spark, tmp_path):
    df = spark.createDataFrame([("g2", "b", 1.0, 1.0), ("g1", "a", 2.0, 2.0)], io.FEATURE_TABLE)
    path = str(tmp_path / "feat_tbl")
    io.replace_table(df, path, cluster_by=["group_id", "feat"], table_name="suasion_test_feat")
    io.replace_table(df.limit(1), path, cluster_by=["group_id", "feat"], table_name="suasion_test_feat")
    assert spark.table("suasion_test_feat").count() == 1  # replaced, not appended
    assert io.read_feature_table(spark, "suasion_test_feat", with_group_norm=False).columns == [
        "group_id", "feat", "value"]
    spark.sql("DROP TABLE suasion_test_feat")


def test_l2_search_heads_ranks_all(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(f"g{i}", (rng.normal(size=3) + (1.0 if i % 2 else -1.0)).tolist(), i % 2, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "group_id string, features array<double>, persuaded int, fold int")
    r = tr.l2_search_heads(df, "fold", [0.0, 0.1, 1.0], epochs=8).collect()
    assert len(r) == 3 and r[0].roc_auc >= r[-1].roc_auc and all(x.roc_auc > 0.5 for x in r)


@pytest.mark.parametrize("t,dof", [(2.0, 10), (0.0, 5), (3.5, 30), (-1.0, 100), (0.5, 3)])
def test_t_pvalue_against_integration(t, dof):
    import numpy as np
    xs = np.linspace(abs(t), 400.0, 2_000_001)
    dens = (1 + xs * xs / dof) ** (-(dof + 1) / 2) * math.exp(
        math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    assert ev.t_two_sided_p(t, dof) == pytest.approx(2 * np.trapezoid(dens, xs), rel=1e-5, abs=1e-9)


def test_paired_t_p_value_column(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.0), (1.5, 1.4)], "a double, b double")
    r = ev.paired_t(df, "a", "b").collect()[0]
    assert 0.0 < r.p_value < 1.0 and r.p_value == pytest.approx(ev.t_two_sided_p(r.t_stat, 3))


def test_feature_model_table(spark):
    m = spark.createDataFrame([("style", "lr", 0.716), ("style", "etc", 0.695), ("content", "lr", 0.624),
                               ("content", "etc", 0.609)], "feature_set string, model string, roc_auc double")
    rows = gr.feature_model_table(m).collect()
    assert [r.feature_set for r in rows] == ["style", "content"]
    assert rows[0].lr == 0.716 and rows[0].etc == 0.695 and rows[0].best == 0.716
