"""Hot keys, null keys, equal losses, repeated ids, settings that must act, stable plans."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from suasion.operators import evaluate as ev
from suasion.operators import features as fe
from suasion.operators import grid as gr
from suasion.operators import relational as rel
from suasion.operators import shape as sh
from suasion.operators import skew
from suasion.operators import splits as sp
from suasion.operators import train as tr

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["broadcast", "salted"])
def way(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    return request.param


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows has one key, some rows have none."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 40}") for i in range(900)]
    return spark.createDataFrame(rows, "i int, key string")


def test_key_join_with_a_hot_key(spark, hot, way):
    keys = ["hot", "k1", "k2", "k3", "zz", None]
    per = spark.createDataFrame([(k, str(n)) for n, k in enumerate(keys)], "key string, tag string")
    rows = [(r["i"], r["key"]) for r in hot.collect()]
    tag = {k: str(n) for n, k in enumerate(keys)}
    for safe in (False, True):
        def match(k):
            return k in tag and (safe or k is not None)
        got = {(r["i"], r["key"], r["tag"]) for r in skew.key_join(hot, per, "key", "left", safe).collect()}
        assert got == {(i, k, tag[k] if match(k) else None) for i, k in rows}
        for how, keep in (("left_semi", True), ("left_anti", False)):
            got = sorted(r["i"] for r in skew.key_join(hot, per, "key", how, safe).collect())
            assert got == sorted(i for i, k in rows if match(k) == keep), how
        assert skew.key_join(hot, per, "key", "inner", safe).count() == sum(match(k) for _, k in rows)


def test_salts_follow_the_data(spark, hot):
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        assert skew.salts_by_key(hot, "key")["hot"] == 10  # a third of the rows fills ten of thirty partitions
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_operators_with_a_hot_key(spark, hot, way):
    ids = {(r["key"], r["prompt_id"]) for r in sh.add_prompt_ids(hot, prompt="key").collect()}
    assert len(ids) == len({k for k, _ in ids}) == len({p for _, p in ids})
    split = sp.three_way_split(hot, "key")
    assert split.count() == 900 and split.groupBy("key").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    held = sp.group_holdout(hot, "key")
    a, b = held.filter("held_out"), held.filter(~F.col("held_out"))
    assert a.count() + b.count() == 900 and rel.overlap(a, b, "key").count() == 0
    rel.assert_disjoint(a, b, "key")
    assert rel.semi(hot, a, "key").count() == a.count()
    assert rel.anti(hot, a, "key").count() == b.count()
    with pytest.raises(AssertionError):
        rel.assert_disjoint(hot, hot, "key")


def test_best_fold_split_keeps_every_row_with_null_groups(spark):
    rows = [(i, None if i < 10 else f"g{i % 6}", i % 2) for i in range(22)]
    df = spark.createDataFrame(rows, "i int, g string, y int")
    out = sp.best_fold_split(df, "g", "y", k=3)
    assert out.count() == 22
    assert {(r["split"], r["folds_col"]) for r in out.filter("g is null").collect()} == {("train", None)}
    assert out.filter("split = 'test'").count() > 0
    folds = sp.stratified_group_kfold(df, "g", "y", 3)
    assert sp.best_fold(folds, "fold", 3).first()["fold"] is not None


def test_auc_null_key_and_large_counts(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("x", 1, 0.2), ("x", 0, 0.4)], "k string, y int, s double")
    assert {r["k"]: r["roc_auc"] for r in ev.roc_auc(df, "y", "s", ["k"]).collect()} == {None: 1.0, "x": 0.0}
    m = ev.split_metrics(df.select("k", "y", F.lit(0.0).alias("l0"), F.col("s").alias("l1")), "l0", "l1", "y", ["k"])
    assert {r["k"] for r in m.collect()} == {None, "x"}
    # counts whose product passes 2**63: the formula is in doubles
    plan = ev.roc_auc(df, "y", "s")._jdf.queryExecution().analyzed().toString()
    assert "cast(p" in plan and "as double" in plan


def test_equal_losses_give_no_difference(spark):
    df = spark.createDataFrame([(0.5,), (1.25,), (2.0,)], "a double").withColumn("b", F.col("a"))
    r = ev.paired_t(df, "a", "b").first()
    assert (r["t_stat"], r["n"], r["p_value"]) == (0.0, 3, 1.0)
    shifted = ev.paired_t(df.withColumn("b", F.col("a") + 1), "a", "b").first()
    assert shifted["t_stat"] is None and math.isnan(shifted["p_value"] if shifted["p_value"] is not None else float("nan"))


@pytest.mark.parametrize(("t", "dof", "p"), [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 2, 0.18350341907227), (12.706204736, 1, 0.05),
                                             (1.959963985, 10**7, 0.05), (4.0, 100, 0.00012152364)])
def test_t_p_values(t, dof, p):
    assert ev.t_two_sided_p(t, dof) == pytest.approx(p, rel=2e-4)


def test_ngram_norms_of_a_group_of_several_messages_sum_to_one(spark):
    df = spark.createDataFrame([("g", "a b b"), ("g", "b c"), ("h", "x"), (None, "q q"), ("e", ""), ("n", None)], "message_id string, message string")
    got = {(r["group_id"], r["feat"]): (r["value"], r["group_norm"]) for r in rel.ngram_counts(df).collect()}
    assert got == {("g", "a"): (1, 0.2), ("g", "b"): (3, 0.6), ("g", "c"): (1, 0.2), ("h", "x"): (1, 1.0), (None, "q"): (2, 1.0)}
    assert {r[0] for r in rel.groups_over_threshold(rel.ngram_counts(df), 5).collect()} == {"g"}


def test_long_punctuation_runs_are_read_once(spark):
    text = "a " + "!" * 200_000 + " ," + "." * 100_000 + "b" + "?" * 100_000
    df = spark.createDataFrame([(text,)], "t string")
    from suasion.functions.text import lower_tokens, token_count
    r = df.select(lower_tokens("t").alias("x"), token_count("t").alias("n")).first()
    assert r["x"] == ["a", "b"] and r["n"] == 2


def test_dense_vectors_refuse_a_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(sh, "MAX_DENSE", 3)
    df = spark.createDataFrame([("g", f"f{i}", 1.0) for i in range(4)], "group_id string, feat string, value double")
    with pytest.raises(ValueError, match="too many"):
        sh.long_to_dense(df)


def test_grid_runs_obey_their_epochs_and_choice(spark):
    rows = [([float(i % 7), float(i % 3)], int(i % 7 > 3), "train" if i % 3 else "validation") for i in range(90)]
    df = spark.createDataFrame(rows, "features array<double>, persuaded int, split string")
    s = gr.expand_grid(spark, {"parameters": {"epochs": {"values": [2, 5]}, "lr": {"value": 0.1}, "patience": {"value": 0},
                                              "load_best_model": {"values": [True, False]}}})
    metrics, final = gr.run_grid(df, s, features="features")
    want = {r["run_id"]: int(r["settings"]["epochs"]) for r in s.collect()}
    assert {r["run_id"]: r["m"] for r in metrics.groupBy("run_id").agg(F.max("epoch").alias("m")).collect()} == want
    for r in s.collect():
        f = final[r["run_id"]]
        assert f["theta"] == (f["best_theta"] if r["settings"]["load_best_model"] == "true" else f["last_theta"])


@pytest.mark.parametrize("odd", [{"luar_max_length": {"value": 32}}, {"classifier_output_dim": {"value": 3}}, {"momentum": {"value": 0.9}}])
def test_grid_refuses_settings_without_effect(spark, odd):
    df = spark.createDataFrame([([1.0], 1, "train")], "features array<double>, persuaded int, split string")
    with pytest.raises(ValueError, match="without effect"):
        gr.run_grid(df, gr.expand_grid(spark, {"parameters": odd}), features="features")


def test_grid_feature_combinations(spark):
    df = spark.createDataFrame([([1.0], [3.0], [5.0], [7.0])], "style_m array<double>, style_c array<double>, content_m array<double>, content_c array<double>")

    def of(**k):
        return df.select(gr.run_features(gr.DEFAULTS | k).alias("v")).first()["v"]
    assert of(combine_method="concat", include_prompt=True) == [3.0, 1.0, 7.0, 5.0]
    assert of(combine_method="average", include_prompt=True) == [2.0, 6.0]
    assert of(combine_method="sum", include_prompt=True, only_luar=True) == [4.0]
    assert of(combine_method="average") == [1.0, 5.0]


def test_rfa_prediction_is_the_sum_of_both_steps_and_uses_other_folds(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    z, x = rng.normal(size=300), rng.normal(size=(300, 2))
    y = 2 * z + x[:, 0] + 1.5 * x[:, 1] * z
    rows = [(i, float(z[i]), x[i].tolist(), float(y[i]), i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, z double, features array<double>, y double, fold int")
    out = fe.rfa_kfold(df, "y", ["z"], "features", "fold", reg_param=1e-6, keep=["i"]).collect()
    assert sorted(r["i"] for r in out) == list(range(300)) and all(r["fold"] == r["i"] % 4 for r in out)
    assert all(abs(r["step1"] + r["step2"] - r["prediction"]) < 1e-12 for r in out)
    assert np.mean([(r["prediction"] - y[r["i"]]) ** 2 for r in out]) < 0.05  # out of fold, the product is found


def test_rfa_refuses_more_folds_than_it_fits(spark, monkeypatch):
    monkeypatch.setattr(tr, "MAX_FOLDS", 3)
    rows = [(i, float(i % 7), [float(i % 3)], float(i), i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, z double, features array<double>, y double, fold int")
    with pytest.raises(ValueError, match="more than 3"):
        fe.rfa_kfold(df, "y", ["z"], "features", "fold", keep=["i"])


def test_l2_search_chooses_on_the_inner_folds(spark):
    rows = [([float(i % 5), float(i % 2)], int(i % 5 > 2), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "features array<double>, persuaded int, fold int")
    got = tr.l2_search(df, "fold", [0.0, 1.0]).collect()
    assert len(got) == 6 and sum(r["chosen"] for r in got) == 3
    assert all(r["inner_folds"] == 2 and (r["outer_auc"] is not None) == r["chosen"] for r in got)


def test_turns_pair_over_blocks_of_a_long_conversation(spark, tmp_path, monkeypatch):
    from suasion.plans import views as v
    monkeypatch.setattr(v, "TURNS_PER_BLOCK", 4)
    roles = ["user", "user", "user", "user", "user", "system", "system", "system", "system", "assistant", "system", "user", "assistant", "user"]
    spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["claim_id"], r["positive_id"], r["negative_id"]) for r in v.pairs(spark, str(tmp_path)).collect())
    assert got == sorted([(f"1:{i}", "1:9", "1:11") for i in range(5)] + [("1:11", "1:12", "1:13")])


def _shape(df) -> tuple:
    p = df._jdf.queryExecution().executedPlan().toString()
    return tuple(p.count(x) for x in ("FileScan", "Join", "Exchange"))


@pytest.mark.parametrize("name", ["txt03_sentences", "enc01_encode", "agg05_group_sizes", "txt01_word_count", "agg08_ngram_counts"])
def test_plan_does_not_depend_on_the_partition_count(spark, name):
    shapes = []
    for n in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        shapes.append(_shape(se.queries()[name](spark, SF)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert shapes[0] == shapes[1]


@pytest.mark.parametrize("name", ["txt03_sentences", "enc01_encode", "enc01_style_exact", "agg08_ngram_counts", "flt05_word_predicate"])
def test_row_jobs_do_not_shuffle(spark, name):
    p = se.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p, name


def test_no_exchange_on_the_feature_name(spark):
    for name in ("fea01_zscore_sql", "fea02_zscore_dense", "fea03_fit_apply", "rsh05_long_to_dense"):
        p = se.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(feat#" not in p, name


def test_scratch_tables_are_dropped(spark):
    import os

    from suasion.session import drop_scratch, scratch_path
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    folder = os.path.dirname(path.removeprefix("file:"))
    assert os.path.exists(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)
