"""Hypothesis: splitters are disjoint, complete, balanced and independent of partitioning."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suasion.operators import skew
from suasion.operators import splits as sp

SIZES = st.lists(st.integers(min_value=1, max_value=12), min_size=1, max_size=30)


def _df(spark, sizes, parts):
    rows = [(f"g{g}", (g + i) % 2) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "grp string, y int").repartition(parts)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=SIZES, parts=st.integers(min_value=1, max_value=6))
def test_group_kfold_contract(spark, sizes, parts):
    f = sp.group_kfold(_df(spark, sizes, parts), "grp", 5).cache()
    assert f.filter(F.col("folds_col").isNull()).count() == 0  # complete
    assert f.groupBy("grp").agg(F.countDistinct("folds_col").alias("k")).filter("k > 1").count() == 0  # disjoint
    counts = [r["count"] for r in f.groupBy("folds_col").count().collect()]
    if len(sizes) >= 5:
        assert max(counts) - min(counts) <= max(sizes)  # balance bound
    ref = sp.group_kfold(_df(spark, sizes, 1), "grp", 5)
    a = {tuple(r) for r in f.select("grp", "folds_col").distinct().collect()}
    b = {tuple(r) for r in ref.select("grp", "folds_col").distinct().collect()}
    assert a == b  # independent of partitioning


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=SIZES, parts=st.integers(min_value=1, max_value=6))
def test_three_way_and_holdout_contract(spark, sizes, parts):
    df = _df(spark, sizes, parts)
    g = len(sizes)
    s = sp.three_way_split(df, "grp")
    per = {r.split: r.n for r in s.select("grp", "split").distinct().groupBy("split")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per.get("train", 0) == (6 * g) // 10 and per.get("validation", 0) == (2 * g) // 10
    assert sum(per.values()) == g
    h = sp.group_holdout(df, "grp")
    assert h.filter("held_out").select("grp").distinct().count() == (2 * g) // 10
    assert h.count() == sum(sizes)


def test_hot_group_is_salted_and_complete(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)  # as for a table of groups too large to broadcast
    # one group with a third of all rows
    rows = [("hot" if i % 3 == 0 else f"g{i % 97}", i % 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, y int, i int").repartition(4)
    f = sp.group_kfold(df, "grp", 5)
    assert f.count() == 3000 and f.select("i").distinct().count() == 3000  # no row lost or doubled
    assert f.groupBy("grp").agg(F.countDistinct("folds_col").alias("k")).filter("k > 1").count() == 0
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan  # the hot group went through the salted join
    h = sp.group_holdout(df, "grp")
    assert h.count() == 3000 and h.groupBy("grp").agg(F.countDistinct("held_out").alias("k")).filter(
        "k > 1").count() == 0
    s = sp.stratified_group_kfold(df, "grp", "y", 5)
    assert s.count() == 3000 and s.filter(F.col("fold").isNull()).count() == 0
