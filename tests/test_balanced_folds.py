"""SPL01 balanced placement: contract, balance against the deal, and cases."""

import random

from pyspark.sql import functions as F

from suasion.operators import splits as sp


def frame(spark, groups, parts=4):
    rows = [(g, y) for g, ys in groups.items() for y in ys]
    return spark.createDataFrame(rows, "grp string, y int").repartition(parts)


def spread(df):
    """Spread of the class counts over the folds (squared shares of positives and of negatives), and of the sizes."""
    r = df.groupBy("fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    p, q = sum(x["p"] for x in r), sum(x["n"] - x["p"] for x in r)
    return sum((x["p"] / p) ** 2 + ((x["n"] - x["p"]) / q) ** 2 for x in r), max(x["n"] for x in r) - min(x["n"] for x in r)


def test_balance_is_no_worse_than_the_deal(spark):
    rng = random.Random(6)
    skewed = {f"g{i}": [int(rng.random() < (0.9 if i % 7 == 0 else 0.1)) for _ in range(int(rng.paretovariate(0.9)) % 400 + 1)] for i in range(150)}
    df = frame(spark, skewed)
    ours, dealt = sp.balanced_group_kfold(df, "grp", "y"), sp.stratified_group_kfold(df, "grp", "y")
    (p1, n1), (p2, n2) = spread(ours), spread(dealt)
    assert p1 <= p2 and n1 <= n2
    assert ours.count() == df.count() and ours.groupBy("grp").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    again = sp.balanced_group_kfold(frame(spark, skewed, 2), "grp", "y")
    assert ours.distinct().exceptAll(again.distinct()).count() == 0


def test_equal_groups_are_dealt_evenly(spark):
    df = frame(spark, {f"g{i}": [1, 0] for i in range(23)})
    sizes = sorted(r["n"] for r in sp.balanced_group_kfold(df, "grp", "y").groupBy("fold").agg(F.countDistinct("grp").alias("n")).collect())
    assert sizes == [4, 4, 5, 5, 5]
    assert sp.placed_folds([(2, 1, 23)], 5) == [[0, 1, 2]]


def test_null_groups_labels_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("a", 1), ("b", 0)], "grp string, y int")
    got = {(r["grp"], r["y"]): r["fold"] for r in sp.balanced_group_kfold(df, "grp", "y", k=2).collect()}
    assert got[None, 1] is None and got["a", None] == got["a", 1] != got["b", 0]
    assert sp.balanced_group_kfold(df.limit(0), "grp", "y").count() == 0


def test_one_group_with_a_third_of_the_rows(spark):
    df = frame(spark, {"hot": [i % 2 for i in range(1000)]} | {f"g{i}": [i % 2] * 20 for i in range(100)})
    f = sp.balanced_group_kfold(df, "grp", "y")
    assert f.count() == 3000 and f.filter("fold is null").count() == 0
    sizes = {r["fold"]: r["n"] for r in f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes.values()) < 1500
