"""Leak-free splits and folds (SPL01-08).

Contract (same properties as the reference, not the same ids): no group crosses
folds or splits, every row is assigned, the result is a pure function of the data
and the seed (independent of partitioning), fold sizes differ by at most the
largest group.  Randomness is ``md5('<seed>:<group>')``; group order is computed by
``global_index`` (no one-partition window) on the per-group table, and rows get
their fold through ``key_join``, which splits a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suasion.operators.numbering import global_index
from suasion.operators.skew import key_join
from suasion.session import checkpointed


def group_hash(group: str, seed: int = 42):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))


def _groups(df: DataFrame, group: str, label: str | None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if label:
        aggs.append(F.sum(F.col(label).cast("bigint")).alias("n1"))
    return df.groupBy(group).agg(*aggs)


def _deal(groups: DataFrame, order: list, k: int, fold_col: str) -> DataFrame:
    ranked = global_index(groups, order, "_rank")
    return ranked.select(*groups.columns, (F.col("_rank") % k).cast("int").alias(fold_col))


# SPL01 ----------------------------------------------------------------------------
def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42,
                           fold_col: str = "fold") -> DataFrame:
    """Deal groups to folds in (size desc, positives desc, seeded hash) order."""
    groups = _groups(df, group, label).filter(F.col(group).isNotNull())
    # the reference raises when every class has fewer than k members
    cls = df.agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("t")).first()
    if cls["t"] and max(cls["p"] or 0, cls["t"] - (cls["p"] or 0)) < k:
        raise ValueError(f"{k} folds need a class with at least {k} rows")
    order = [F.desc("n"), F.desc("n1"), group_hash(group, seed).asc(), F.col(group).asc()]
    folds = _deal(groups, order, k, fold_col).select(group, fold_col)
    return key_join(df, folds, group)


def placed_folds(classes: list[tuple[int, int, int]], k: int) -> list[list[int]]:
    """For each (size, positives, groups), largest first: the folds of the groups left over when every fold got
    ``groups // k`` of them.  Each goes where it least raises the spread of the classes' counts over the folds (the sum
    of squares of negatives and of positives, each as shares of all), ties to the fold with fewest rows, then the first."""
    positives = sum(p * c for _, p, c in classes) or 1
    negatives = sum((n - p) * c for n, p, c in classes) or 1
    neg, pos, out = [0] * k, [0] * k, []
    for n, p, c in classes:
        even, left = divmod(c, k)
        neg, pos = [x + even * (n - p) for x in neg], [x + even * p for x in pos]
        mine = []
        for _ in range(left):
            free = [f for f in range(k) if f not in mine]  # equal groups go to different folds
            best = min(free, key=lambda f: (neg[f] * (n - p) * positives ** 2 + pos[f] * p * negatives ** 2, neg[f] + pos[f], f))
            neg[best], pos[best] = neg[best] + n - p, pos[best] + p
            mine.append(best)
        out.append(mine)
    return out


def balanced_group_kfold(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """SPL01 by greedy placement: groups of one size and number of positives are dealt evenly, the rest largest first to
    the fold that least raises the spread of the class counts.  The loop runs over the distinct (size, positives), whose
    number grows with the rows to the power of two thirds at most, not over groups; equal groups are told apart by a
    seeded hash.  Rows of a null group get a null fold."""
    groups = _groups(df, group, label).filter(F.col(group).isNotNull()).withColumn("n1", F.coalesce("n1", F.lit(0)))
    order = [F.desc("n"), F.desc("n1"), group_hash(group, seed).asc(), F.col(group).asc()]
    ranked = global_index(groups, order, "_rank")
    found = [tuple(r) for r in ranked.groupBy("n", "n1").count().orderBy(F.desc("n"), F.desc("n1")).collect()]
    rows, start = [], 0
    for (n, p, c), extra in zip(found, placed_folds(found, k), strict=True):
        rows.append((n, p, start, c // k * k, extra))
        start += c
    classes = df.sparkSession.createDataFrame(rows, "_n long, _n1 long, _start long, _even long, _extra array<int>")  # one row per class
    at = F.col("_rank") - F.col("_start")
    dealt = ranked.join(classes, (F.col("n") == F.col("_n")) & (F.col("n1") == F.col("_n1"))).select(
        group, F.when(at < F.col("_even"), (at % k).cast("int")).otherwise(F.get("_extra", (at - F.col("_even")).cast("int"))).alias(fold_col))
    return key_join(df, dealt, group)


# SPL04 ----------------------------------------------------------------------------
def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42, fold_col: str = "folds_col") -> DataFrame:
    """Size-balanced group folds: deal in (size desc, seeded hash) order."""
    groups = _groups(df, group, None).filter(F.col(group).isNotNull())
    order = [F.desc("n"), group_hash(group, seed).asc(), F.col(group).asc()]
    folds = _deal(groups, order, k, fold_col).select(group, fold_col)
    return key_join(df, folds, group)


# SPL02 ----------------------------------------------------------------------------
def best_fold(df: DataFrame, fold_col: str = "fold", k: int = 5) -> DataFrame:
    """Fold whose size is nearest ``n // k`` (first fold on ties): one row (fold, size, diff).
    Rows without a fold (a null group) count in n but are no candidate."""
    sizes = df.groupBy(fold_col).agg(F.count(F.lit(1)).alias("size"))
    # the size table has one row per fold (k rows): its total is a window over k rows
    total = F.sum("size").over(Window.partitionBy())
    d = sizes.select(fold_col, "size", F.abs(F.col("size") - F.floor(total / k)).cast("bigint").alias("diff"))
    b = d.filter(F.col(fold_col).isNotNull()).agg(F.min(F.struct("diff", fold_col, "size")).alias("_b"))
    return b.select(F.col("_b." + fold_col).alias(fold_col), F.col("_b.size").alias("size"),
                    F.col("_b.diff").alias("diff"))


def best_fold_split(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42,
                    folds_col: str = "folds_col") -> DataFrame:
    """SPL01 → SPL02 → SPL03: best fold is the test split, the rest is re-folded.  Rows with a null
    group are train rows without a fold."""
    f = stratified_group_kfold(df, group, label, k, seed, "_fold")
    f = checkpointed(f)  # folds are read by the size count and by both halves
    best = best_fold(f, "_fold", k).first()["_fold"]
    in_test = F.coalesce(F.col("_fold") == best, F.lit(False))
    test = f.filter(in_test).drop("_fold")
    train = f.filter(~in_test).drop("_fold")
    train = stratified_group_kfold(train, group, label, k, seed, folds_col)
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn(folds_col, F.lit(None).cast("int")).withColumn("split", F.lit("test"))))


# SPL05 ----------------------------------------------------------------------------
def group_holdout(df: DataFrame, group: str, fraction_tenths: int = 2, seed: int = 42,
                  flag: str = "held_out") -> DataFrame:
    """``int(0.2·G)`` groups, chosen as the first in seeded hash order (exact size)."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    ranked, g = global_index(groups, [group_hash(group, seed).asc(), F.col(group).asc()], "_rank",
                             return_total=True)
    chosen = ranked.select(group, (F.col("_rank") < (g * fraction_tenths) // 10).alias(flag))
    return key_join(df, chosen, group).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


# SPL06 ----------------------------------------------------------------------------
def three_way_split(df: DataFrame, group: str, seed: int = 42, train_tenths: int = 6,
                    val_tenths: int = 2, split_col: str = "split") -> DataFrame:
    """Train ``int(.6G)`` groups, validation ``int(.2G)``, test the rest, over hashed group order."""
    groups = df.select(group).distinct()
    ranked, g = global_index(groups, [group_hash(group, seed).asc_nulls_first(),
                                      F.col(group).asc_nulls_first()], "_rank", return_total=True)
    ntr = (g * train_tenths) // 10  # MTH01: int(0.6 * G) as exact integer arithmetic
    nva = (g * val_tenths) // 10
    lab = (F.when(F.col("_rank") < ntr, "train").when(F.col("_rank") < ntr + nva, "validation")
           .otherwise("test"))
    assigned = ranked.select(group, lab.alias(split_col))
    return key_join(df, assigned, group, null_safe=True)


# SPL07 ----------------------------------------------------------------------------
def time_group_recipe(df: DataFrame, group: str, time_col: str, cutoff: int, k: int = 5,
                      seed: int = 42, folds_col: str = "folds_col", ts_col: str | None = None) -> DataFrame:
    """Out-of-time test (``>=`` cutoff), 20% group holdout of the rest, group folds on the remainder.

    Output: every row with a non-null time, ``split`` in {train, test_in_time,
    test_out_of_time} and ``folds_col`` on train rows only.
    """
    from suasion.operators.relational import time_cut
    in_time, out_time = time_cut(df, cutoff, time_col, ts_col)
    h = group_holdout(in_time, group, 2, seed, "_held")
    train = group_kfold(h.filter(~F.col("_held")).drop("_held"), group, k, seed, folds_col)
    test_in = h.filter(F.col("_held")).drop("_held")
    none = F.lit(None).cast("int")
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test_in.withColumn(folds_col, none).withColumn("split", F.lit("test_in_time")))
            .unionByName(out_time.withColumn(folds_col, none).withColumn("split", F.lit("test_out_of_time"))))


# SPL08 ----------------------------------------------------------------------------
def fold_split(df: DataFrame, fold: int, folds_col: str = "folds_col") -> tuple[DataFrame, DataFrame]:
    """(train = other folds, validation = this fold)."""
    return df.filter(F.col(folds_col) != fold), df.filter(F.col(folds_col) == fold)


def fold_counts(df: DataFrame, folds_col: str = "folds_col") -> DataFrame:
    """Train and validation rows of every fold, from one count per fold (rows are not copied per fold)."""
    sizes = df.filter(F.col(folds_col).isNotNull()).groupBy(folds_col).agg(F.count(F.lit(1)).alias("n_validation"))
    total = F.sum("n_validation").over(Window.partitionBy())  # over k rows
    return sizes.select(F.col(folds_col).alias("fold"), (total - F.col("n_validation")).alias("n_train"), "n_validation")
