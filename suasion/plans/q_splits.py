"""Queries for SPL01-08 (and MTH01/02 inside them)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from suasion.functions.numeric import floor_fraction, utc_cutoff
from suasion.operators import splits as sp
from suasion.plans import views as v
from suasion.plans.q_relational import EV_FOLDS_SQL, HELD_SQL, ORD_FOLDS_SQL, SPLIT3_SQL
from suasion.plans.registry import register

W = v.with_views
CUTOFF = utc_cutoff(2024, 1, 24)


@register("spl01_stratified_group_kfold", W("ord") + ORD_FOLDS_SQL + """
SELECT o.o_orderkey, f.fold FROM ord o JOIN ord_folds f ON o.o_custkey = f.o_custkey""")
def spl01(spark, sf):
    f = sp.stratified_group_kfold(v.ord_(spark, sf), "o_custkey", "label", 5, 42, "fold")
    return f.filter(F.col("o_custkey").isNotNull()).select("o_orderkey", "fold")


@register("spl02_best_fold", W("ord") + ORD_FOLDS_SQL + "SELECT fold, size, diff FROM ord_best")
def spl02(spark, sf):
    f = sp.stratified_group_kfold(v.ord_(spark, sf), "o_custkey", "label", 5, 42, "fold")
    return sp.best_fold(f, "fold", 5)


@register("spl03_nested_folds", W("ord") + ORD_FOLDS_SQL + """,
rest AS (SELECT o_custkey, n, n1 FROM ord_folds WHERE fold <> (SELECT fold FROM ord_best)),
rest_folds AS (SELECT o_custkey, CAST((row_number() OVER (ORDER BY n DESC, n1 DESC,
                      md5('42:' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1) % 5 AS INTEGER) AS folds_col
               FROM rest)
SELECT o.o_orderkey, CASE WHEN r.o_custkey IS NULL THEN 'test' ELSE 'train' END AS split, r.folds_col
FROM ord o JOIN ord_folds f ON o.o_custkey = f.o_custkey LEFT JOIN rest_folds r ON o.o_custkey = r.o_custkey""")
def spl03(spark, sf):
    s = sp.best_fold_split(v.ord_(spark, sf).filter(F.col("o_custkey").isNotNull()), "o_custkey", "label")
    return s.select("o_orderkey", "split", "folds_col")


NULL_GROUPS_SQL = W("ord").replace("o_custkey,", "CASE WHEN o_custkey % 10 < 4 THEN NULL ELSE o_custkey END AS o_custkey,", 1)


@register("spl03_null_groups", NULL_GROUPS_SQL + ORD_FOLDS_SQL + """,
rest AS (SELECT o_custkey, n, n1 FROM ord_folds WHERE fold <> (SELECT fold FROM ord_best)),
rest_folds AS (SELECT o_custkey, CAST((row_number() OVER (ORDER BY n DESC, n1 DESC,
                      md5('42:' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1) % 5 AS INTEGER) AS folds_col
               FROM rest)
SELECT o.o_orderkey, CASE WHEN o.o_custkey IS NOT NULL AND r.o_custkey IS NULL THEN 'test' ELSE 'train' END AS split, r.folds_col
FROM ord o LEFT JOIN rest_folds r ON o.o_custkey = r.o_custkey""")
def spl03_nulls(spark, sf):
    """Four tenths of the groups are null: their rows stay train rows without a fold."""
    o = v.ord_(spark, sf).withColumn("o_custkey", F.when(F.col("o_custkey") % 10 >= 4, F.col("o_custkey")))
    return sp.best_fold_split(o, "o_custkey", "label").select("o_orderkey", "split", "folds_col")


@register("spl04_group_kfold", W("ev") + EV_FOLDS_SQL + """
SELECT e.event_id, f.folds_col FROM ev e JOIN ev_folds f ON e.user_id = f.user_id""")
def spl04(spark, sf):
    f = sp.group_kfold(v.ev(spark, sf), "user_id")
    return f.filter(F.col("folds_col").isNotNull()).select("event_id", "folds_col")


@register("spl05_group_holdout", W("ev") + HELD_SQL + """
SELECT event_id, coalesce(user_id IN (SELECT user_id FROM ev_held), false) AS held_out FROM ev""")
def spl05(spark, sf):
    return sp.group_holdout(v.ev(spark, sf), "user_id").select("event_id", "held_out")


@register("spl06_three_way_split", W("messages") + SPLIT3_SQL + """
SELECT m.message_id, s.split FROM messages m JOIN m_split s ON m.claim_id IS NOT DISTINCT FROM s.claim_id""")
def spl06(spark, sf):
    return sp.three_way_split(v.messages(spark, sf, claim=False, label=False), "claim_id").select("message_id", "split")


RECIPE_SQL = W("ev") + f""",
ev_in AS (SELECT * FROM ev WHERE created_utc < {CUTOFF}),
in_groups AS (SELECT DISTINCT user_id FROM ev_in WHERE user_id IS NOT NULL),
in_held AS (SELECT user_id FROM (
    SELECT user_id, row_number() OVER (ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) - 1 AS r,
           count(*) OVER () AS g FROM in_groups) WHERE r < (g * 2) // 10),
tr AS (SELECT * FROM ev_in WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM in_held)),
tr_sizes AS (SELECT user_id, count(*) AS n FROM tr WHERE user_id IS NOT NULL GROUP BY user_id),
tr_folds AS (SELECT user_id, CAST((row_number() OVER (ORDER BY n DESC, md5('42:' || CAST(user_id AS VARCHAR)),
                                                     user_id) - 1) % 5 AS INTEGER) AS folds_col FROM tr_sizes)
SELECT t.event_id, 'train' AS split, f.folds_col FROM tr t LEFT JOIN tr_folds f ON t.user_id = f.user_id
UNION ALL
SELECT event_id, 'test_in_time', CAST(NULL AS INTEGER) FROM ev_in WHERE user_id IN (SELECT user_id FROM in_held)
UNION ALL
SELECT event_id, 'test_out_of_time', CAST(NULL AS INTEGER) FROM ev WHERE created_utc >= {CUTOFF}"""


@register("spl07_time_group_recipe", RECIPE_SQL)
def spl07(spark, sf):
    r = sp.time_group_recipe(v.ev(spark, sf), "user_id", "created_utc", CUTOFF, ts_col="ts")
    return r.select("event_id", "split", "folds_col")


@register("spl08_fold_select", W("ev") + EV_FOLDS_SQL + """
SELECT e.event_id, CASE WHEN f.folds_col = 2 THEN 'validation' ELSE 'train' END AS role
FROM ev e JOIN ev_folds f ON e.user_id = f.user_id""")
def spl08(spark, sf):
    train, validation = sp.fold_split(sp.group_kfold(v.ev(spark, sf), "user_id"), 2)
    return (train.select("event_id", F.lit("train").alias("role"))
            .unionByName(validation.select("event_id", F.lit("validation").alias("role"))))


@register("spl08_fold_counts", W("ev") + EV_FOLDS_SQL + """
SELECT f.folds_col AS fold, CAST((SELECT sum(n) FROM ev_sizes) - count(*) AS BIGINT) AS n_train, count(*) AS n_validation
FROM ev e JOIN ev_folds f ON e.user_id = f.user_id GROUP BY f.folds_col""")
def spl08_counts(spark, sf):
    return sp.fold_counts(sp.group_kfold(v.ev(spark, sf), "user_id"))


@register("mth01_floor_fraction", W("ev") + """
SELECT user_id, count(*) AS n, (count(*) * 2) // 10 AS n_02, (count(*) * 6) // 10 AS n_06, count(*) // 5 AS n_div5
FROM ev GROUP BY user_id""")
def mth01(spark, sf):
    g = v.ev(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "n", floor_fraction("n", 2).alias("n_02"), floor_fraction("n", 6).alias("n_06"),
                    F.floor(F.col("n") / 5).cast("bigint").alias("n_div5"))


@register("mth02_abs_diff", W("ord") + ORD_FOLDS_SQL + """
SELECT fold, size, CAST(abs(size - (SELECT count(*) FROM ord) // 5) AS BIGINT) AS diff FROM ord_sizes""")
def mth02(spark, sf):
    from suasion.functions.numeric import abs_diff
    f = sp.stratified_group_kfold(v.ord_(spark, sf), "o_custkey", "label", 5, 42, "fold")
    sizes = f.groupBy("fold").agg(F.count(F.lit(1)).alias("size"))  # k rows, and one for null groups
    ideal = F.floor(F.sum("size").over(Window.partitionBy()) / 5)
    return (sizes.select("fold", "size", abs_diff("size", ideal).cast("bigint").alias("diff"))
            .filter(F.col("fold").isNotNull()))


@register("spl01_balanced_folds", W("ord").replace("WITH ", "WITH RECURSIVE ", 1) + """,
grp AS (SELECT o_custkey, count(*) AS n, sum(label)::BIGINT AS n1 FROM ord WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
cls AS (SELECT n, n1, count(*) AS c FROM grp GROUP BY n, n1),
tot AS (SELECT greatest(sum(n1 * c), 1)::HUGEINT AS p, greatest(sum((n - n1) * c), 1)::HUGEINT AS q FROM cls),
items AS (SELECT row_number() OVER (ORDER BY n DESC, n1 DESC, j) AS i, n, n1, c, j
          FROM cls, LATERAL (SELECT unnest(range(-1, c % 5)) AS j)),
walk(i, n, n1, j, neg, pos, used, f) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::HUGEINT[], [0, 0, 0, 0, 0]::HUGEINT[], []::INTEGER[], -1
  UNION ALL
  SELECT i, n, n1, j,
         CASE WHEN f < 0 THEN list_transform(neg, lambda x: x + (c // 5) * (n - n1)) ELSE list_transform(neg, lambda x, k: x + CASE WHEN k - 1 = f THEN n - n1 ELSE 0 END) END,
         CASE WHEN f < 0 THEN list_transform(pos, lambda x: x + (c // 5) * n1) ELSE list_transform(pos, lambda x, k: x + CASE WHEN k - 1 = f THEN n1 ELSE 0 END) END,
         CASE WHEN f < 0 THEN []::INTEGER[] ELSE list_append(used, f) END, f
  FROM (SELECT t.i, t.n, t.n1, t.c, t.j, w.neg, w.pos, w.used, CASE WHEN t.j < 0 THEN -1 ELSE
          list_min(list_transform(list_filter(range(5), lambda k: NOT list_contains(w.used, k::INTEGER)), lambda k:
            struct_pack(s := w.neg[k + 1] * (t.n - t.n1) * tot.p * tot.p + w.pos[k + 1] * t.n1 * tot.q * tot.q, m := w.neg[k + 1] + w.pos[k + 1], k := k::INTEGER))).k END AS f
        FROM walk w JOIN items t ON t.i = w.i + 1, tot)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, n1 ORDER BY md5('42:' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS r FROM grp),
folds AS (SELECT g.o_custkey, CASE WHEN r < c // 5 * 5 THEN (r % 5)::INTEGER ELSE w.f END AS fold
          FROM ranked g JOIN cls USING (n, n1) LEFT JOIN walk w ON w.n = g.n AND w.n1 = g.n1 AND w.j = g.r - c // 5 * 5 AND w.j >= 0 AND w.i > 0)
SELECT o.o_orderkey, folds.fold FROM ord o JOIN folds ON o.o_custkey = folds.o_custkey""")
def spl01_balanced(spark, sf):
    """Groups placed by the spread of the class counts: exact."""
    f = sp.balanced_group_kfold(v.ord_(spark, sf), "o_custkey", "label")
    return f.filter(F.col("o_custkey").isNotNull()).select("o_orderkey", "fold")
