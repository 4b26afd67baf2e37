"""Queries for EVL*, ENC*, TRN*, SCO01, SNK07."""

from __future__ import annotations

from pyspark.sql import functions as F

from suasion.functions.numeric import r6
from suasion.operators import encode as en
from suasion.operators import evaluate as ev_
from suasion.operators import train as tr
from suasion.operators.shape import vector_to_long
from suasion.operators.splits import group_kfold, three_way_split
from suasion.plans import views as v
from suasion.plans.q_relational import CE_SQL, LOGITS_SQL, logits
from suasion.plans.registry import register
from suasion.session import checkpointed, scratch_path

W = v.with_views
L = "WITH x AS (SELECT 1)" + LOGITS_SQL
PRED_SQL = "CASE WHEN e1 > e0 THEN 1 ELSE 0 END"
P1_SQL = "CASE WHEN e1 - e0 >= 0 THEN 1.0 / (1.0 + exp(-(e1 - e0))) ELSE exp(e1 - e0) / (1.0 + exp(e1 - e0)) END"


def _pred(spark, sf):
    return logits(spark, sf).withColumn("pred", ev_.argmax2("e0", "e1"))


@register("evl01_accuracy", L + f"""
SELECT batch_id, round(avg(CAST(({PRED_SQL}) = label AS DOUBLE)), 6) + 0.0 AS accuracy FROM logits GROUP BY batch_id""")
def evl01(spark, sf):
    a = ev_.accuracy(_pred(spark, sf), "label", "pred", ["batch_id"])
    return a.select("batch_id", r6("accuracy").alias("accuracy"))


@register("evl02_f1_macro", L + f""",
p AS (SELECT batch_id, label, {PRED_SQL} AS pred FROM logits),
c AS (SELECT batch_id, c FROM (SELECT batch_id, label AS c FROM p UNION SELECT batch_id, pred FROM p)),
k AS (SELECT c.batch_id, c.c,
             sum(CASE WHEN p.label = c.c AND p.pred = c.c THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN p.label <> c.c AND p.pred = c.c THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN p.label = c.c AND p.pred <> c.c THEN 1 ELSE 0 END) AS fn
      FROM c JOIN p ON c.batch_id = p.batch_id GROUP BY c.batch_id, c.c)
SELECT batch_id, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) + 0.0
       AS f1_macro FROM k GROUP BY batch_id""")
def evl02(spark, sf):
    f = ev_.macro_f1(_pred(spark, sf), "label", "pred", ["batch_id"])
    return f.select("batch_id", r6("f1_macro").alias("f1_macro"))


def _auc_sql(score: str, by: str | None) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f""",
per AS (SELECT {key}{score} AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p,
               sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS q FROM src GROUP BY {key}{score}),
r AS (SELECT {key}p, q, coalesce(sum(q) OVER ({part}ORDER BY score
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM per)
SELECT {key}round(CASE WHEN sum(p) = 0 OR sum(q) = 0 THEN 0.0
                       ELSE sum(p * (qb + q / 2.0)) / (sum(p) * sum(q)) END, 6) + 0.0 AS roc_auc FROM r {grp}"""


@register("evl03_roc_auc", W("scored") + ", src AS (SELECT * FROM scored)" + _auc_sql("score", None))
def evl03(spark, sf):
    a = ev_.roc_auc(v.scored(spark, sf), "label", "score")
    return a.select(r6("roc_auc").alias("roc_auc"))


@register("evl03_roc_auc_by_batch", W("scored") + ", src AS (SELECT * FROM scored)" + _auc_sql("score", "batch_id"))
def evl03b(spark, sf):
    a = ev_.roc_auc(v.scored(spark, sf), "label", "score", ["batch_id"])
    return a.select("batch_id", r6("roc_auc").alias("roc_auc"))


@register("evl03_null_keys", W("scored") + """, src AS (
  SELECT label, score, CASE WHEN batch_id % 3 = 0 THEN NULL ELSE batch_id END AS batch_id FROM scored)""" + _auc_sql("score", "batch_id"))
def evl03_nulls(spark, sf):
    """A null key is a group of its own."""
    s = v.scored(spark, sf).withColumn("batch_id", F.when(F.col("batch_id") % 3 != 0, F.col("batch_id")))
    return ev_.roc_auc(s, "label", "score", ["batch_id"]).select("batch_id", r6("roc_auc").alias("roc_auc"))


@register("evl04_most_frequent_class", W("scored") + """
SELECT batch_id, round(max(n) / sum(n), 6) + 0.0 AS mfc FROM (
  SELECT batch_id, label, count(*) AS n FROM scored GROUP BY batch_id, label) GROUP BY batch_id""")
def evl04(spark, sf):
    m = ev_.most_frequent_class(v.scored(spark, sf), "label", ["batch_id"])
    return m.select("batch_id", r6("mfc").alias("mfc"))


CE2_SQL = CE_SQL.replace("e0", "e2").replace("e1", "e3")


@register("evl05_paired_t", L + f""",
d AS (SELECT {CE_SQL} - {CE2_SQL} AS d FROM logits),
t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) AS n FROM d),
a AS (SELECT t, n, atan(abs(t) / sqrt(n - 1)) AS lo, least(pi() / 2, atan(abs(t) / sqrt(n - 1)) + 40 / sqrt(n - 1)) AS hi FROM t),
tail AS (SELECT any_value(t) AS t, any_value(n) AS n,
                sum(exp((n - 2) * ln(cos(lo + (hi - lo) * (k + 0.5) / 200000)))) * any_value((hi - lo) / 200000) AS s
         FROM a, (SELECT unnest(range(200000)) AS k))
SELECT round(t, 6) + 0.0 AS t_stat, n, round(s / (0.5 * sqrt(pi()) * exp(lgamma((n - 1) / 2.0) - lgamma(n / 2.0))), 6) + 0.0 AS p_value
FROM tail""")
def evl05(spark, sf):
    l = logits(spark, sf).select(ev_.cross_entropy2("e0", "e1", "label").alias("la"),
                                 ev_.cross_entropy2("e2", "e3", "label").alias("lb"))
    return ev_.paired_t(l, "la", "lb").select(r6("t_stat").alias("t_stat"), "n", r6("p_value").alias("p_value"))


@register("evl05_no_controls", "SELECT 0.0 AS t_stat, count(*) AS n, 1.0 AS p_value FROM embeddings")
def evl05_equal(spark, sf):
    """Both losses equal (no controls were given): t = 0, p = 1."""
    l = logits(spark, sf).select(ev_.cross_entropy2("e0", "e1", "label").alias("la"))
    return ev_.paired_t(l, "la", "la").select(r6("t_stat").alias("t_stat"), "n", r6("p_value").alias("p_value"))


@register("evl05_permutation", L + f""",
d AS (SELECT vec_id, batch_id % 3 AS part, {CE_SQL} - {CE2_SQL} AS d FROM logits),
s AS (SELECT part, f, sum(d * (1 - 2 * ((CAST('0x' || substr(md5('42:' || (f // 128) || ':' || vec_id), 1 + (f % 128) // 4, 1) AS INTEGER) >> (3 - f % 4)) & 1))) AS s
      FROM d, (SELECT unnest(range(200)) AS f) GROUP BY part, f),
t AS (SELECT part, avg(d) AS m, sum(d) AS t, sum(abs(d)) AS a, count(*) AS n FROM d GROUP BY part)
SELECT CAST(t.part AS INTEGER) AS part, round(any_value(m), 6) + 0.0 AS mean_difference, any_value(n) AS n,
       round((1 + count(*) FILTER (abs(s) >= abs(t) - a * 1e-12)) / 201.0, 6) + 0.0 AS p_value
FROM t JOIN s ON t.part = s.part GROUP BY t.part""")
def evl05_flips(spark, sf):
    """Sign-flip permutation p of two heads' losses, 200 flips in one aggregate: exact."""
    l = logits(spark, sf).select("vec_id", (F.col("batch_id") % 3).cast("int").alias("part"), ev_.cross_entropy2("e0", "e1", "label").alias("la"),
                                 ev_.cross_entropy2("e2", "e3", "label").alias("lb"))
    p = ev_.permutation_p(l, "la", "lb", "vec_id", ["part"], flips=200)
    return p.select("part", r6("mean_difference").alias("mean_difference"), "n", r6("p_value").alias("p_value"))


@register("evl05_against_controls")
def evl05_controls(spark, sf):
    """Out-of-fold losses of heads on text and controls (lengths of message and claim) against the controls alone."""
    m = v.messages(spark, sf).filter(F.col("persuaded").isNotNull() & F.col("claim").isNotNull())
    controls = [F.log1p(F.length(F.coalesce(c, F.lit("")))).cast("double") / 10 for c in ("message", "claim")]
    data = checkpointed(m.select("message_id", "persuaded", F.array(*controls).alias("controls"),
                                 F.concat(en.content_column("message", 32), F.array(*controls)).alias("features")))
    folds = group_kfold(data, "message_id", fold_col="folds_col")
    losses = None
    for name in ("features", "controls"):
        _, oof = tr.kfold_heads(folds, "folds_col", [tr.HeadSetting("run", lr=0.05, patience=0)], name, epochs=20, keep=["message_id"])
        one = oof.select("message_id", (-F.log(F.when(F.col("persuaded") == 1, F.col("p1")).otherwise(1 - F.col("p1")))).alias(name))
        losses = one if losses is None else losses.join(one, "message_id")
    return ev_.permutation_p(losses, "features", "controls", "message_id", flips=500)


@register("evl06_split_metrics", L + f""",
src AS (SELECT batch_id, label, {CE_SQL} AS loss, {PRED_SQL} AS pred, {P1_SQL} AS p1 FROM logits),
base AS (SELECT batch_id, round(avg(loss), 6) + 0.0 AS loss,
                round(avg(CAST(pred = label AS DOUBLE)), 6) + 0.0 AS accuracy FROM src GROUP BY batch_id),
auc AS (WITH x AS (SELECT 1) {_auc_sql("p1", "batch_id")})
SELECT base.batch_id, base.loss, base.accuracy, auc.roc_auc FROM base JOIN auc ON base.batch_id = auc.batch_id""")
def evl06(spark, sf):
    m = ev_.split_metrics(logits(spark, sf), "e0", "e1", "label", ["batch_id"])
    return m.select("batch_id", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"),
                    r6("roc_auc").alias("roc_auc"))


LOSS_TABLE_SQL = """,
losses AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY d) AS epoch, l AS loss
           FROM (SELECT user_id, created_utc // 86400 AS d, avg(value) AS l FROM ev
                 WHERE user_id IS NOT NULL AND created_utc IS NOT NULL GROUP BY user_id, created_utc // 86400)),
st(g, epoch, best, best_epoch, bad, stopped) AS (
  SELECT g, 0, CAST('inf' AS DOUBLE), 0, 0, false FROM (SELECT DISTINCT g FROM losses)
  UNION ALL
  SELECT s.g, l.epoch,
         CASE WHEN l.loss + 0.002 < s.best THEN l.loss ELSE s.best END,
         CASE WHEN l.loss + 0.002 < s.best THEN l.epoch ELSE s.best_epoch END,
         CASE WHEN l.loss + 0.002 < s.best THEN 0 ELSE s.bad + 1 END,
         (CASE WHEN l.loss + 0.002 < s.best THEN 0 ELSE s.bad + 1 END) >= 3
  FROM st s JOIN losses l ON l.g = s.g AND l.epoch = s.epoch + 1 WHERE NOT s.stopped)
SELECT g AS user_id, CAST(arg_max(best_epoch, epoch) AS INTEGER) AS best_epoch,
       round(arg_max(best, epoch), 6) + 0.0 AS best_loss, CAST(max(epoch) AS INTEGER) AS stop_epoch,
       bool_or(stopped) AS stopped_early
FROM st WHERE epoch > 0 GROUP BY g"""


@register("trn02_early_stopping", W("ev").replace("WITH ", "WITH RECURSIVE ", 1) + LOSS_TABLE_SQL)
def trn02(spark, sf):
    from pyspark.sql import Window
    e = v.ev(spark, sf).filter(F.col("user_id").isNotNull() & F.col("created_utc").isNotNull())
    daily = e.groupBy("user_id", F.floor(F.col("created_utc") / 86400).alias("d")).agg(F.avg("value").alias("l"))
    # one row per (user, day): a user's window holds at most its number of days
    w = Window.partitionBy("user_id").orderBy("d")
    losses = daily.select("user_id", F.row_number().over(w).alias("epoch"), F.col("l").alias("eval_loss"))
    s = tr.early_stopping(losses, "user_id", "epoch", "eval_loss", patience=3, min_delta=0.002)
    return s.select("user_id", "best_epoch", r6("best_loss").alias("best_loss"), "stop_epoch", "stopped_early")


# ---- property-checked (P) queries ------------------------------------------------------
def _emb_split(spark, sf):
    return three_way_split(v.emb_cls(spark, sf), "group_id")


@register("trn01_linear_head")
def trn01(spark, sf):
    """Spark ML logistic head fit on the train split, scored on every row."""
    d = _emb_split(spark, sf)
    m = tr.fit(d.filter(F.col("split") == "train"), "features", "persuaded", "lr", reg_param=0.0)
    return tr.score(m, d, "features", ["group_id", "split", "persuaded"])


@register("trn03_kfold_lr")
def trn03(spark, sf):
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    return tr.kfold_scores(f, "folds_col", model="lr", keep=["group_id", "folds_col", "persuaded"])


@register("trn04_kfold_forest")
def trn04_forest(spark, sf):
    """The random forest that Spark has, under its own name."""
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    return tr.kfold_scores(f, "folds_col", model="rf", keep=["group_id", "folds_col", "persuaded"])


@register("trn04_kfold_extra_trees")
def trn04(spark, sf):
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    return tr.kfold_scores(f, "folds_col", model="etc", keep=["group_id", "folds_col", "persuaded"])


def _mix_sql(x: str) -> str:
    """extra_trees.mix of an unsigned 64-bit expression."""
    def times(z: str, by: int) -> str:
        return f"CAST((CAST({z} AS UHUGEINT) * {by}) % 18446744073709551616 AS UBIGINT)"
    start = f"[CAST((CAST({x} AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS UBIGINT)]"
    one = f"list_transform({start}, lambda z: {times('xor(z, z >> 30)', 13787848793156543929)})"
    two = f"list_transform({one}, lambda z: {times('xor(z, z >> 27)', 10723151780598845931)})"
    return f"list_transform({two}, lambda z: xor(z, z >> 31))[1]"


def _one_level_sql() -> str:
    key = _mix_sql(f"xor({_mix_sql(f'xor({_mix_sql("42::UBIGINT")}, 0::UBIGINT)')}, 1::UBIGINT)")

    def impure(n: str, p: str) -> str:
        return f"(2 * {p} * ({n} - {p}) / greatest({n}, 1))"
    return v.with_views("emb_cls") + f""",
k AS (SELECT {key} AS k),
drawn AS (SELECT f, ({_mix_sql(f"xor({_mix_sql('k')}, f::UBIGINT)")} >> 11) * power(2.0, -53) AS u, {_mix_sql(f"xor(k, {_mix_sql('f::UBIGINT')})")} AS place
          FROM k, (SELECT unnest(range((SELECT max(len(embedding)) FROM emb_cls))) AS f)),
x AS (SELECT group_id, persuaded AS y, f, CAST(embedding[f + 1] AS DOUBLE) AS x FROM emb_cls, (SELECT f FROM drawn)),
r AS (SELECT f, min(x) AS lo, max(x) AS hi FROM x GROUP BY f),
t AS (SELECT f, place, lo, hi, CASE WHEN lo + u * (hi - lo) >= hi THEN lo ELSE lo + u * (hi - lo) END AS t FROM r JOIN drawn USING (f)),
c AS (SELECT f, place, t, lo, hi, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, (count(*) FILTER (x > t))::DOUBLE AS nr, coalesce(sum(y) FILTER (x > t), 0)::DOUBLE AS pr
      FROM x JOIN t USING (f) GROUP BY f, place, t, lo, hi),
best AS (SELECT * FROM c WHERE lo < hi AND nr >= greatest(1, ceil(0.001 * n)) AND n - nr >= greatest(1, ceil(0.001 * n))
         ORDER BY {impure('n', 'p')} - {impure('(n - nr)', '(p - pr)')} - {impure('nr', 'pr')} DESC, place LIMIT 1),
s AS (SELECT group_id, CASE WHEN x > t THEN pr / nr ELSE (p - pr) / (n - nr) END AS p1 FROM x JOIN best USING (f))
SELECT group_id, round(p1, 6) + 0.0 AS p1, CAST(p1 > 0.5 AS INTEGER) AS pred FROM s"""


@register("trn04_one_level", _one_level_sql())
def trn04_one_level(spark, sf):
    """One tree of one level that draws a threshold of every feature: exact."""
    from suasion.operators import extra_trees
    e = v.emb_cls(spark, sf)
    width = e.select(F.max(F.size("features"))).first()[0]
    forest = extra_trees.fit(e, trees=1, max_features=width, max_depth=1)
    return extra_trees.score(forest, e, keep=["group_id"]).select("group_id", r6("p1").alias("p1"), "pred")


@register("trn05_l2_search")
def trn05(spark, sf):
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    return tr.l2_search(f, "folds_col", [0.0, 0.01, 0.1, 1.0])


@register("trn01_first_epoch", v.with_views("emb_cls") + """,
g AS (SELECT DISTINCT group_id FROM emb_cls),
sp AS (SELECT group_id, CASE WHEN r < (n * 6) // 10 THEN 'train' WHEN r < (n * 6) // 10 + (n * 2) // 10 THEN 'validation' ELSE 'test' END AS split
       FROM (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) - 1 AS r, count(*) OVER () AS n FROM g)),
x AS (SELECT e.group_id, persuaded AS y, split, i, CAST(embedding[i + 1] AS DOUBLE) AS x
      FROM emb_cls e JOIN sp ON e.group_id = sp.group_id, LATERAL (SELECT unnest(range(len(embedding))) AS i)
      UNION ALL SELECT e.group_id, persuaded, split, -1, 1.0 FROM emb_cls e JOIN sp ON e.group_id = sp.group_id),
w AS (SELECT i, -0.01 * g / (abs(g) + 1e-8) AS w FROM (SELECT i, avg((0.5 - y) * x) AS g FROM x WHERE split = 'train' GROUP BY i)),
z AS (SELECT group_id, y, split, sum(w * x) AS h FROM x JOIN w ON x.i = w.i GROUP BY group_id, y, split)
SELECT 'run' AS run_id, 1 AS epoch, round(ln(2), 6) AS train_loss, round(avg(1 - y) FILTER (split = 'train'), 6) + 0.0 AS train_acc,
       round(avg(ln(1 + exp(CASE WHEN y = 1 THEN -2 * h ELSE 2 * h END))) FILTER (split = 'validation'), 6) + 0.0 AS eval_loss,
       round(avg(CAST((h > 0) = (y = 1) AS DOUBLE)) FILTER (split = 'validation'), 6) + 0.0 AS eval_acc FROM z""")
def trn01_epoch(spark, sf):
    """One Adam epoch from a zero start, its losses and accuracies: exact."""
    metrics, _ = tr.train_heads(_emb_split(spark, sf), [tr.HeadSetting("run", lr=0.01)], epochs=1)
    return metrics.select("run_id", "epoch", *[r6(c).alias(c) for c in ("train_loss", "train_acc", "eval_loss", "eval_acc")])


@register("trn01_two_batches", v.with_views("emb_cls") + """,
g AS (SELECT DISTINCT group_id FROM emb_cls),
sp AS (SELECT group_id, CASE WHEN r < (n * 6) // 10 THEN 'train' WHEN r < (n * 6) // 10 + (n * 2) // 10 THEN 'validation' ELSE 'test' END AS split
       FROM (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) - 1 AS r, count(*) OVER () AS n FROM g)),
b AS (SELECT group_id, CASE WHEN 2 * row_number() OVER (ORDER BY md5('42:1:' || group_id), group_id) <= n + n % 2 THEN 1 ELSE 2 END AS b
      FROM (SELECT group_id, count(*) OVER () AS n FROM sp WHERE split = 'train')),
e AS (SELECT emb_cls.group_id, persuaded AS y, embedding, split, b FROM emb_cls JOIN sp USING (group_id) LEFT JOIN b USING (group_id)),
x AS (SELECT group_id, y, split, b, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM e, LATERAL (SELECT unnest(range(len(embedding))) AS i)
      UNION ALL SELECT group_id, y, split, b, -1, 1.0 FROM e),
one AS (SELECT i, g AS g1, -0.01 * g / (abs(g) + 1e-8) AS w FROM (SELECT i, avg((0.5 - y) * x) AS g FROM x WHERE b = 1 GROUP BY i)),
h1 AS (SELECT group_id, y, sum(w * x) AS h FROM x JOIN one USING (i) WHERE b = 2 GROUP BY group_id, y),
g2 AS (SELECT x.i, avg((1 / (1 + exp(-2 * h)) - x.y) * x) AS g2 FROM x JOIN h1 USING (group_id) GROUP BY x.i),
two AS (SELECT i, w - 0.01 * ((0.9 * 0.1 * g1 + 0.1 * g2) / (1 - 0.81))
               / (sqrt((0.999 * 0.001 * g1 * g1 + 0.001 * g2 * g2) / (1 - 0.999 * 0.999)) + 1e-8) AS w FROM one JOIN g2 USING (i)),
z AS (SELECT group_id, y, sum(w * x) AS h FROM x JOIN two USING (i) WHERE split = 'validation' GROUP BY group_id, y),
tr AS (SELECT ln(2) AS loss, 1 - y AS hit FROM e WHERE b = 1
       UNION ALL SELECT ln(1 + exp(CASE WHEN y = 1 THEN -2 * h ELSE 2 * h END)), CAST((h > 0) = (y = 1) AS INTEGER) FROM h1)
SELECT 'run' AS run_id, 1 AS epoch, (SELECT round(avg(loss), 6) + 0.0 FROM tr) AS train_loss, (SELECT round(avg(hit), 6) + 0.0 FROM tr) AS train_acc,
       round(avg(ln(1 + exp(CASE WHEN y = 1 THEN -2 * h ELSE 2 * h END))), 6) + 0.0 AS eval_loss,
       round(avg(CAST((h > 0) = (y = 1) AS DOUBLE)), 6) + 0.0 AS eval_acc FROM z""")
def trn01_batches(spark, sf):
    """One epoch of two seeded mini-batches, two Adam steps: exact."""
    d = _emb_split(spark, sf)
    half = -(-d.filter(F.col("split") == "train").count() // 2)
    metrics, _ = tr.train_heads(d, [tr.HeadSetting("run", lr=0.01, batch_size=half)], epochs=1, id_col="group_id")
    return metrics.select("run_id", "epoch", *[r6(c).alias(c) for c in ("train_loss", "train_acc", "eval_loss", "eval_acc")])


@register("trn01_minibatch_heads")
def trn01_minibatch(spark, sf):
    """Batches of 64 and of 16 rows, each with its own seed, trained together; every epoch's losses."""
    settings = [tr.HeadSetting(f"b{b}", lr=0.005, weight_decay=0.001, batch_size=b, seed=b, patience=0) for b in (64, 16)]
    metrics, _ = tr.train_heads(_emb_split(spark, sf), settings, epochs=10, id_col="group_id")
    return metrics


@register("trn03_first_epoch_heads", v.with_views("emb_cls") + """,
g AS (SELECT group_id, count(*) AS n FROM emb_cls GROUP BY group_id),
f AS (SELECT group_id, CAST((row_number() OVER (ORDER BY n DESC, md5('42:' || group_id), group_id) - 1) % 5 AS INTEGER) AS fold FROM g),
x AS (SELECT e.group_id, persuaded AS y, fold, i, CAST(embedding[i + 1] AS DOUBLE) AS x
      FROM emb_cls e JOIN f ON e.group_id = f.group_id, LATERAL (SELECT unnest(range(len(embedding))) AS i)
      UNION ALL SELECT e.group_id, persuaded, fold, -1, 1.0 FROM emb_cls e JOIN f ON e.group_id = f.group_id),
w AS (SELECT k, i, -0.05 * g / (abs(g) + 1e-8) AS w
      FROM (SELECT k, i, avg((0.5 - y) * x) AS g FROM x, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k, i))
SELECT group_id, fold AS folds_col, round(1 / (1 + exp(-2 * sum(w * x))), 6) + 0.0 AS p1
FROM x JOIN w ON x.i = w.i AND x.fold = w.k GROUP BY group_id, fold""")
def trn03_epoch(spark, sf):
    """Out-of-fold scores of five heads after one epoch: exact."""
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    _, oof = tr.kfold_heads(f, "folds_col", [tr.HeadSetting("run", lr=0.05, patience=0)], epochs=1, keep=["group_id"], use_best=False)
    return oof.select("group_id", "folds_col", r6("p1").alias("p1"))


@register("enc01_encode")
def enc01(spark, sf):
    """Content and style encodings of messages, as one long feature table."""
    m = v.messages(spark, sf, claim=False, label=False)
    c = vector_to_long(en.encode(m, "message", "message_id", "content", 64).withColumnRenamed("message_id", "group_id"),
                       prefix="content_")
    s = vector_to_long(en.encode(m, "message", "message_id", "style", 64).withColumnRenamed("message_id", "group_id"),
                       prefix="style_")
    return c.unionByName(s)


@register("enc01_style_exact", W("messages") + """,
c AS (SELECT message_id, list_transform(range(1, length(message) + 1), lambda i: unicode(lower(message)[i])) AS c, message
      FROM messages WHERE message IS NOT NULL),
b AS (SELECT message_id, (c[i] * 1000003 + c[i + 1] * 10007 + c[i + 2]) % 62 AS b, count(*) AS n
      FROM c, LATERAL (SELECT unnest(range(1, len(c.c) - 1)) AS i) GROUP BY 1, 2),
z AS (SELECT message_id, sqrt(sum(n * n)) AS z FROM b GROUP BY 1),
grid AS (SELECT m.message_id, i FROM messages m, (SELECT unnest(range(62)) AS i))
SELECT grid.message_id AS group_id, printf('style_%03d', grid.i) AS feat, round(coalesce(b.n / z.z, 0.0), 6) + 0.0 AS value
FROM grid LEFT JOIN b ON b.message_id = grid.message_id AND b.b = grid.i LEFT JOIN z ON z.message_id = grid.message_id
UNION ALL
SELECT message_id, 'style_062', round(coalesce(length(regexp_replace(message, '[^[:punct:]]', '', 'g')) / greatest(length(message), 1), 0.0), 6) + 0.0 FROM messages
UNION ALL
SELECT message_id, 'style_063', round(coalesce(length(regexp_replace(message, '[ \\t\\n\\r\\f\\x0B]+', '', 'g'))
       / greatest(len(regexp_extract_all(message, '[^ \\t\\n\\r\\f\\x0B]+')), 1) / 10.0, 0.0), 6) + 0.0 FROM messages""")
def enc01_style(spark, sf):
    """ENC01 style encoder: code-point 3-grams, punctuation rate, mean word length."""
    m = v.messages(spark, sf, claim=False, label=False)
    vec = en.encode(m, "message", "message_id", "style", 64)
    long = vector_to_long(vec.withColumnRenamed("message_id", "group_id"), prefix="style_")
    return long.select("group_id", "feat", r6("value").alias("value"))


@register("enc02_sentence_embeddings")
def enc02(spark, sf):
    _, msg = en.sentence_vectors(v.messages(spark, sf, claim=False, label=False), "message", "message_id", "content", 64)
    return vector_to_long(msg.withColumnRenamed("message_id", "group_id"))


@register("sco01_score_sentences")
def sco01(spark, sf):
    """Message-level model (fitted on the labelled messages), saved and loaded, scoring every sentence
    of every message → feature table."""
    from pyspark.ml.classification import LogisticRegressionModel
    m = v.messages(spark, sf, claim=False)
    data = en.encode(m, "message", ["message_id", "persuaded"], "content", 64)
    model = tr.fit(data, "features", "persuaded", "lr", 0.01)
    path = scratch_path(spark, "sco01-model")
    model.write().overwrite().save(path)
    loaded = LogisticRegressionModel.load(path)
    sv, _ = en.sentence_vectors(m, "message", "message_id", "content", 64)
    scored = tr.score(loaded, sv, "features", ["sent_id"])
    return tr.predictions_to_features(scored, "sent_id")


@register("snk07_model_roundtrip")
def snk07(spark, sf):
    """Weights of the best and of the last epoch saved as Parquet rows and loaded back; all score every row."""
    d = _emb_split(spark, sf)
    _, final = tr.train_heads(d, [tr.HeadSetting("r0", lr=0.01, weight_decay=0.0)], epochs=5)
    out = None
    for which in ("best", "last"):
        theta, path = final["r0"][f"{which}_theta"], scratch_path(spark, f"snk07-head-{which}")
        tr.save_head(spark, theta, final["r0"][f"{which}_epoch"], path)
        loaded, _ = tr.load_head(spark, path)
        both = tr.head_scores(d, theta).withColumnRenamed("p1", "p_before").drop("pred")
        part = tr.head_scores(both, loaded).select("group_id", F.lit(which).alias("epoch_kind"), "p_before", F.col("p1").alias("p_after"))
        out = part if out is None else out.unionByName(part)
    return out


@register("enc02_vector_average", """
SELECT label, CAST(i AS INTEGER) AS idx, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) + 0.0 AS value
FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i) GROUP BY label, i""")
def enc02_avg(spark, sf):
    """The averaging step of ENC02: element-wise mean vector per group (here per label)."""
    e = v.vectors(spark, sf)
    avg = en.average_vectors(e, "label", "features")
    return avg.select("label", F.posexplode("features").alias("idx", "value")).select(
        "label", F.col("idx").cast("int").alias("idx"), r6("value").alias("value"))


def _claim_factors(spark, sf, n: int = 3):
    """Labelled messages with the PCA factors of their claim's text: (message_id, claim_id, claim, message, y, z0…)."""
    from suasion.operators import features as fe
    from suasion.operators.skew import key_join
    m = v.messages(spark, sf).filter(F.col("persuaded").isNotNull() & F.col("claim").isNotNull())
    claims = m.groupBy("claim_id").agg(F.first("claim").alias("claim"))
    cv = en.encode(claims, "claim", "claim_id", "content", 32)
    long = vector_to_long(cv.withColumnRenamed("claim_id", "group_id"))
    names = [f"dim_feat_{i:03d}" for i in range(n)]
    wide = fe.pca_reduce(long, n).groupBy("group_id").pivot("feat", names).agg(F.first("value"))
    wide = wide.select(F.col("group_id").alias("claim_id"), *[F.col(c).alias(f"z{i}") for i, c in enumerate(names)])
    return key_join(m.select("message_id", "claim_id", "message", F.col("persuaded").cast("double").alias("y")), wide, "claim_id", "inner")


@register("fea06_rfa_residual")
def fea06_residual(spark, sf):
    """P: outcome regressed on 3 PCA factors of the claim text; residual per message."""
    from suasion.operators import features as fe
    r = fe.residualize(_claim_factors(spark, sf), "y", ["z0", "z1", "z2"])
    return r.select("message_id", "claim_id", "y", "residual")


@register("fea06_rfa_kfold")
def fea06_kfold(spark, sf):
    """P: per fold, factors of the claims, residual on {features, features × factors}, step 1 + step 2."""
    from suasion.operators import features as fe
    d = group_kfold(_claim_factors(spark, sf), "claim_id", fold_col="folds_col")
    d = d.withColumn("features", en.content_column("message", 32))
    return fe.rfa_kfold(d, "y", ["z0", "z1", "z2"], "features", "folds_col", keep=["message_id"])


@register("fea06_rfa_one_factor", """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS group_id, vec_id % 5 AS k, CAST(label >= 5 AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS z,
                  CAST(embedding[2] AS DOUBLE) AS x FROM embeddings),
one AS (SELECT f.f, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM e, (SELECT DISTINCT k AS f FROM e) f WHERE e.k <> f.f GROUP BY f.f),
r AS (SELECT one.f, e.x, e.x * e.z AS xz, e.y - (a + b * e.z) AS r FROM e JOIN one ON e.k <> one.f),
c AS (SELECT f, avg(x) AS mx, avg(xz) AS mxz, avg(r) AS mr, stddev_pop(x) AS sx, stddev_pop(xz) AS sxz, covar_pop(x, xz) AS cc,
             covar_pop(x, r) AS cx, covar_pop(xz, r) AS cxz FROM r GROUP BY f),
w AS (SELECT *, (cx / sx * 1.5 - cc / (sx * sxz) * cxz / sxz) / (1.5 * 1.5 - (cc / (sx * sxz)) ** 2) / sx AS bx,
             (1.5 * cxz / sxz - cc / (sx * sxz) * cx / sx) / (1.5 * 1.5 - (cc / (sx * sxz)) ** 2) / sxz AS bxz FROM c)
SELECT group_id, CAST(e.k AS INTEGER) AS fold, round(one.a + one.b * z, 6) + 0.0 AS step1,
       round(mr - bx * mx - bxz * mxz + bx * x + bxz * x * z, 6) + 0.0 AS step2
FROM e JOIN one ON e.k = one.f JOIN w ON w.f = e.k""")
def fea06_one_factor(spark, sf):
    """One factor, one feature and their product, ridge of 0.5: both steps out of fold, exact."""
    from suasion.operators import features as fe
    e = v.emb_cls(spark, sf).select("group_id", F.col("persuaded").cast("double").alias("y"), F.col("features")[0].alias("z"),
                                    F.array(F.col("features")[1]).alias("features"), (F.col("group_id").cast("long") % 5).cast("int").alias("fold"))
    out = fe.rfa_kfold(e, "y", ["z"], "features", "fold", reg_param=0.5, keep=["group_id"])
    return out.select("group_id", "fold", r6("step1").alias("step1"), r6("step2").alias("step2"))


@register("fea06_ridge_slope", """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS group_id, vec_id % 5 AS k, CAST(label AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings),
p AS (SELECT unnest([0.0, 0.1, 1.0, 10.0]) AS penalty),
w AS (SELECT f.f, p.penalty, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) / var_pop(x) / (1 + p.penalty) AS b
      FROM e, (SELECT DISTINCT k AS f FROM e) f, p WHERE e.k <> f.f GROUP BY f.f, p.penalty)
SELECT group_id, CAST(e.k AS INTEGER) AS fold, CAST(penalty AS DOUBLE) AS penalty, round(my + b * (x - mx), 6) + 0.0 AS prediction
FROM e JOIN w ON w.f = e.k""")
def fea06_ridge(spark, sf):
    """Ridge of one feature for four penalties and five folds from one pass of moments: exact."""
    from suasion.operators import newton
    e = v.vectors(spark, sf).select("group_id", F.col("label").cast("double").alias("y"), F.array(F.col("features")[0]).alias("features"),
                                    (F.col("group_id").cast("long") % 5).cast("int").alias("fold"))
    out = newton.ridge_kfold(e, "y", "features", "fold", [0.0, 0.1, 1.0, 10.0], keep=["group_id"])
    return out.select("group_id", "fold", "penalty", r6("prediction").alias("prediction"))


@register("trn05_gradients", """
SELECT CAST(p AS DOUBLE) AS reg_param, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS left_out, 0.0 AS gradient
FROM (SELECT unnest([0.0, 0.01, 0.1, 1.0]) AS p), (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE a <= b""")
def trn05_gradients(spark, sf):
    """The nested search's fits: the gradient's largest entry at every optimum is 0 to six places."""
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    _, _, penalties, left_out, _, gradients, _ = tr.nested_fits(f, "folds_col", [0.0, 0.01, 0.1, 1.0])
    rows = [(float(p), ",".join(map(str, left)), float(abs(g).max())) for p, left, g in zip(penalties, left_out, gradients, strict=True)]
    found = spark.createDataFrame(rows, "reg_param double, left_out string, gradient double")  # one row per fit
    return found.select("reg_param", "left_out", r6("gradient").alias("gradient"))


@register("fea06_step_one_exact", """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS group_id, CAST(label >= 5 AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS z FROM embeddings),
r AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM e)
SELECT e.group_id, round(e.y - (r.a + r.b * e.z), 6) + 0.0 AS residual FROM e, r""")
def fea06_step_one(spark, sf):
    """The least-squares step with one factor: exact."""
    from suasion.operators import features as fe
    e = v.emb_cls(spark, sf).select("group_id", F.col("persuaded").cast("double").alias("y"), F.col("features")[0].alias("z"))
    return fe.residualize(e, "y", ["z"]).select("group_id", r6("residual").alias("residual"))


@register("trn03_kfold_heads")
def trn03_heads(spark, sf):
    """P: k folds × 2 settings trained together (one gradient pass per epoch for all ten
    heads); out-of-fold scores per setting."""
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    settings = [tr.HeadSetting("wd0", lr=0.05, weight_decay=0.0, patience=3),
                tr.HeadSetting("wd01", lr=0.05, weight_decay=0.01, patience=3)]
    _, oof = tr.kfold_heads(f, "folds_col", settings, epochs=15, keep=["group_id"])
    return oof


@register("trn05_l2_search_heads")
def trn05_heads(spark, sf):
    """P: L2 search with all strengths × folds in one training loop."""
    f = group_kfold(v.emb_cls(spark, sf), "group_id", fold_col="folds_col")
    return tr.l2_search_heads(f, "folds_col", [0.0, 0.001, 0.01, 0.1])


def _content_sql() -> str:
    from suasion.plans.q_relational import SQL_STRIP
    from suasion.plans.q_shape import sql_tokens
    toks = (f"list_filter(list_transform({sql_tokens('lower(message)')}, "
            f"lambda w: regexp_replace(w, {SQL_STRIP}, '', 'g')), lambda w: w <> '')")
    return W("messages") + f""",
toks AS (SELECT message_id AS group_id, unnest({toks}) AS t FROM messages WHERE message IS NOT NULL),
b AS (SELECT group_id, CAST(CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % 64 AS INTEGER) AS bucket,
             CAST(count(*) AS DOUBLE) AS n FROM toks GROUP BY 1, 2),
nrm AS (SELECT group_id, sqrt(sum(n * n)) AS z FROM b GROUP BY 1),
grid AS (SELECT g.message_id AS group_id, i FROM (SELECT DISTINCT message_id FROM messages) g,
         (SELECT unnest(range(64)) AS i))
SELECT grid.group_id, printf('content_%03d', grid.i) AS feat,
       round(CASE WHEN nrm.z > 0 THEN coalesce(b.n, 0.0) / nrm.z ELSE 0.0 END, 6) + 0.0 AS value
FROM grid LEFT JOIN b ON b.group_id = grid.group_id AND b.bucket = grid.i
LEFT JOIN nrm ON nrm.group_id = grid.group_id"""


@register("enc01_content_exact", _content_sql())
def enc01_exact(spark, sf):
    """ENC01 content encoder with md5 buckets, so the whole encoding job is checked exactly."""
    m = v.messages(spark, sf, claim=False, label=False)
    vec = en.encode(m, "message", "message_id", "content", 64, hashing="md5")
    long = vector_to_long(vec.withColumnRenamed("message_id", "group_id"), prefix="content_")
    return long.select("group_id", "feat", r6("value").alias("value"))
