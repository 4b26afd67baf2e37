"""Queries for FLT*, JON*, AGG*, SRT*."""

from __future__ import annotations

from pyspark.sql import functions as F

from suasion.functions.numeric import r6, utc_cutoff
from suasion.functions.text import word_count
from suasion.operators import evaluate as ev_
from suasion.operators import features as fe
from suasion.operators import relational as rel
from suasion.operators import shape as sh
from suasion.operators import splits as sp
from suasion.operators.numbering import global_index
from suasion.plans import views as v
from suasion.plans.q_shape import sql_tokens
from suasion.plans.registry import register
from suasion.sources.tables import table

W = v.with_views
CUTOFF = utc_cutoff(2024, 1, 24)

# The SQL forms of word count and 1-gram tokens.
SQL_STRIP = "'^[[:punct:]]+|[[:punct:]]+$'"


def sql_words(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE len({sql_tokens(x)}) END"


def sql_ngrams_cte(src: str = "messages", text: str = "message", gid: str = "message_id") -> str:
    return f""",
toks AS (SELECT {gid} AS group_id, t AS feat FROM (
           SELECT {gid}, unnest(list_filter(list_transform({sql_tokens(f"lower({text})")},
                  lambda w: regexp_replace(w, {SQL_STRIP}, '', 'g')), lambda w: w <> '')) AS t FROM {src})),
ngram_counts AS (SELECT group_id, feat, count(*) AS n FROM toks GROUP BY group_id, feat),
ngram_tot AS (SELECT group_id, sum(n) AS tot FROM ngram_counts GROUP BY group_id),
ngrams AS (SELECT c.group_id, c.feat, CAST(c.n AS DOUBLE) AS value, c.n / t.tot AS group_norm
           FROM ngram_counts c JOIN ngram_tot t ON c.group_id = t.group_id)"""


HELD_SQL = f""",
ev_groups AS (SELECT DISTINCT user_id FROM ev WHERE user_id IS NOT NULL),
ev_held AS (SELECT user_id FROM (
    SELECT user_id, row_number() OVER (ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) - 1 AS r,
           count(*) OVER () AS g FROM ev_groups) WHERE r < (g * 2) // 10)"""


@register("flt01_time_cut", W("ev") + f"""
SELECT event_id, user_id, created_utc, CASE WHEN created_utc >= {CUTOFF} THEN 'out_of_time' ELSE 'in_time' END AS side
FROM ev WHERE created_utc IS NOT NULL""")
def flt01(spark, sf):
    inside, outside = rel.time_cut(v.ev(spark, sf), CUTOFF, "created_utc", ts_col="ts")
    cols = ["event_id", "user_id", "created_utc"]
    return (inside.select(*cols, F.lit("in_time").alias("side"))
            .unionByName(outside.select(*cols, F.lit("out_of_time").alias("side"))))


@register("flt04_equality_lookup", W("messages") + "SELECT message_id, claim_id FROM messages WHERE persuaded = 0")
def flt04(spark, sf):
    return rel.equals(v.messages(spark, sf, claim=False), "persuaded", 0).select("message_id", "claim_id")


@register("flt05_word_predicate", W("messages") + f"""
SELECT message_id, {sql_words("message")} AS n_words FROM messages WHERE {sql_words("message")} < 50""")
def flt05(spark, sf):
    return rel.short_texts(v.messages(spark, sf, claim=False, label=False), "message", 50).select(
        "message_id", word_count("message").alias("n_words"))


@register("flt06_group_threshold", W("messages") + sql_ngrams_cte() + """
SELECT message_id FROM messages WHERE message_id IN (
  SELECT group_id FROM ngrams GROUP BY group_id HAVING sum(value) >= 100)""")
def flt06(spark, sf):
    # per-row token count equals the group's 1-gram total (see rel.keep_frequent_groups)
    return rel.keep_min_tokens(v.messages(spark, sf, claim=False, label=False), 100, "message").select("message_id")


@register("flt06_group_sums", W("messages") + sql_ngrams_cte(gid="claim_id") + """
SELECT message_id FROM messages WHERE claim_id IN (
  SELECT group_id FROM ngrams GROUP BY group_id HAVING sum(value) >= 3000)""")
def flt06_groups(spark, sf):
    """Groups of several messages: totals from the 1-gram table, messages kept by a semi join."""
    m = v.messages(spark, sf, claim=False, label=False)
    grams = rel.ngram_counts(m, "message", "claim_id")
    return rel.keep_frequent_groups(m, grams, 3000, "group_id", "claim_id").select("message_id")


@register("agg08_ngram_counts_by_claim", W("messages") + sql_ngrams_cte(gid="claim_id") + """
SELECT group_id, feat, value, round(group_norm, 6) + 0.0 AS group_norm FROM ngrams""")
def agg08_claims(spark, sf):
    """Groups of several messages: counts and totals add up over the group's rows."""
    g = rel.ngram_counts(v.messages(spark, sf, claim=False, label=False), "message", "claim_id")
    return g.select("group_id", "feat", "value", r6("group_norm").alias("group_norm"))


@register("jon01_stats_join", W("feat", "feat_holes") + """,
stats AS (SELECT feat, avg(value) AS mean, stddev_pop(value) AS stddev FROM feat GROUP BY feat)
SELECT t.group_id, t.feat, round((t.value - s.mean) / NULLIF(s.stddev, 0), 6) + 0.0 AS value
FROM feat_holes t JOIN stats s ON t.feat = s.feat""")
def jon01(spark, sf):
    z = fe.apply_zscore(v.feat_holes(spark, sf), fe.feature_stats(v.feat(spark, sf)))
    return z.select("group_id", "feat", r6("value").alias("value"))


@register("jon02_id_lookup", W("pairs") + """,
d AS (SELECT DISTINCT claim_body FROM pairs),
ids AS (SELECT claim_body, 'p' || lpad(CAST(row_number() OVER (ORDER BY claim_body NULLS FIRST) - 1 AS VARCHAR),
                                       CAST(length(CAST((SELECT count(*) FROM d) AS VARCHAR)) AS INTEGER), '0') AS prompt_id FROM d)
SELECT p.claim_id, ids.prompt_id FROM pairs p LEFT JOIN ids ON p.claim_body IS NOT DISTINCT FROM ids.claim_body""")
def jon02(spark, sf):
    p = sh.add_prompt_ids(v.pairs(spark, sf), prompt="claim_body", id_col="prompt_id")
    return p.select("claim_id", "prompt_id")


@register("jon03_semi_join", W("ev") + HELD_SQL + """
SELECT event_id, user_id FROM ev WHERE user_id IN (SELECT user_id FROM ev_held)""")
def jon03(spark, sf):
    e = v.ev(spark, sf)
    held = sp.group_holdout(e.select("user_id"), "user_id").filter("held_out").select("user_id").distinct()
    return rel.semi(e, held, "user_id").select("event_id", "user_id")


@register("jon04_anti_join", W("ev") + HELD_SQL + """
SELECT event_id, user_id FROM ev WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM ev_held)""")
def jon04(spark, sf):
    e = v.ev(spark, sf)
    held = sp.group_holdout(e.select("user_id"), "user_id").filter("held_out").select("user_id").distinct()
    return rel.anti(e, held, "user_id").select("event_id", "user_id")


@register("jon05_features_outcome", W("feat", "emb_cls") + """
SELECT f.group_id, f.feat, round(f.value, 6) + 0.0 AS value, o.persuaded
FROM feat f JOIN emb_cls o ON f.group_id = o.group_id""")
def jon05(spark, sf):
    out = v.emb_cls(spark, sf).select("group_id", "persuaded")
    j = rel.with_outcome(v.feat(spark, sf), out)
    return j.select("group_id", "feat", r6("value").alias("value"), "persuaded")


@register("jon06_disjoint_check", W("ev") + HELD_SQL + """
SELECT count(*) AS n_overlap FROM (
  SELECT DISTINCT user_id FROM ev WHERE user_id IN (SELECT user_id FROM ev_held)
  INTERSECT SELECT DISTINCT user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM ev_held))""")
def jon06(spark, sf):
    h = sp.group_holdout(v.ev(spark, sf), "user_id")
    a, b = h.filter("held_out"), h.filter(~F.col("held_out"))
    return rel.overlap(a, b, "user_id").agg(F.count(F.lit(1)).alias("n_overlap"))


@register("agg01_feature_stats", W("feat_holes") + """
SELECT feat, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS stddev, count(*) AS n
FROM feat_holes GROUP BY feat""")
def agg01(spark, sf):
    s = fe.feature_stats(v.feat_holes(spark, sf))
    return s.select("feat", r6("mean").alias("mean"), r6("stddev").alias("stddev"), "n")


EV_FOLDS_SQL = f""",
ev_sizes AS (SELECT user_id, count(*) AS n FROM ev WHERE user_id IS NOT NULL GROUP BY user_id),
ev_folds AS (SELECT user_id, CAST((row_number() OVER (ORDER BY n DESC, md5('42:' || CAST(user_id AS VARCHAR)),
                                                     user_id) - 1) % 5 AS INTEGER) AS folds_col FROM ev_sizes)"""


@register("agg02_fold_counts", W("ev") + EV_FOLDS_SQL + """
SELECT f.folds_col, count(*) AS n FROM ev e JOIN ev_folds f ON e.user_id = f.user_id GROUP BY f.folds_col""")
def agg02(spark, sf):
    f = sp.group_kfold(v.ev(spark, sf), "user_id").filter(F.col("folds_col").isNotNull())
    return rel.rows_per_value(f, "folds_col")


@register("agg03_mean_words", W("messages") + f"""
SELECT round(avg({sql_words("message")}), 6) + 0.0 AS mean_words_message,
       round(avg({sql_words("claim")}), 6) + 0.0 AS mean_words_claim FROM messages""")
def agg03(spark, sf):
    m = v.messages(spark, sf, label=False)
    means = rel.mean_word_count(m, "message", "claim")
    return means.select(*[r6(c).alias(c) for c in means.columns])


@register("agg04_duplicate_report", W("messages") + """
SELECT count(DISTINCT claim) AS n_distinct, count(*) AS n_rows FROM messages""")
def agg04(spark, sf):
    return rel.duplicate_report(v.messages(spark, sf, label=False), "claim")


@register("agg05_group_sizes", W("messages") + "SELECT claim_id, count(*) AS n FROM messages GROUP BY claim_id")
def agg05(spark, sf):
    return rel.group_sizes(v.messages(spark, sf, claim=False, label=False), "claim_id")


@register("agg06_class_counts", W("ord") + """
SELECT o_custkey, count(*) AS n, sum(label) AS n1 FROM ord GROUP BY o_custkey""")
def agg06(spark, sf):
    return rel.class_counts(v.ord_(spark, sf), "o_custkey", "label")


@register("agg08_ngram_counts", W("messages") + sql_ngrams_cte() + """
SELECT group_id, feat, value, round(group_norm, 6) + 0.0 AS group_norm FROM ngrams""")
def agg08(spark, sf):
    g = rel.ngram_counts(v.messages(spark, sf, claim=False, label=False), "message", "message_id")
    return g.select("group_id", "feat", "value", r6("group_norm").alias("group_norm"))


SPLIT3_SQL = """,
m_groups AS (SELECT DISTINCT claim_id FROM messages),
m_split AS (SELECT claim_id, CASE WHEN r < (g * 6) // 10 THEN 'train'
                                  WHEN r < (g * 6) // 10 + (g * 2) // 10 THEN 'validation' ELSE 'test' END AS split
            FROM (SELECT claim_id, row_number() OVER (ORDER BY md5('42:' || claim_id) NULLS FIRST,
                                                      claim_id NULLS FIRST) - 1 AS r,
                         count(*) OVER () AS g FROM m_groups))"""


@register("agg09_split_sizes", W("messages") + SPLIT3_SQL + """
SELECT s.split, count(*) AS n FROM messages m JOIN m_split s ON m.claim_id IS NOT DISTINCT FROM s.claim_id
GROUP BY s.split""")
def agg09(spark, sf):
    s = sp.three_way_split(v.messages(spark, sf, claim=False, label=False), "claim_id")
    return rel.rows_per_value(s, "split")


CE_SQL = """(greatest(e0, e1) + ln(exp(e0 - greatest(e0, e1)) + exp(e1 - greatest(e0, e1)))
             - CASE WHEN label = 1 THEN e1 ELSE e0 END)"""
# A trained head's logits in SQL.  From a zero start Adam's first step is -lr * g / (|g| + 1e-8) with
# g = avg((0.5 - y) * [x, 1]); e0/e1 are the logits of a head with step 0.05, e2/e3 with step 0.1.
HEAD_LR = 0.05
LOGITS_SQL = f""",
head_x AS (SELECT vec_id, CAST(label >= 5 AS INTEGER) AS label, i, CAST(embedding[i + 1] AS DOUBLE) AS x
           FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)
           UNION ALL SELECT vec_id, CAST(label >= 5 AS INTEGER), -1, 1.0 FROM embeddings),
head_w AS (SELECT i, -{HEAD_LR} * g / (abs(g) + 1e-8) AS w
           FROM (SELECT i, avg((0.5 - label) * x) AS g FROM head_x GROUP BY i)),
logits AS (SELECT vec_id, label, vec_id // 64 AS batch_id, -sum(w * x) AS e0, sum(w * x) AS e1,
                  -2 * sum(w * x) AS e2, 2 * sum(w * x) AS e3
           FROM head_x JOIN head_w ON head_x.i = head_w.i GROUP BY vec_id, label)"""


def logits(spark, sf):
    """Scores of two heads trained for one epoch on the embeddings (see LOGITS_SQL)."""
    from suasion.operators import train as tr
    e = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("label"), F.floor(F.col("vec_id") / 64).cast("bigint").alias("batch_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    heads = [tr.HeadSetting(n, lr=lr, patience=0, load_best=False) for n, lr in (("a", HEAD_LR), ("b", 2 * HEAD_LR))]
    _, final = tr.train_heads(e.withColumn("split", F.lit("train")), heads, "features", "label", epochs=1)
    for k, run in enumerate("ab"):
        h = tr.head_logit(final[run]["theta"], "features")
        e = e.withColumn(f"e{2 * k + 1}", h).withColumn(f"e{2 * k}", -F.col(f"e{2 * k + 1}"))
    return e.drop("features")


@register("agg10_batch_loss_mean", "WITH x AS (SELECT 1)" + LOGITS_SQL + f"""
SELECT round(avg(b), 6) + 0.0 AS mean_of_batches FROM (
  SELECT batch_id, avg({CE_SQL}) AS b FROM logits GROUP BY batch_id)""")
def agg10(spark, sf):
    l = logits(spark, sf).withColumn("loss", ev_.cross_entropy2("e0", "e1", "label"))
    return rel.mean_of_batch_means(l, "loss", "batch_id").select(r6("mean_of_batches").alias("mean_of_batches"))


@register("srt01_sort_prompt", W("messages") + """
SELECT message_id, row_number() OVER (ORDER BY claim NULLS FIRST, message_id NULLS FIRST) - 1 AS pos FROM messages""")
def srt01(spark, sf):
    m = v.messages(spark, sf, label=False).select("message_id", "claim")
    return global_index(m, [F.col("claim").asc_nulls_first(), F.col("message_id").asc_nulls_first()],
                        "pos").select("message_id", "pos")


@register("srt02_sort_time", W("pairs") + """
SELECT claim_id, row_number() OVER (ORDER BY claim_created_utc NULLS LAST, claim_id) - 1 AS pos FROM pairs""")
def srt02(spark, sf):
    p = v.pairs(spark, sf).select("claim_id", "claim_created_utc")
    return global_index(p, [F.col("claim_created_utc").asc_nulls_last(), F.col("claim_id").asc()],
                        "pos").select("claim_id", "pos")


@register("srt03_sort_group_feat", W("feat") + """
SELECT group_id, feat, row_number() OVER (ORDER BY group_id, feat) - 1 AS pos FROM feat""")
def srt03(spark, sf):
    f = v.feat(spark, sf).select("group_id", "feat")
    return global_index(f, [F.col("group_id").asc(), F.col("feat").asc()], "pos")


ORD_FOLDS_SQL = """,
ord_groups AS (SELECT o_custkey, count(*) AS n, sum(label) AS n1 FROM ord WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
ord_folds AS (SELECT o_custkey, n, n1, CAST((row_number() OVER (ORDER BY n DESC, n1 DESC,
                     md5('42:' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1) % 5 AS INTEGER) AS fold FROM ord_groups),
ord_sizes AS (SELECT fold, sum(n) AS size FROM ord_folds GROUP BY fold),
ord_best AS (SELECT fold, size, CAST(abs(size - (SELECT count(*) FROM ord) // 5) AS BIGINT) AS diff
             FROM ord_sizes ORDER BY diff, fold LIMIT 1)"""


@register("srt04_argmin_first", W("ev") + """
SELECT value, event_id FROM ev WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 1""")
def srt04(spark, sf):
    e = v.ev(spark, sf).filter(F.col("value").isNotNull())
    return rel.argmin_first(e, "value", "event_id")


@register("srt05_best_run", "WITH x AS (SELECT 1)" + LOGITS_SQL + """
SELECT batch_id, round(eval_acc, 6) + 0.0 AS eval_acc FROM (
  SELECT batch_id, avg(CAST((CASE WHEN e1 > e0 THEN 1 ELSE 0 END) = label AS DOUBLE)) AS eval_acc
  FROM logits GROUP BY batch_id) ORDER BY eval_acc DESC, batch_id LIMIT 1""")
def srt05(spark, sf):
    l = logits(spark, sf).withColumn("pred", ev_.argmax2("e0", "e1"))
    runs = ev_.accuracy(l, "label", "pred", ["batch_id"]).withColumnRenamed("accuracy", "eval_acc")
    return rel.best_by(runs, "eval_acc", "batch_id").select("batch_id", r6("eval_acc").alias("eval_acc"))


@register("srt06_preview", W("feat") + """
SELECT * FROM (SELECT group_id, feat, round(value, 6) + 0.0 AS value, 'head' AS part FROM feat
               ORDER BY group_id, feat LIMIT 5)
UNION ALL
SELECT * FROM (SELECT group_id, feat, round(value, 6) + 0.0 AS value, 'tail' AS part FROM feat
               ORDER BY group_id DESC, feat DESC LIMIT 5)""")
def srt06(spark, sf):
    f = v.feat(spark, sf).select("group_id", "feat", r6("value").alias("value"))
    head = rel.preview(f, ["group_id", "feat"], 5).withColumn("part", F.lit("head"))
    tail = rel.preview(f, ["group_id", "feat"], 5, tail=True).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


@register("mth07_epoch_cutoff", W("ev") + """
SELECT event_id, created_utc - date_diff('second', TIMESTAMP '1970-01-01', TIMESTAMP '2024-01-24') AS seconds_after_cutoff,
       created_utc >= date_diff('second', TIMESTAMP '1970-01-01', TIMESTAMP '2024-01-24') AS out_of_time FROM ev""")
def mth07(spark, sf):
    e = v.ev(spark, sf)
    cut = F.lit(utc_cutoff(2024, 1, 24))
    return e.select("event_id", (F.col("created_utc") - cut).alias("seconds_after_cutoff"),
                    (F.col("created_utc") >= cut).alias("out_of_time"))
