"""Queries for TXT01-05 and the scalar MTH functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from suasion.functions import numeric as nm
from suasion.functions.text import join_tokens, lower_tokens, sentences, token_count, tokens, word_count
from suasion.operators import evaluate as ev_
from suasion.plans import views as v
from suasion.plans.q_relational import CE_SQL, LOGITS_SQL, logits, sql_words
from suasion.plans.q_shape import sql_tokens
from suasion.plans.registry import register
from suasion.sources.tables import table

W = v.with_views


@register("txt01_word_count", W("messages") + f"""
SELECT message_id, {sql_words("message")} AS n_words, {sql_words("claim")} AS n_words_claim FROM messages""")
def txt01(spark, sf):
    m = v.messages(spark, sf, label=False)
    return m.select("message_id", word_count("message").alias("n_words"),
                    word_count("claim").alias("n_words_claim"))


@register("txt02_zero_pad", W("ord") + """
SELECT o_orderkey, printf('p%05d', o_custkey) AS padded, printf('dim_feat_%03d', o_custkey % 1200) AS feat_name
FROM ord""")
def txt02(spark, sf):
    o = v.ord_(spark, sf)
    return o.select("o_orderkey", F.format_string("p%05d", F.col("o_custkey")).alias("padded"),
                    F.format_string("dim_feat_%03d", F.col("o_custkey") % 1200).alias("feat_name"))


@register("txt03_sentences", W("messages") + """
SELECT message_id, CAST(i - 1 AS INTEGER) AS sent_idx, s[i] AS sentence
FROM (SELECT message_id,
             string_split(regexp_replace(message, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)) AS s
      FROM messages WHERE message IS NOT NULL), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)""")
def txt03(spark, sf):
    m = v.messages(spark, sf, claim=False, label=False).filter(F.col("message").isNotNull())
    return m.select("message_id", F.posexplode(sentences("message")).alias("sent_idx", "sentence"))


@register("txt04_tokenize", W("messages") + f"""
SELECT message_id, len({sql_tokens("message")}) AS n_tokens,
       md5(array_to_string({sql_tokens("message")}, ' ')) AS tokens_md5 FROM messages""")
def txt04(spark, sf):
    m = v.messages(spark, sf, claim=False, label=False)
    return m.select("message_id", F.size(tokens("message")).alias("n_tokens"),
                    F.md5(join_tokens(tokens("message"))).alias("tokens_md5"))


def _lower_tokens_sql() -> str:
    from suasion.plans.q_relational import SQL_STRIP
    return (f"list_filter(list_transform({sql_tokens('lower(message)')}, "
            f"lambda w: regexp_replace(w, {SQL_STRIP}, '', 'g')), lambda w: w <> '')")


@register("txt04_lower_tokens", W("messages") + f"""
SELECT message_id, len({_lower_tokens_sql()}) AS n_tokens, md5(array_to_string({_lower_tokens_sql()}, ' ')) AS tokens_md5
FROM messages""")
def txt04_lower(spark, sf):
    """The 1-gram tokeniser itself, and that the one-scan token count agrees with it."""
    m = v.messages(spark, sf, claim=False, label=False)
    t = lower_tokens("message")
    return m.select("message_id", F.when(F.size(t) == token_count("message"), F.size(t)).alias("n_tokens"),
                    F.md5(join_tokens(t)).alias("tokens_md5"))


@register("txt05_token_join", W("messages") + f"""
SELECT message_id, array_to_string({sql_tokens("message")}, ' ') AS joined FROM messages""")
def txt05(spark, sf):
    m = v.messages(spark, sf, claim=False, label=False)
    return m.select("message_id", join_tokens(tokens("message")).alias("joined"))


@register("mth03_round_half_even", W("feat") + """
SELECT group_id, feat, round_even(value * 1000, 2) AS value_bround FROM feat""")
def mth03(spark, sf):
    f = v.feat(spark, sf)
    return f.select("group_id", "feat", nm.round_half_even(F.col("value") * 1000, 2).alias("value_bround"))


@register("mth04_zero_fill", W("feat_holes") + """,
grid AS (SELECT g.group_id, d.feat FROM (SELECT DISTINCT group_id FROM feat_holes) g,
         (SELECT DISTINCT feat FROM feat_holes) d)
SELECT grid.group_id, grid.feat, round(coalesce(f.value, 0.0), 6) + 0.0 AS value
FROM grid LEFT JOIN feat_holes f ON f.group_id = grid.group_id AND f.feat = grid.feat""")
def mth04(spark, sf):
    from suasion.operators.shape import long_to_dense
    dense, dictionary = long_to_dense(v.feat_holes(spark, sf))
    cells = dense.select("group_id", F.posexplode("features").alias("feat_idx", "v"))
    return (cells.join(dictionary, "feat_idx")
            .select("group_id", "feat", nm.r6(nm.zero_fill("v")).alias("value")))


@register("mth05_softmax_argmax", "WITH x AS (SELECT 1)" + LOGITS_SQL + """
SELECT vec_id, round(CASE WHEN e1 - e0 >= 0 THEN 1.0 / (1.0 + exp(-(e1 - e0)))
                          ELSE exp(e1 - e0) / (1.0 + exp(e1 - e0)) END, 6) + 0.0 AS p1,
       CASE WHEN e1 > e0 THEN 1 ELSE 0 END AS pred FROM logits""")
def mth05(spark, sf):
    l = logits(spark, sf)
    return l.select("vec_id", nm.r6(ev_.softmax2("e0", "e1")).alias("p1"), ev_.argmax2("e0", "e1").alias("pred"))


@register("mth06_cross_entropy", "WITH x AS (SELECT 1)" + LOGITS_SQL + f"""
SELECT label, round(avg({CE_SQL}), 6) + 0.0 AS loss FROM logits GROUP BY label""")
def mth06(spark, sf):
    l = logits(spark, sf)
    return l.groupBy("label").agg(nm.r6(F.avg(ev_.cross_entropy2("e0", "e1", "label"))).alias("loss"))


@register("mth08_float_text_double", """
SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(CAST(embedding[i + 1] AS VARCHAR) AS DOUBLE) AS value
FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)""")
def mth08(spark, sf):
    e = table(spark, sf, "embeddings")
    c = e.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return c.select("vec_id", "pos", nm.float_text_double("x").alias("value"))
