"""Queries for PRJ*, RSH*, SET*, AGG07."""

from __future__ import annotations

from pyspark.sql import functions as F

from suasion.functions.numeric import r6
from suasion.functions.text import token_budget_merge, truncate_tokens
from suasion.operators import relational as rel
from suasion.operators import shape as sh
from suasion.plans import views as v
from suasion.plans.registry import register
from suasion.sources.tables import table

W = v.with_views

# Whitespace class and token expression shared by the SQL oracles.
SQL_WS = "'[ \\t\\n\\r\\f\\x0B]+'"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {SQL_WS}), lambda w: w <> '')"


@register("prj01_rename_label", W("messages") + "SELECT message_id, claim_id, persuaded FROM messages")
def prj01(spark, sf):
    m = v.messages(spark, sf, claim=False).withColumnRenamed("persuaded", "outcome_label")
    return sh.rename_if_present(m, "outcome_label", "persuaded").select("message_id", "claim_id", "persuaded")


@register("prj02_column_mapping", W("messages") + """
SELECT message_id, message, claim_id, claim, persuaded, CAST(NULL AS INTEGER) AS folds_col,
       message_created_utc, claim_created_utc FROM messages""")
def prj02(spark, sf):
    return sh.to_message_table(v.messages(spark, sf))


@register("prj03_fill_missing_columns", W("ev") + """
SELECT event_id, 'cmv_v001' AS format, CAST(NULL AS BIGINT) AS message_created_utc, CAST(NULL AS BIGINT) AS claim_created_utc FROM ev
UNION ALL SELECT event_id, 'cmv_v002', CAST(NULL AS BIGINT), created_utc FROM ev""")
def prj03(spark, sf):
    """A table with one of the two time columns: v001 nulls both, v002 keeps it and adds the other."""
    e = v.ev(spark, sf).select("event_id", F.col("created_utc").alias("claim_created_utc"))
    return sh.fill_time_columns(e, "cmv_v001").withColumn("format", F.lit("cmv_v001")).unionByName(
        sh.fill_time_columns(e, "cmv_v002").withColumn("format", F.lit("cmv_v002"))).select(
        "event_id", "format", "message_created_utc", "claim_created_utc")


PROMPT_IDS_SQL = W("messages") + """,
d AS (SELECT DISTINCT claim FROM messages),
ids AS (SELECT claim, 'p' || lpad(CAST(row_number() OVER (ORDER BY claim NULLS FIRST) - 1 AS VARCHAR),
                                  CAST(length(CAST((SELECT count(*) FROM d) AS VARCHAR)) AS INTEGER), '0') AS prompt_id FROM d)
SELECT m.message_id, m.claim_id, ids.prompt_id
FROM messages m LEFT JOIN ids ON m.claim IS NOT DISTINCT FROM ids.claim"""


@register("prj04_prompt_ids", PROMPT_IDS_SQL)
def prj04(spark, sf):
    m = sh.add_prompt_ids(v.messages(spark, sf, label=False), prompt="claim", id_col="prompt_id")
    return m.select("message_id", "claim_id", "prompt_id")


@register("prj05_message_ids", W("messages") + """
SELECT message_id,
       'm' || lpad(CAST(row_number() OVER (ORDER BY claim NULLS FIRST, message NULLS FIRST,
                                           message_id NULLS FIRST) - 1 AS VARCHAR),
                   CAST(length(CAST(count(*) OVER () AS VARCHAR)) AS INTEGER), '0') AS row_id
FROM messages""")
def prj05(spark, sf):
    m = sh.add_row_ids(v.messages(spark, sf, label=False), ["claim", "message", "message_id"], id_col="row_id")
    return m.select("message_id", "row_id")


MELT_SQL = W("pairs") + """
SELECT claim_id, claim_body AS claim, claim_created_utc, positive_id AS message_id, positive_body AS message,
       positive_created_utc AS message_created_utc, 1 AS persuaded FROM pairs
UNION ALL
SELECT claim_id, claim_body, claim_created_utc, negative_id, negative_body, negative_created_utc, 0 FROM pairs"""


@register("prj06_constant_label", W("pairs") + """
SELECT positive_id AS message_id, claim_id, 1 AS persuaded FROM pairs
UNION ALL SELECT negative_id, claim_id, 0 FROM pairs""")
def prj06(spark, sf):
    return sh.melt_pairs(v.pairs(spark, sf)).select("message_id", "claim_id", "persuaded")


@register("rsh01_pair_melt", MELT_SQL)
def rsh01(spark, sf):
    return sh.melt_pairs(v.pairs(spark, sf))


@register("set01_union_by_name", MELT_SQL)
def set01(spark, sf):
    return sh.melt_pairs_union(v.pairs(spark, sf))


@register("prj07_text_assembly", W("messages") + """
SELECT message_id, coalesce(claim, '') || ' ' || message AS text, message AS text_message_only FROM messages""")
def prj07(spark, sf):
    m = sh.text_column(v.messages(spark, sf, label=False), "claim", "message", True, "text")
    m = sh.text_column(m, "claim", "message", False, "text_message_only")
    return m.select("message_id", "text", "text_message_only")


@register("prj08_token_budget_merge", W("messages") + f"""
SELECT message_id,
       array_to_string(list_concat(
           list_slice({sql_tokens("coalesce(claim, '')")}, 1,
                      greatest(64 - len({sql_tokens("coalesce(message, '')")}), 0)),
           {sql_tokens("coalesce(message, '')")}), ' ') AS merged
FROM messages""")
def prj08(spark, sf):
    m = v.messages(spark, sf, label=False)
    return m.select("message_id", token_budget_merge("claim", "message", 64).alias("merged"))


@register("prj09_truncate_tokens", W("messages") + f"""
SELECT message_id, array_to_string(list_slice({sql_tokens("message")}, 1, 64), ' ') AS truncated
FROM messages""")
def prj09(spark, sf):
    m = v.messages(spark, sf, claim=False, label=False)
    return m.select("message_id", truncate_tokens("message", 64).alias("truncated"))


FEAT_OUT_SQL = "SELECT group_id, feat, round(value, 6) + 0.0 AS value, round(group_norm, 6) + 0.0 AS group_norm FROM "


def _feat_out(df):
    return df.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


@register("prj10_group_norm", W("feat_holes") + FEAT_OUT_SQL + "feat_holes")
def prj10(spark, sf):
    return _feat_out(sh.with_group_norm(v.feat_holes(spark, sf).drop("group_norm")))


@register("rsh02_vector_to_long", W("feat") + FEAT_OUT_SQL + "feat")
def rsh02(spark, sf):
    return _feat_out(sh.vector_to_long(v.vectors(spark, sf).drop("label")))


@register("rsh03_duplicate_cells", W("feat", "feat_holes") + """
SELECT group_id, feat, count(*) AS n
FROM (SELECT group_id, feat FROM feat UNION ALL SELECT group_id, feat FROM feat_holes)
GROUP BY group_id, feat HAVING count(*) > 1""")
def rsh03(spark, sf):
    both = v.feat(spark, sf).unionByName(v.feat_holes(spark, sf))
    return sh.duplicate_cells(both)


@register("rsh04_wide_to_long", W("feat") + "SELECT group_id, feat, round(value, 6) + 0.0 AS value FROM feat")
def rsh04(spark, sf):
    e = table(spark, sf, "embeddings")
    width = e.select(F.max(F.size("embedding"))).first()[0] or 0
    wide = e.select(F.col("vec_id").cast("string").alias("group_id"),
                    *[F.col("embedding")[i].cast("double").alias(f"dim_feat_{i:03d}") for i in range(width)])
    long = sh.wide_to_long(wide)
    return long.select("group_id", "feat", r6("value").alias("value"))


@register("rsh05_long_to_dense", W("feat_holes") + """,
dict AS (SELECT feat, row_number() OVER (ORDER BY feat) - 1 AS feat_idx FROM (SELECT DISTINCT feat FROM feat_holes)),
cells AS (SELECT group_id, feat, avg(value) AS v FROM feat_holes GROUP BY group_id, feat),
grp AS (SELECT DISTINCT group_id FROM feat_holes)
SELECT g.group_id, d.feat_idx, round(coalesce(c.v, 0.0), 6) + 0.0 AS value
FROM grp g CROSS JOIN dict d LEFT JOIN cells c ON c.group_id = g.group_id AND c.feat = d.feat""")
def rsh05(spark, sf):
    dense, _ = sh.long_to_dense(v.feat_holes(spark, sf))
    return dense.select("group_id", F.posexplode("features").alias("feat_idx", "value")).select(
        "group_id", F.col("feat_idx").cast("bigint").alias("feat_idx"), r6("value").alias("value"))


@register("agg07_pivot_mean", W("feat", "feat_holes") + """
SELECT group_id, feat, round(avg(value), 6) + 0.0 AS value
FROM (SELECT group_id, feat, value FROM feat UNION ALL SELECT group_id, feat, value FROM feat_holes) GROUP BY group_id, feat""")
def agg07(spark, sf):
    """Wide with the features found in the data as columns, then its cells again (the column set depends
    on the data, so the check is on cells)."""
    both = v.feat(spark, sf).unionByName(v.feat_holes(spark, sf))
    feats = [r["feat"] for r in sh.feature_dictionary(both).orderBy("feat_idx").limit(sh.MAX_DENSE + 1).collect()]
    wide = rel.pivot_mean(both, feats)
    return sh.wide_to_long(wide).filter(F.col("value").isNotNull()).select("group_id", "feat", r6("value").alias("value"))


@register("set02_distinct_values", W("messages") + "SELECT DISTINCT claim_id FROM messages")
def set02(spark, sf):
    return sh.distinct_values(v.messages(spark, sf, claim=False, label=False), "claim_id")


@register("set03_drop_duplicates", W("ev") + """
SELECT user_id, arg_min(event_id, (created_utc, event_id)) AS event_id,
       min(created_utc) AS created_utc
FROM ev GROUP BY user_id""")
def set03(spark, sf):
    e = v.ev(spark, sf).select("user_id", "event_id", "created_utc")
    return sh.drop_duplicates_first(e, "user_id", ["created_utc", "event_id"]).select(
        "user_id", "event_id", "created_utc")
