"""Test bindings: the reference's data shapes derived from the given tables.

Each view has a Spark builder and an equivalent DuckDB CTE (``SQL[name]``) so
an oracle query can start ``WITH <cte>, ... SELECT``.  Rules (fixed):

* messages  all documents; message_id = doc_id as text, message = text,
            claim_id = lang || ':' || source, claim = text of the lowest doc_id
            in that claim, persuaded = quality of the label if there is one, time columns null.
* pairs     conversations; every user turn that has a later assistant turn and a user
            turn after that is a claim; positive = the next assistant turn, negative =
            the next user turn after it; ids = conv_id || ':' || turn;
            created_utc = 1704067200 + 3600*conv_id + 60*turn.
* feat      embeddings; group_id = vec_id as text, feat = dim_feat_%03d of the
            0-based position, value = group_norm = element as double.
* feat_holes feat without cells where (vec_id + pos) % 7 = 0, plus a constant
            feature dim_feat_const = 1.0 on every group.
* emb_cls   embeddings; persuaded = (label >= 5).
* scored    embeddings; label = (label >= 5), score = round(embedding[0], 2),
            batch_id = vec_id div 64.
* ev        events; group user_id, created_utc = epoch seconds of ts (UTC).
* ord       orders; group o_custkey, label = (o_orderstatus = 'F').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suasion.functions.numeric import epoch_seconds_utc
from suasion.sources.tables import table

PAIR_TIME_BASE = 1704067200  # 2024-01-01 00:00:00 UTC


def messages(spark: SparkSession, sf_dir: str, claim: bool = True, label: bool = True) -> DataFrame:
    """All documents as messages.  ``persuaded`` (null without a label) and ``claim`` are joined
    only where the caller asks for them, so a query that reads neither has no join."""
    m = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("message_id"), F.col("text").alias("message"),
        F.concat(F.col("lang"), F.lit(":"), F.col("source")).alias("claim_id"), F.col("doc_id").alias("_doc"))
    if label:
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_doc"), F.col("quality").alias("persuaded"))
        m = m.join(labels, "_doc", "left")
    if claim:
        from suasion.operators.skew import key_join
        claims = m.filter(F.col("claim_id").isNotNull()).groupBy("claim_id").agg(F.min_by("message", "_doc").alias("claim"))
        m = key_join(m, claims, "claim_id")
    times = [F.lit(None).cast("bigint").alias(c) for c in ("message_created_utc", "claim_created_utc")]
    return m.select("message_id", "message", "claim_id", *["claim"] * claim, *["persuaded"] * label, *times)


TURNS_PER_BLOCK = 1024


def _next_turn(conv: DataFrame, role: str, out: str) -> DataFrame:
    """Adds the next later turn of ``role`` in the conversation.  A conversation of any length is
    windowed in blocks of ``TURNS_PER_BLOCK`` turns; the blocks' first turns carry over."""
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("_block")
    mine = F.when(F.col("role") == role, F.col("turn"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    rows = conv.select("*", block).withColumn("_near", F.min(mine).over(inside))
    firsts = rows.groupBy("conv_id", "_block").agg(F.min(mine).alias("_first"))
    later = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select("conv_id", "_block", F.min("_first").over(later).alias("_far"))
    return rows.join(carried, ["conv_id", "_block"]).select(*conv.columns, F.coalesce("_near", "_far").alias(out))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv = _next_turn(_next_turn(conv, "assistant", "na"), "user", "nu")

    def side(tag):
        return conv.select("conv_id", F.col("turn").alias(tag + "t"), F.col("text").alias(tag + "b"), F.col("nu").alias(tag + "n"))
    claims = conv.filter((F.col("role") == "user") & F.col("na").isNotNull()).select(
        "conv_id", F.col("turn").alias("ct"), F.col("text").alias("cb"), F.col("na").alias("pt"))
    g = claims.join(side("p").filter(F.col("pn").isNotNull()), ["conv_id", "pt"]).withColumn("nt", F.col("pn"))
    g = g.join(side("n"), ["conv_id", "nt"])

    def utc(turn):
        return (F.lit(PAIR_TIME_BASE) + F.col("conv_id") * 3600 + F.col(turn) * 60).cast("bigint")

    def rid(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col(turn).cast("string"))

    return g.select(
        rid("ct").alias("claim_id"), F.col("cb").alias("claim_body"), utc("ct").alias("claim_created_utc"),
        rid("pt").alias("positive_id"), F.col("pb").alias("positive_body"), utc("pt").alias("positive_created_utc"),
        rid("nt").alias("negative_id"), F.col("nb").alias("negative_body"),
        utc("nt").alias("negative_created_utc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense form D5: (group_id, features array<double>, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("group_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    F.col("label"))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suasion.operators.shape import vector_to_long
    return vector_to_long(vectors(spark, sf_dir).drop("label"))


def feat_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    cells = e.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    kept = cells.filter((F.col("vec_id") + F.col("pos")) % 7 != 0).select(
        F.col("vec_id").cast("string").alias("group_id"),
        F.format_string("dim_feat_%03d", F.col("pos")).alias("feat"),
        F.col("v").cast("double").alias("value"))
    const = e.select(F.col("vec_id").cast("string").alias("group_id"),
                     F.lit("dim_feat_const").alias("feat"), F.lit(1.0).alias("value"))
    u = kept.unionByName(const)
    return u.withColumn("group_norm", F.col("value"))


def emb_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("group_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    (F.col("label") >= 5).cast("int").alias("persuaded"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    (F.col("label") >= 5).cast("int").alias("label"),
                    F.round(F.col("embedding")[0].cast("double"), 2).alias("score"),
                    F.floor(F.col("vec_id") / 64).cast("bigint").alias("batch_id"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "ts",
                    epoch_seconds_utc("ts").alias("created_utc"))


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey",
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"))


# DuckDB CTEs with the same rules ------------------------------------------------
SQL = {
    "messages": """
messages_base AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS message_id, d.text AS message,
         d.lang || ':' || d.source AS claim_id, l.quality AS persuaded, d.doc_id AS _doc
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
messages_claims AS (
  SELECT claim_id, arg_min(message, _doc) AS claim FROM messages_base GROUP BY claim_id),
messages AS (
  SELECT b.message_id, b.message, b.claim_id, c.claim, b.persuaded,
         CAST(NULL AS BIGINT) AS message_created_utc, CAST(NULL AS BIGINT) AS claim_created_utc
  FROM messages_base b LEFT JOIN messages_claims c ON b.claim_id = c.claim_id)""",
    "pairs": """
turns AS (
  SELECT conv_id, turn, role, text,
         min(CASE WHEN role = 'assistant' THEN turn END) OVER w AS na, min(CASE WHEN role = 'user' THEN turn END) OVER w AS nu
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
pairs AS (
  SELECT c.conv_id || ':' || c.turn AS claim_id, c.text AS claim_body,
         CAST(1704067200 + 3600 * c.conv_id + 60 * c.turn AS BIGINT) AS claim_created_utc,
         p.conv_id || ':' || p.turn AS positive_id, p.text AS positive_body,
         CAST(1704067200 + 3600 * c.conv_id + 60 * p.turn AS BIGINT) AS positive_created_utc,
         n.conv_id || ':' || n.turn AS negative_id, n.text AS negative_body,
         CAST(1704067200 + 3600 * c.conv_id + 60 * n.turn AS BIGINT) AS negative_created_utc
  FROM turns c JOIN turns p ON p.conv_id = c.conv_id AND p.turn = c.na
  JOIN turns n ON n.conv_id = p.conv_id AND n.turn = p.nu WHERE c.role = 'user')""",
    "feat": """
feat AS (
  SELECT CAST(vec_id AS VARCHAR) AS group_id, printf('dim_feat_%03d', pos) AS feat,
         CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) AS group_norm
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM embeddings))""",
    "feat_holes": """
feat_holes AS (
  SELECT CAST(vec_id AS VARCHAR) AS group_id, printf('dim_feat_%03d', pos) AS feat,
         CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) AS group_norm
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
        FROM embeddings)
  WHERE (vec_id + pos) % 7 <> 0
  UNION ALL
  SELECT CAST(vec_id AS VARCHAR), 'dim_feat_const', 1.0, 1.0 FROM embeddings)""",
    "emb_cls": """
emb_cls AS (
  SELECT CAST(vec_id AS VARCHAR) AS group_id, CAST(label >= 5 AS INTEGER) AS persuaded, embedding
  FROM embeddings)""",
    "scored": """
scored AS (
  SELECT vec_id, CAST(label >= 5 AS INTEGER) AS label,
         round(CAST(embedding[1] AS DOUBLE), 2) AS score, vec_id // 64 AS batch_id
  FROM embeddings)""",
    "ev": """
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) AS BIGINT) AS created_utc
  FROM events)""",
    "ord": """
ord AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n].strip() for n in names) + "\n"
