"""Queries for SRC01-04 and SNK01-04: write with the sink, read back with the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from suasion.functions.numeric import r6
from suasion.operators import features as fe
from suasion.operators import shape as sh
from suasion.operators.splits import three_way_split
from suasion.plans import views as v
from suasion.plans.q_features import FLAGSHIP_SQL
from suasion.plans.q_relational import SPLIT3_SQL
from suasion.plans.registry import register
from suasion.session import scratch_path
from suasion.sources.versioned import VersionedTable, cluster_by_two
from suasion.sources import files as io

W = v.with_views


@register("src01_json_records", W("messages") + """
SELECT claim AS prompt, message, persuaded AS outcome_label FROM messages""")
def src01(spark, sf):
    m = v.messages(spark, sf).select(F.col("claim").alias("prompt"), "message",
                                     F.col("persuaded").alias("outcome_label"))
    path = scratch_path(spark, "src01-array")
    io.write_json_array_files(m, path)
    return io.read_json_records(spark, path, io.LABELLED_RECORDS, array_form=True)


@register("src02_json_lines", W("pairs") + "SELECT * FROM pairs")
def src02(spark, sf):
    path = scratch_path(spark, "src02-lines")
    v.pairs(spark, sf).write.mode("overwrite").json(path)
    return io.read_json_records(spark, path, io.PAIR_DUMP)


@register("src03_feature_csv", W("feat") +
          "SELECT group_id, feat, round(value, 6) + 0.0 AS value, round(group_norm, 6) + 0.0 AS group_norm FROM feat")
def src03(spark, sf):
    path = scratch_path(spark, "src03-csv")
    io.write_feature_csv(v.feat(spark, sf), path)
    f = io.read_feature_csv(spark, path)
    return f.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


@register("src04_feature_columns", W("feat") + "SELECT group_id, feat, round(value, 6) + 0.0 AS value FROM feat")
def src04(spark, sf):
    path = scratch_path(spark, "src04-table")
    io.replace_table(v.feat(spark, sf), path, cluster_by=["group_id", "feat"])
    f = io.read_feature_table(spark, path, with_group_norm=False)
    return f.select("group_id", "feat", r6("value").alias("value"))


@register("snk01_split_files", W("messages") + SPLIT3_SQL + """
SELECT m.message_id, m.message, m.claim_id, m.persuaded, s.split
FROM messages m JOIN m_split s ON m.claim_id IS NOT DISTINCT FROM s.claim_id""")
def snk01(spark, sf):
    cols = ["message_id", "message", "claim_id", "persuaded"]
    s = three_way_split(v.messages(spark, sf, claim=False), "claim_id").select(*cols, "split")
    path = scratch_path(spark, "snk01-splits")
    io.write_json_splits(s, path, "split")
    back = spark.read.schema("message_id string, message string, claim_id string, persuaded int, split string").json(path)
    return back.select(*cols, "split")


@register("snk02_feature_csv", FLAGSHIP_SQL)
def snk02(spark, sf):
    z = fe.zscore_sql_form(v.feat(spark, sf))
    path = scratch_path(spark, "snk02-csv")
    io.write_feature_csv(z, path)
    f = io.read_feature_csv(spark, path)
    return f.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


@register("snk03_message_table", W("messages") + """
SELECT message_id, message, claim_id, claim, persuaded, CAST(NULL AS INTEGER) AS folds_col,
       message_created_utc, claim_created_utc FROM messages""")
def snk03(spark, sf):
    t = sh.to_message_table(v.messages(spark, sf))
    path = scratch_path(spark, "snk03-messages")
    io.replace_table(t, path, cluster_by=["message_id"])
    return spark.read.parquet(path)


@register("snk04_feature_table", FLAGSHIP_SQL)
def snk04(spark, sf):
    z = fe.zscore_sql_form(v.feat(spark, sf))
    path = scratch_path(spark, "snk04-table")
    io.replace_table(z, path, cluster_by=["group_id", "feat"])
    f = io.read_feature_table(spark, path)
    return f.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


@register("snk03_versioned_table", W("feat") + """
SELECT 1 AS version, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM feat
UNION ALL SELECT 2, count(*), round(sum(2 * value), 4) + 0.0 FROM feat
UNION ALL SELECT 3, 2 * count(*), round(sum(3 * value), 4) + 0.0 FROM feat""")
def snk03_versions(spark, sf):
    """A table written, replaced and extended by a batch that is sent twice: what readers of each version see."""
    t = VersionedTable(spark, scratch_path(spark, "snk03-versions"))
    f = v.feat(spark, sf).select("group_id", "feat", "value")
    t.replace(f)
    t.replace(f.withColumn("value", F.col("value") * 2))
    for _ in range(2):
        t.append(f, "batch-1")
    out = None
    for version in t.versions():
        part = t.read(version).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))
        part = part.select(F.lit(version).alias("version"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@register("snk04_two_keys", W("feat") + "SELECT group_id, feat, round(value, 6) + 0.0 AS value FROM feat")
def snk04_two_keys(spark, sf):
    """A feature table clustered by group and feature alike, read back."""
    path = scratch_path(spark, "snk04-two-keys")
    VersionedTable(spark, path).replace(cluster_by_two(v.feat(spark, sf), "group_id", "feat", 4))
    return io.read_feature_table(spark, path, with_group_norm=False).select("group_id", "feat", r6("value").alias("value"))
