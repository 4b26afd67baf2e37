"""Sources and sinks (SRC01-04, SNK01-05).

Readers take an explicit schema (no inference pass over 100 TB); writers are
task-parallel and replace their target (the reference drops and recreates its
tables).  JSON lines is splittable; the JSON-array form is read one file per task
(``multiLine``), which is inherent to that format.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suasion.sources.versioned import VersionedTable, pointer_exists

# Schemas of the reference's inputs (FIXTURES F1, F2, F6).
LABELLED_RECORDS = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("outcome_label", T.IntegerType())])
PAIR_DUMP = T.StructType([
    T.StructField("claim_id", T.StringType()), T.StructField("claim_body", T.StringType()),
    T.StructField("claim_created_utc", T.LongType()),
    T.StructField("positive_id", T.StringType()), T.StructField("positive_body", T.StringType()),
    T.StructField("positive_created_utc", T.LongType()),
    T.StructField("negative_id", T.StringType()), T.StructField("negative_body", T.StringType()),
    T.StructField("negative_created_utc", T.LongType())])
FEATURE_TABLE = T.StructType([
    T.StructField("group_id", T.StringType()), T.StructField("feat", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("group_norm", T.DoubleType())])


# SRC01 / SRC02 ---------------------------------------------------------------------
def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str,
                      array_form: bool = False) -> DataFrame:
    """JSON lines (default, splittable) or files holding one JSON array of records."""
    r = spark.read.schema(schema)
    if array_form:
        r = r.option("multiLine", True)
    return r.json(path)


# SRC03 -----------------------------------------------------------------------------
def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType = FEATURE_TABLE) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


# SRC04 -----------------------------------------------------------------------------
def read_feature_table(spark: SparkSession, path: str, with_group_norm: bool = True) -> DataFrame:
    """Chosen columns only: the projection reaches the scan (ReadSchema).  ``path`` is a
    Parquet folder, the folder of a ``VersionedTable`` or the name of a catalog table."""
    cols = ["group_id", "feat", "value"] + (["group_norm"] if with_group_norm else [])
    if "/" in path and pointer_exists(spark, path):
        return VersionedTable(spark, path).read().select(*cols)
    if "/" not in path and spark.catalog.tableExists(path):
        return spark.table(path).select(*cols)
    return spark.read.parquet(path).select(*cols)


# SNK01 -----------------------------------------------------------------------------
def write_json_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One directory per split (``split=train/`` ...) of JSON lines; re-read prunes by split."""
    df.write.mode("overwrite").partitionBy(split_col).json(path)


def write_json_array_files(df: DataFrame, path: str) -> None:
    """Each output file holds one JSON array (the reference's array input form).

    Rows are streamed batch by batch inside each task; no partition is held whole.
    """
    import pandas as pd

    cols = df.columns
    js = df.select(F.to_json(F.struct(*cols)).alias("j"))

    def frame(it):
        first = True
        for pdf in it:
            if len(pdf) == 0:
                continue
            lines = pdf["j"].tolist()
            out = []
            for s in lines:
                out.append(("[" if first else ",") + s)
                first = False
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["[" + "]" if first else "]"]})

    js.mapInPandas(frame, "value string").write.mode("overwrite").text(path)


# SNK02 -----------------------------------------------------------------------------
def write_feature_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# SNK03 / SNK04 -----------------------------------------------------------------------
def replace_table(df: DataFrame, path: str, cluster_by: list[str] | None = None,
                  table_name: str | None = None) -> None:
    """Replace a table; rows are range-clustered on ``cluster_by`` so Parquet min/max
    statistics skip row groups on those keys (the reference's secondary indexes).

    A folder is written beside the old one, which stays until the new one is complete and takes its
    name (two renames; where readers must never miss the table, or batches are added, use
    ``versioned.VersionedTable``)."""
    if cluster_by:
        df = df.repartitionByRange(*[F.col(c) for c in cluster_by]).sortWithinPartitions(*cluster_by)
    if table_name:
        df.write.mode("overwrite").format("parquet").option("path", path).saveAsTable(table_name)
        return
    spark, mark = df.sparkSession, uuid.uuid4().hex
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, target = (of(path.rstrip("/") + end) for end in (f".new-{mark}", f".old-{mark}", ""))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new.toString())
    except Exception:
        fs.delete(new, True)
        raise
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)


# SNK05 -----------------------------------------------------------------------------
RUN_DOCUMENT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("epochs", T.ArrayType(T.StructType([T.StructField("epoch", T.IntegerType())] + [
        T.StructField(c, T.DoubleType()) for c in ("train_loss", "train_acc", "eval_loss", "eval_acc")]))),
    T.StructField("final", T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("eval_loss", T.DoubleType()),
                                         T.StructField("eval_acc", T.DoubleType())]))])


def run_documents(metrics: DataFrame, settings: DataFrame) -> DataFrame:
    """One nested document per run: its settings, its epochs in order (a run holds one row per epoch), the
    best epoch's metrics."""
    row = F.struct(F.col("epoch").cast("int").alias("epoch"), "train_loss", "train_acc", "eval_loss", "eval_acc")
    runs = metrics.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("epochs"),
                                         F.min_by(row, F.struct("eval_loss", "epoch")).alias("_b"))
    return (runs.join(settings.select("run_id", F.col("settings").alias("config")), "run_id")
            .select("run_id", "config", "epochs", F.struct(F.col("_b.epoch").alias("epoch"), F.col("_b.eval_loss").alias("eval_loss"),
                                                           F.col("_b.eval_acc").alias("eval_acc")).alias("final")))


def write_run_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_DOCUMENT).json(path)


def write_metrics(df: DataFrame, path: str, form: str = "json") -> None:
    """Flat metric rows as JSON lines or CSV with a header (the k-fold report)."""
    w = df.coalesce(1).write.mode("overwrite")  # a handful of rows
    w.json(path) if form == "json" else w.option("header", True).csv(path)
