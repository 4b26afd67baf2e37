"""Session construction and shared-folder helpers.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by the
cluster).  Only a local-mode session without that setting gets a private
temporary folder, which is what the tests use.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # runtime broadcast decision only from measured shuffle sizes
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "suasion", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where unset.

    The cluster names it in ``spark.checkpoint.dir``; a local session without
    it (tests) gets a fresh temporary folder.  A non-local session without it
    is an error: a machine-local folder is useless once executors move.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="suasion-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "suasion-scratch", f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables.  Call it when a query's result has been saved:
    results are lazy and read their scratch tables until then.  (Checkpoint files go with their
    data frames where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.)"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(ensure_checkpoint_dir(spark), "suasion-scratch"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_STORED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df, name: str):
    """``df`` written as Parquet in the shared folder and read back.  For the state of an iteration: a
    checkpoint keeps the size estimate of its plan, which multiplies with every join of a loop; a stored
    table has the size of its files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def drop_stored(*tables) -> None:
    """Delete stored tables whose readers' own results are written."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STORED.pop(t))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A row of megabytes: row groups and pages end by their bytes, not after 100 rows, so neither writer nor reader holds many rows.
WIDE_ROWS = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
             "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def with_conf(spark: SparkSession, key: str, value: str):
    """A session setting for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go when it has ended, not when the driver happens to collect its garbage.  For
    writes and small results: the plan of a write is its own, so nobody reads these files again."""
    return with_conf(spark, _CLEANUP, "true")


def stored_by(df, name: str, key: str, buckets: int):
    """``stored`` in buckets of ``key``, for tables of wide rows: what meets them by ``key`` comes to where they lie, they are
    not shuffled.  The catalog knows the table only while it is written and opened."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"suasion_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.bucketBy(buckets, key).options(path=path, **WIDE_ROWS).saveAsTable(table)
    out = spark.table(table).select("*")
    out.schema  # noqa: B018  resolved while the catalog has it
    spark.sql(f"DROP TABLE {table}")  # the files stay: the table is external
    _STORED[out] = path
    return out
