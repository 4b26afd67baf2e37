"""Small helpers of the training-data operators."""

from __future__ import annotations

import os
import weakref
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.session import ensure_checkpoint_dir, scratch_path

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Checkpoint folder set, and this package importable in Python workers that the
    session starts on machines where the repository lies at the same path."""
    ensure_checkpoint_dir(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH", REPO_ROOT)
    # a finished job's shuffle files go at once: every operator keeps what it needs in written tables
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back
    (lost executors re-read the files, nothing upstream runs again)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` whose readers' own results are written."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(t))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_store(uri: str):
    """(file system, path) of a shared folder, for executors that write plain files."""
    from pyarrow import fs
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path if scheme else uri
    return fs.FileSystem.from_uri(uri)


def texts_of(column) -> list[str]:
    """An Arrow string column as Python strings, null as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def labelled_texts(docs: DataFrame, labelled: DataFrame, label: Column, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """(label, text): at most ``sample_rows`` labelled ids, lowest id hashes first, and one text of each
    (the lowest text hash, if an id has several rows): at most ``sample_rows`` rows.  An id labelled both
    0 and 1 counts as 0."""
    ids = (labelled.select(F.col(id_col).cast("long").alias("_id"), label.alias("label"))
           .where("_id is not null and label in (0, 1)").groupBy("_id").agg(F.min("label").alias("label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("t"))
    return (texts.join(F.broadcast(ids), "_id").groupBy("_id", "label").agg(F.min("t").alias("t"))
            .select("label", F.col("t.text").alias("text")))
