"""Operator 7 — delta-maintained token-count rollups.

Counts by (source, lang, tokenizer_version) are additive, so a batch of changes is a small
table of signed sums.  A change inserts a document's counts, deletes a document, or gives
revised counts; deletes and revisions look up what the document holds now, which is itself
a sum of signed rows.  ``commit`` writes a batch's signed document rows and its rollup delta
into a pending folder and renames it to ``batches/<id>`` in one step: a batch that is there
already is not applied again, and a commit that breaks off leaves only a pending folder
nobody reads.  ``totals`` adds the deltas up; ``compact`` folds all of them into one
snapshot that names its batches.

Everything is DataFrame code.  Sums are map-side combined, so a source with a third of all
rows sends one row per task.  Cases: null source, language, version or id are keys like any
other (joins are null-safe); null counts are 0; several inserts of one document add up, a
delete takes all it holds, a delete of an unknown document changes nothing, a revision of
one inserts it; groups that come to no documents disappear from the totals; an empty batch
commits; columns besides those named are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
CHANGES = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, n_chars long"
ROWS = "doc_id long, source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, root: str) -> list[str]:
    """Ids of the committed batches."""
    fs, p = _fs(spark, f"{root}/batches")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _read(spark: SparkSession, root: str, part: str, schema: str, ids: list[str]) -> DataFrame:
    paths = [f"{root}/batches/{b}/{part}" for b in ids]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def holdings(spark: SparkSession, root: str) -> DataFrame:
    """What each document counts now: ROWS with the sums of its signed rows."""
    return (_read(spark, root, "rows", ROWS, batches(spark, root)).groupBy("doc_id", *KEYS)
            .agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0"))


def signed_rows(changes: DataFrame, held: DataFrame) -> DataFrame:
    """The changes as signed ROWS: + for new counts, - for what deletes and revisions replace."""
    known = changes.select("op", "doc_id", *KEYS, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                           F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    plus = known.where("op in ('insert', 'revise')").select("doc_id", *KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")
    gone = known.where("op in ('delete', 'revise')").select(F.col("doc_id").alias("_id"), F.col("tokenizer_version").alias("_v")).distinct()
    minus = held.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tokenizer_version").eqNullSafe(F.col("_v"))) \
        .select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in SUMS])
    return plus.unionByName(minus)


def rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def commit(spark: SparkSession, root: str, batch_id: str, changes: DataFrame) -> bool:
    """Apply a batch once; False where it is there already."""
    fs, place = _fs(spark, f"{root}/batches/{batch_id}")
    if fs.exists(place):
        return False
    pending = f"{root}/pending/{batch_id}-{uuid.uuid4().hex}"
    signed_rows(changes, holdings(spark, root)).write.parquet(f"{pending}/rows")
    rollup(spark.read.schema(ROWS).parquet(f"{pending}/rows")).write.parquet(f"{pending}/delta")
    fs.mkdirs(place.getParent())
    return not fs.exists(place) and bool(fs.rename(_fs(spark, pending)[1], place))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Current totals: the snapshot, if any, plus the deltas of batches it doesn't name."""
    ids = batches(spark, root)
    deltas = None
    fs, p = _fs(spark, f"{root}/snapshots")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    if names:
        folded = {r["batch"] for r in spark.read.schema("batch string").parquet(f"{root}/snapshots/{names[-1]}/batches").collect()}
        ids = [b for b in ids if b not in folded]
        deltas = spark.read.schema(DELTA).parquet(f"{root}/snapshots/{names[-1]}/totals")
    new = _read(spark, root, "delta", DELTA, ids)
    return rollup(new if deltas is None else deltas.unionByName(new)).where("n_docs <> 0")


def compact(spark: SparkSession, root: str) -> None:
    """Fold every committed batch into a new snapshot (readers see it whole or not at all)."""
    ids = batches(spark, root)
    pending = f"{root}/pending/snapshot-{uuid.uuid4().hex}"
    totals(spark, root).write.parquet(f"{pending}/totals")
    spark.createDataFrame([(b,) for b in ids], "batch string").write.parquet(f"{pending}/batches")
    fs, p = _fs(spark, f"{root}/snapshots")
    fs.mkdirs(p)
    n = len(list(fs.listStatus(p)))
    fs.rename(_fs(spark, pending)[1], _fs(spark, f"{root}/snapshots/{n:08d}")[1])


def changes(docs: DataFrame, op: str, version: str, tokens: Column, chars: Column) -> DataFrame:
    """CHANGES for every row of ``docs`` (doc_id, source, lang)."""
    return docs.select(F.lit(op).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
                       F.lit(version).alias("tokenizer_version"), tokens.cast("long").alias("n_tokens"),
                       chars.cast("long").alias("n_chars"))
