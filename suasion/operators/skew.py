"""Joins from rows to a table with one row per key, where one key may hold most rows.

The per-key table is materialised and measured.  Up to ``BROADCAST_BYTES`` it is
broadcast: the rows are not shuffled, so a hot key does not matter.  Beyond that the rows
of a key with more than ``total / partitions`` rows are dealt to as many sub-keys as it
fills partitions, ``ceil(n * partitions / total)``, and its one row is copied to each; the
dealt rows are written first, so a task that runs again deals none anew and rows that are
equal in everything are spread too.  There are fewer than ``partitions`` such keys, so the
key → salts map travels as a literal.  A stream can't be counted beforehand: beyond the bound
its batches are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.session import checkpointed, stored

BROADCAST_BYTES = 16 << 20


_FIXED = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz", "decimal")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a materialised table's rows stay under ``BROADCAST_BYTES``: 8 bytes a number, the lengths of texts
    (other types as JSON); one small aggregate."""
    fixed = sum(8 for _, t in df.dtypes if t.split("(")[0] in _FIXED)
    texts = [F.octet_length(F.col(f"`{n}`")) for n, t in df.dtypes if t in ("string", "binary")]
    others = [F.octet_length(F.to_json(F.struct(F.col(f"`{n}`")))) for n, t in df.dtypes if t.split("(")[0] not in (*_FIXED, "string", "binary")]
    lengths = F.lit(0)
    for c in texts + others:
        lengths = lengths + F.coalesce(c, F.lit(0)) + 8
    n, size = df.agg(F.count(F.lit(1)), F.sum(lengths)).first()
    return n * fixed + (size or 0) <= BROADCAST_BYTES


def salts_by_key(rows: DataFrame, key: str) -> dict:
    """``key → number of sub-keys`` of the keys above ``total / partitions`` rows (null has none)."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter(F.col(key).isNotNull() & (F.col("n") * parts > total)).select(key, "n").collect()
    return {r[0]: -(-r[1] * parts // total) for r in hot}


def key_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "left", null_safe: bool = False) -> DataFrame:
    """``rows`` joined (left, inner, left_semi, left_anti) to ``per_key``, whose ``key`` is distinct."""
    per_key = checkpointed(per_key.withColumnRenamed(key, "_key"))
    same = F.col(key).eqNullSafe(F.col("_key")) if null_safe else F.col(key) == F.col("_key")
    if fits_broadcast(per_key):
        return rows.join(F.broadcast(per_key), same, how).drop("_key")
    if rows.isStreaming:
        return rows.join(per_key, same, how).drop("_key")
    salts = salts_by_key(rows, key)
    if not salts:
        return rows.join(per_key, same, how).drop("_key")
    of = F.create_map(*[F.lit(x) for kv in salts.items() for x in kv])
    hot = F.coalesce(F.col(key).isin(list(salts)), F.lit(False))
    dealt = stored(rows.filter(hot).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), of[F.col(key)])), "hot-rows")
    copies = F.sequence(F.lit(0), F.coalesce(of[F.col("_key")], F.lit(1)) - 1)
    spread = per_key.withColumn("_copy", F.explode(copies))
    few = dealt.join(spread, same & (F.col("_salt") == F.col("_copy")), how).drop("_key", "_salt", "_copy")
    return rows.filter(~hot).join(per_key, same, how).drop("_key").unionByName(few)
