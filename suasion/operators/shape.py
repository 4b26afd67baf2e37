"""Projections, reshapes and de-duplication (PRJ, RSH, SET).

Dense vectors stay ``array<double>`` in one row per group; the long
``(group_id, feat, value, group_norm)`` form is produced only at the edges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.functions.text import assemble_text
from suasion.operators.numbering import global_index
from suasion.operators.skew import key_join

# Default column names of the message table (D3) and feature table (D4).
MESSAGE_COLUMNS = ("message_id", "message", "claim_id", "claim", "persuaded", "folds_col",
                   "message_created_utc", "claim_created_utc")
MESSAGE_TYPES = ("string", "string", "string", "string", "int", "int", "bigint", "bigint")
FEATURE_COLUMNS = ("group_id", "feat", "value", "group_norm")
TIME_COLUMNS = ("message_created_utc", "claim_created_utc")


# PRJ01 --------------------------------------------------------------------------
def rename_if_present(df: DataFrame, old: str = "outcome_label", new: str = "persuaded") -> DataFrame:
    """Rename the label column only if it exists (``withColumnRenamed`` is a no-op otherwise)."""
    return df.withColumnRenamed(old, new)


# PRJ02 --------------------------------------------------------------------------
def map_columns(df: DataFrame, mapping: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Positional dataset→table mapping: select each source column under its target name.

    A source column that is missing becomes null of the target type (T12: ``folds_col``
    is absent from held-out files).
    """
    types = types or {}
    out = []
    for src, dst in mapping.items():
        t = types.get(dst)
        c = F.col(src) if src in df.columns else F.lit(None)
        out.append((c.cast(t) if t else c).alias(dst))
    return df.select(*out)


def to_message_table(df: DataFrame, *, message_id="message_id", message="message",
                     claim_id="claim_id", claim="claim", persuaded="persuaded",
                     folds_col="folds_col", message_created_utc="message_created_utc",
                     claim_created_utc="claim_created_utc") -> DataFrame:
    """PRJ02 with the reference's eight dataset columns mapped to the D3 names and types."""
    srcs = (message_id, message, claim_id, claim, persuaded, folds_col,
            message_created_utc, claim_created_utc)
    return map_columns(df, dict(zip(srcs, MESSAGE_COLUMNS)), dict(zip(MESSAGE_COLUMNS, MESSAGE_TYPES)))


# PRJ03 --------------------------------------------------------------------------
def fill_time_columns(df: DataFrame, format_type: str = "cmv_v002",
                      columns: tuple[str, ...] = TIME_COLUMNS) -> DataFrame:
    """``cmv_v001``: always null out both time columns; ``cmv_v002``: add them only if missing."""
    if format_type not in ("cmv_v001", "cmv_v002"):
        raise ValueError(f"unknown format_type {format_type!r}")
    for c in columns:
        if format_type == "cmv_v001" or c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("bigint"))
    return df


# PRJ04 / PRJ05 -----------------------------------------------------------------------
def _padded(prefix: str, idx: str, count: int) -> Column:
    """``prefix`` + index zero-padded to ``len(str(count))`` (T17: the count, not count - 1)."""
    return F.concat(F.lit(prefix), F.lpad(F.col(idx).cast("string"), len(str(count)), "0"))


def add_prompt_ids(df: DataFrame, prompt: str = "prompt", id_col: str = "prompt_id",
                   prefix: str = "p") -> DataFrame:
    """Dense zero-padded id of each distinct prompt in code-point order; skipped if present."""
    if id_col in df.columns:
        return df
    distinct = df.select(prompt).distinct()
    numbered, n = global_index(distinct, [F.col(prompt).asc_nulls_first()], "_k", return_total=True)
    ids = numbered.select(prompt, _padded(prefix, "_k", n).alias(id_col))
    return key_join(df, ids, prompt, null_safe=True)


def add_row_ids(df: DataFrame, order: list[str], id_col: str = "message_id",
                prefix: str = "m") -> DataFrame:
    """Sequential zero-padded row id after a sort (T9: pass tie-break columns); skipped if present."""
    if id_col in df.columns:
        return df
    numbered, n = global_index(df, [F.col(c).asc_nulls_first() for c in order], "_k", return_total=True)
    return numbered.withColumn(id_col, _padded(prefix, "_k", n)).drop("_k")


# PRJ06 / RSH01 / SET01 -----------------------------------------------------------------
PAIR_SIDES = (("positive", 1), ("negative", 0))


def melt_pairs(df: DataFrame, folds_col: str | None = None) -> DataFrame:
    """One pair row → a positive (persuaded=1) and a negative (0) message row, in one scan."""
    keep = [F.col("claim_id"), F.col("claim_body").alias("claim"), F.col("claim_created_utc")]
    if folds_col:
        keep.append(F.col(folds_col))
    sides = [F.struct(F.col(f"{s}_id").alias("message_id"), F.col(f"{s}_body").alias("message"),
                      F.col(f"{s}_created_utc").alias("message_created_utc"),
                      F.lit(lab).alias("persuaded")) for s, lab in PAIR_SIDES]
    out = df.select(*keep, F.explode(F.array(*sides)).alias("_m"))
    cols = ["claim_id", "claim", "claim_created_utc", "_m.message_id", "_m.message",
            "_m.message_created_utc", "_m.persuaded"]
    if folds_col:
        cols.append(folds_col)
    return out.select(*cols)


def melt_pairs_union(df: DataFrame, folds_col: str | None = None) -> DataFrame:
    """SET01 as written in the reference: union-by-name of the two labelled halves."""
    halves = []
    for s, lab in PAIR_SIDES:
        cols = [F.col("claim_id"), F.col("claim_body").alias("claim"), F.col("claim_created_utc"),
                F.col(f"{s}_id").alias("message_id"), F.col(f"{s}_body").alias("message"),
                F.col(f"{s}_created_utc").alias("message_created_utc"), F.lit(lab).alias("persuaded")]
        if folds_col:
            cols.append(F.col(folds_col))
        halves.append(df.select(*cols))
    return halves[0].unionByName(halves[1])


# PRJ10 --------------------------------------------------------------------------
def with_group_norm(df: DataFrame, value: str = "value", group_norm: str = "group_norm") -> DataFrame:
    return df.withColumn(group_norm, F.col(value))


# RSH02 --------------------------------------------------------------------------
def vector_to_long(df: DataFrame, group_id: str = "group_id", features: str = "features",
                   prefix: str = "dim_feat_") -> DataFrame:
    """Dense vector → long rows ``prefix%03d`` (4 digits from index 1000 on)."""
    return (df.select(group_id, F.posexplode(features).alias("_pos", "value"))
            .select(F.col(group_id).alias("group_id"),
                    F.format_string(prefix + "%03d", F.col("_pos")).alias("feat"),
                    F.col("value").cast("double").alias("value"))
            .withColumn("group_norm", F.col("value")))


# RSH03 --------------------------------------------------------------------------
def duplicate_cells(df: DataFrame, group_id="group_id", feat="feat") -> DataFrame:
    """(group, feat) keys that occur more than once — what makes a strict pivot fail."""
    return df.groupBy(group_id, feat).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique_cells(df: DataFrame, group_id="group_id", feat="feat") -> DataFrame:
    if duplicate_cells(df, group_id, feat).limit(1).count() > 0:
        raise ValueError(f"some ({group_id}, {feat}) cells occur more than once")
    return df


# RSH04 --------------------------------------------------------------------------
def wide_to_long(df: DataFrame, id_col: str = "group_id", var_name: str = "feat",
                 value_name: str = "value") -> DataFrame:
    values = [c for c in df.columns if c != id_col]
    return df.unpivot([id_col], values, var_name, value_name)


# RSH05 --------------------------------------------------------------------------
def feature_dictionary(df: DataFrame, feat: str = "feat") -> DataFrame:
    """Sorted distinct feature names with their 0-based position (a small table)."""
    return global_index(df.select(feat).distinct(), [F.col(feat)], "feat_idx")


MAX_DENSE = 1 << 14  # features a dense vector may have; a vocabulary of 1-grams stays long


def scatter(cells: DataFrame, width: int, group_id: str = "group_id") -> DataFrame:
    """(group, feat_idx, value) cells → (group, features): one dense vector per group, 0 elsewhere.

    A group's cells are at most one vector (``width`` of them); the vectors of an Arrow batch are
    filled by one array assignment.
    """
    import numpy as np
    if width > MAX_DENSE:
        raise ValueError(f"{width} features are too many for dense vectors (at most {MAX_DENSE})")

    @F.pandas_udf("array<double>")
    def fill(idx: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros((len(idx), width))
        lens = [len(i) for i in idx]
        if sum(lens):
            out[np.repeat(np.arange(len(idx)), lens), np.concatenate(idx.tolist())] = np.concatenate(values.tolist())
        return pd.Series(list(out))
    per_group = cells.groupBy(group_id).agg(F.collect_list(F.struct("feat_idx", "value")).alias("_c"))
    return per_group.select(group_id, fill(F.col("_c.feat_idx"), F.col("_c.value")).alias("features"))


def long_to_dense(df: DataFrame, dictionary: DataFrame | None = None, group_id: str = "group_id",
                  feat: str = "feat", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Long → one dense ``array<double>`` per group in dictionary order; missing cells = 0.

    Duplicate (group, feat) cells are averaged first (pivot_table semantics, T22).  The
    dictionary is joined by ``key_join`` (broadcast up to its measured size), so the long side
    is shuffled by group only.
    """
    if dictionary is None:
        dictionary = feature_dictionary(df, feat)
    n_feats = dictionary.count()
    indexed = key_join(df.select(group_id, feat, value), dictionary.select(feat, "feat_idx"), feat, "inner")
    cells = indexed.groupBy(group_id, "feat_idx").agg(F.avg(value).alias("value")).select(
        group_id, "feat_idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    return scatter(cells, n_feats, group_id), dictionary


# SET02 / SET03 ----------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def drop_duplicates_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep one row per key with a reproducible survivor (smallest ``order``).

    ``min_by`` over a struct is a partial aggregate, so a key with a third of all
    rows is pre-combined map-side instead of sorted in one task.
    """
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c).alias("_o_" + c) for c in others])
    best = df.groupBy(key).agg(F.min(packed).alias("_b"))
    return best.select(key, *[F.col("_b._o_" + c).alias(c) for c in others]).select(*df.columns)


def text_column(df: DataFrame, prompt: str = "claim", message: str = "message",
                include_prompt: bool = True, out: str = "text") -> DataFrame:
    """PRJ07 as a column."""
    return df.withColumn(out, assemble_text(prompt, message, include_prompt))
