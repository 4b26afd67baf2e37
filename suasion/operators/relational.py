"""Filters, joins, aggregates and sorts (FLT, JON, AGG, SRT)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.functions.text import lower_tokens, token_count, word_count
from suasion.operators.skew import key_join


# FLT ------------------------------------------------------------------------------
def time_cut(df: DataFrame, cutoff: int, col: str = "claim_created_utc",
             ts_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT01: (in-time ``<``, out-of-time ``>=``); null times fall out of both.

    With ``ts_col`` (a UTC timestamp_ntz that ``col`` is the epoch of) the predicate is
    put on the stored timestamp, so it reaches the Parquet scan as a pushed filter.
    """
    if ts_col:
        import datetime as dt
        # text → timestamp_ntz is independent of the session time zone (a datetime literal is not)
        text = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=cutoff)).strftime("%Y-%m-%d %H:%M:%S")
        lit = F.lit(text).cast("timestamp_ntz")
        return df.filter(F.col(ts_col) < lit), df.filter(F.col(ts_col) >= lit)
    return df.filter(F.col(col) < F.lit(cutoff)), df.filter(F.col(col) >= F.lit(cutoff))


def equals(df: DataFrame, col: str, value) -> DataFrame:
    """FLT04."""
    return df.filter(F.col(col) == F.lit(value))


def short_texts(df: DataFrame, col: str = "message", max_words: int = 50) -> DataFrame:
    """FLT05: rows with fewer than ``max_words`` whitespace words."""
    return df.filter(word_count(col) < max_words)


def groups_over_threshold(ngrams: DataFrame, threshold: int, group_id: str = "group_id",
                          value: str = "value") -> DataFrame:
    """FLT06: groups whose total 1-gram count is at least ``threshold``."""
    return (ngrams.groupBy(group_id).agg(F.sum(value).alias("_tot"))
            .filter(F.col("_tot") >= threshold).select(group_id))


def keep_frequent_groups(df: DataFrame, ngrams: DataFrame, threshold: int,
                         group_id: str = "group_id", df_key: str | None = None) -> DataFrame:
    kept = groups_over_threshold(ngrams, threshold, group_id)
    key = df_key or group_id
    return key_join(df, kept.withColumnRenamed(group_id, key), key, "left_semi")


def keep_min_tokens(df: DataFrame, threshold: int, text: str = "message") -> DataFrame:
    """FLT06 without building the 1-gram table, where every row is its own group: the group's
    total 1-gram count is the row's token count (no explode, no shuffle)."""
    return df.filter(token_count(text) >= threshold)


# JON ------------------------------------------------------------------------------
def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """JON03: rows whose key is in ``keys``."""
    return key_join(df, keys.select(on).distinct(), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """JON04: rows whose key is not in ``keys``; like pandas ``~isin`` a null key is kept."""
    return key_join(df, keys.select(on).filter(F.col(on).isNotNull()).distinct(), on, "left_anti")


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """JON06: keys present on both sides (must be empty for a leak-free split)."""
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_semi")  # one row per key on both sides


def assert_disjoint(a: DataFrame, b: DataFrame, on: str) -> None:
    if overlap(a, b, on).limit(1).count() > 0:
        raise AssertionError(f"some values of {on} are on both sides")


def with_outcome(features: DataFrame | dict[str, DataFrame], outcomes: DataFrame, group_id: str = "group_id") -> DataFrame:
    """JON05: feature rows of one table, or of several named ones (names become prefixes), joined to
    the outcome table by group id."""
    if isinstance(features, dict):
        from suasion.operators.features import combine_feature_tables
        features = combine_feature_tables(features)
    return features.join(outcomes, group_id)


# AGG ------------------------------------------------------------------------------
def rows_per_value(df: DataFrame, col: str = "folds_col") -> DataFrame:
    """AGG02 / AGG09."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def mean_word_count(df: DataFrame, *cols: str) -> DataFrame:
    """AGG03: mean whitespace word count of each text column (null text skipped), in one pass."""
    return df.agg(*[F.avg(word_count(c)).alias(f"mean_words_{c}") for c in cols])


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """AGG04: distinct keys vs rows."""
    return df.agg(F.countDistinct(key).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """AGG05: the index lists become counts; indices are never collected."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """AGG06: rows and positives per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.col(label).cast("bigint")).alias("n1"))


def pivot_mean(df: DataFrame, values: list[str], group_id="group_id", feat="feat", value="value") -> DataFrame:
    """AGG07: duplicate cells are averaged; ``values`` become columns, so they are few."""
    from suasion.operators.shape import MAX_DENSE
    if len(values) > MAX_DENSE:
        raise ValueError(f"more than {MAX_DENSE} features to pivot")
    return df.groupBy(group_id).pivot(feat, values).agg(F.avg(value))


def token_runs(sorted_tokens: str, starts: str):
    """A row's distinct tokens with their counts, from its sorted tokens and the places where a run begins."""
    def run(start, k):
        end = F.coalesce(F.get(F.col(starts), k + 1), F.size(sorted_tokens))
        return F.struct(F.get(F.col(sorted_tokens), start).alias("feat"), (end - start).cast("long").alias("n"))
    return F.transform(starts, run)


def run_starts(sorted_tokens: str):
    """Places of a sorted array where a value differs from the one before."""
    def begins(i):
        return (i == 0) | (F.get(F.col(sorted_tokens), i) != F.get(F.col(sorted_tokens), i - 1))
    return F.when(F.size(sorted_tokens) > 0, F.filter(F.sequence(F.lit(0), F.size(sorted_tokens) - 1), begins))


def ngram_counts(df: DataFrame, text: str = "message", group_id: str = "message_id") -> DataFrame:
    """AGG08: 1-gram feature table — value = count, group_norm = count / group total.

    Tokens are counted inside their row: sorted, then the lengths of equal runs, all by array functions.  Where every group is one row (checked on the ids
    alone) that is the table and no token is shuffled; else the row counts of a group are
    added up, and its total by a second small aggregate.
    """
    rows = df.select(F.col(group_id).alias("group_id"), token_count(text).alias("_tot"), F.sort_array(lower_tokens(text)).alias("_t"))
    repeated = df.groupBy(group_id).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).limit(1).count() > 0
    counts = (rows.withColumn("_s", run_starts("_t")).select("group_id", "_tot", F.explode(token_runs("_t", "_s")).alias("_c"))
              .select("group_id", "_tot", F.col("_c.feat").alias("feat"), F.col("_c.n").alias("_n")))
    if repeated:
        totals = rows.groupBy("group_id").agg(F.sum("_tot").alias("_tot")).withColumnRenamed("group_id", "_g")
        counts = (counts.groupBy("group_id", "feat").agg(F.sum("_n").alias("_n"))
                  .join(totals, F.col("group_id").eqNullSafe(F.col("_g"))))
    return counts.select("group_id", "feat", F.col("_n").cast("double").alias("value"),
                         (F.col("_n") / F.col("_tot")).alias("group_norm"))


def mean_of_batch_means(df: DataFrame, value: str, batch: str) -> DataFrame:
    """AGG10: average of per-batch means (over-weights a short last batch, T11)."""
    return (df.groupBy(batch).agg(F.avg(value).alias("_b"))
            .agg(F.avg("_b").alias("mean_of_batches")))


# SRT ------------------------------------------------------------------------------
def argmin_first(df: DataFrame, value: str, index: str) -> DataFrame:
    """SRT04: row with the smallest value, first index on ties (one partial aggregate)."""
    best = df.agg(F.min(F.struct(F.col(value), F.col(index))).alias("_b"))
    return best.select(F.col("_b." + value).alias(value), F.col("_b." + index).alias(index))


def best_by(df: DataFrame, metric: str, key: str, maximize: bool = True) -> DataFrame:
    """SRT05: best run by a metric, ties to the smallest key."""
    order = [F.desc(metric) if maximize else F.asc(metric), F.asc(key)]
    return df.orderBy(*order).limit(1)


def preview(df: DataFrame, order: list[str], n: int = 5, tail: bool = False) -> DataFrame:
    """SRT06: ordered head / tail."""
    cols = [F.desc(c) if tail else F.asc(c) for c in order]
    return df.orderBy(*cols).limit(n)
