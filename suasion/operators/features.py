"""Feature statistics and transforms (AGG01, FEA01-11).

Stats tables have one row per feature and are joined by ``key_join``: broadcast up to a
measured size, so the long rows are not shuffled by feature; salted beyond it.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.operators.shape import feature_dictionary, long_to_dense, scatter, vector_to_long
from suasion.operators.skew import key_join
from suasion.operators.train import fold_values
from suasion.session import checkpointed

# The six feature sets, each one to four feature tables.
FEATURE_SETS = {
    "style": ["message_style"],
    "content": ["message_content"],
    "style+content": ["message_style", "message_content"],
    "style+claims": ["message_style", "claim_style"],
    "content+claims": ["message_content", "claim_content"],
    "style+content+claims": ["message_style", "message_content", "claim_style", "claim_content"],
}


# AGG01 / FEA03 ------------------------------------------------------------------
def feature_stats(df: DataFrame, feat: str = "feat", value: str = "value") -> DataFrame:
    """Mean, population stddev (T2: ddof 0) and row count per feature."""
    return df.groupBy(feat).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"),
                                F.count(F.lit(1)).alias("n"))


# FEA01 / FEA03 --------------------------------------------------------------------
def apply_zscore(df: DataFrame, stats: DataFrame, feat: str = "feat", value: str = "value",
                 group_norm: str = "group_norm") -> DataFrame:
    """``(v - mean) / NULLIF(stddev, 0)``; rows whose feature has no stats drop out (inner join)."""
    z = (F.col(value) - F.col("mean")) / F.nullif(F.col("stddev"), F.lit(0.0))
    cols = [c for c in df.columns if c not in (value, group_norm)]
    joined = key_join(df, stats.select(feat, "mean", "stddev"), feat, "inner")
    return joined.select(*cols, z.alias(value), z.alias(group_norm))


def zscore_sql_form(df: DataFrame, feat: str = "feat", value: str = "value") -> DataFrame:
    """FEA01: absent cells stay absent; a constant feature gives null."""
    return apply_zscore(df, feature_stats(df, feat, value), feat, value)


# FEA02 -----------------------------------------------------------------------------
def zscore_dense_form(df: DataFrame, group_id: str = "group_id", feat: str = "feat",
                      value: str = "value") -> DataFrame:
    """Pivot semantics: stats over present non-NaN cells; every (group, feat) gets a row;
    missing cells, NaN and constant features become 0.

    The full grid is one dense z-scored vector per group, exploded: no cross join, and the
    long side is shuffled by group only.
    """
    dense, dictionary = zscore_dense_vectors(df, group_id, feat, value)
    cells = dense.select(group_id, F.posexplode("features").alias("feat_idx", "value"))
    names = dictionary.select(F.col("feat_idx").cast("int").alias("feat_idx"), feat)
    return key_join(cells, names, "feat_idx", "inner").select(group_id, feat, "value", F.col("value").alias("group_norm"))


# FEA04 -----------------------------------------------------------------------------
def zscore_dense_vectors(df: DataFrame, group_id: str = "group_id", feat: str = "feat",
                         value: str = "value") -> tuple[DataFrame, DataFrame]:
    """One dense z-scored vector per group (missing / NaN / constant → 0), plus the feature
    dictionary.  Stats and positions reach the cells by one size-checked join."""
    dictionary = feature_dictionary(df.select(feat), feat)
    there = F.when(~F.isnan(F.col(value)), F.col(value))
    stats = feature_stats(df.select(feat, there.alias("_v")).filter(F.col("_v").isNotNull()), feat, "_v")
    known = dictionary.join(stats.withColumnRenamed(feat, "_f"), F.col(feat) == F.col("_f"), "left").select(
        feat, "feat_idx", "mean", "stddev")  # one row per feature
    z = (there - F.col("mean")) / F.nullif(F.col("stddev"), F.lit(0.0))
    cells = key_join(df.select(group_id, feat, value), known, feat, "inner").select(
        group_id, "feat_idx", F.coalesce(z, F.lit(0.0)).alias("value"))
    return scatter(cells, dictionary.count(), group_id), dictionary


def pca_vectors(dense: DataFrame, n_components: int = 3, group_id: str = "group_id",
                features: str = "features", prefix: str = "dim_feat_") -> DataFrame:
    """PCA of dense vectors → long table with ``n_components`` features."""
    return vector_to_long(pca_dense(dense, n_components, group_id, features), group_id=group_id, prefix=prefix)


def pca_dense(dense: DataFrame, n_components: int = 3, group_id: str = "group_id", features: str = "features") -> DataFrame:
    """PCA of dense vectors: (group, features) with ``n_components`` values.

    Data are centred before projecting (T6), each component is sign-fixed so its
    largest-magnitude loading is positive, values are rounded half-to-even to 8
    places.  Only the d×k loading matrix reaches the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # three passes (centre, fit, project) read the same vectors: written once
    vec = checkpointed(dense).select(group_id, array_to_vector(features).alias("x"))
    scaler = StandardScaler(inputCol="x", outputCol="xc", withMean=True, withStd=False).fit(vec)
    centred = scaler.transform(vec).select(group_id, "xc")
    model = PCA(k=n_components, inputCol="xc", outputCol="pcs").fit(centred)
    pc = model.pc.toArray()  # d × k, bounded by the feature count
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    proj = model.transform(centred).select(group_id, vector_to_array("pcs").alias("p"))
    return proj.select(group_id, F.transform(
        "p", lambda x, i: F.bround(x * F.element_at(F.array(*[F.lit(s) for s in signs]), i + 1), 8)
    ).alias("features"))


def pca_reduce(df: DataFrame, n_components: int = 3, group_id: str = "group_id",
               feat: str = "feat", value: str = "value", prefix: str = "dim_feat_") -> DataFrame:
    """PCA of a long feature table: missing cells are 0 (RSH05), then ``pca_vectors``."""
    dense, _ = long_to_dense(df, group_id=group_id, feat=feat, value=value)
    return pca_vectors(dense, n_components, group_id, "features", prefix)


# FEA06 -----------------------------------------------------------------------------
def factor_interactions(features: DataFrame, factors: DataFrame, group_id: str = "group_id",
                        feat: str = "feat", value: str = "value") -> DataFrame:
    """Features × factor interactions: ``feat*factor`` = value · factor value, per group.

    ``factors`` is long ``(group_id, factor, fvalue)`` with a handful of factors per
    group, so the join multiplies each feature row by that small constant.
    """
    j = features.join(factors, group_id)
    inter = j.select(group_id, F.concat(F.col(feat), F.lit("*"), F.col("factor")).alias(feat),
                     (F.col(value) * F.col("fvalue")).alias(value))
    base = features.select(group_id, feat, value)
    return base.unionByName(inter).withColumn("group_norm", F.col(value))


def residualize(df: DataFrame, label: str, factor_cols: list[str], out: str = "residual") -> DataFrame:
    """Step 1 of RFA: regress the outcome on the factors (least squares), keep the residual."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    va = VectorAssembler(inputCols=factor_cols, outputCol="_z", handleInvalid="keep")
    data = va.transform(df)
    lr = LinearRegression(featuresCol="_z", labelCol=label, predictionCol="_yhat",
                          regParam=0.0, solver="normal")
    m = lr.fit(data)
    return m.transform(data).withColumn(out, F.col(label) - F.col("_yhat")).drop("_z", "_yhat")


def rfa_kfold(df: DataFrame, label: str, factor_cols: list[str], features: str, fold_col: str,
              reg_param: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """Residualized factor adaptation over a fold column: per fold, step 1 regresses the outcome on
    the factors, step 2 regresses its residual on the features and their products with the
    factors (ridge: ``reg_param`` / 2 times the squared coefficients of the standardised columns), both
    on the other folds; the prediction is step 1 + step 2.

    One pass adds up the moments of all folds, one more predicts.  Returns ``keep`` + (fold, label, step1,
    step2, prediction), one row per input row with a fold (rows without a label are only predicted);
    raises beyond ``train.MAX_FOLDS`` folds.
    """
    from suasion.operators import newton
    z = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in factor_cols]

    def times(factor):
        return F.transform(F.col(features), lambda x: x * factor)
    crossed = [times(one) for one in z]
    y = F.col(label).cast("double")
    vector = F.concat(F.array(F.lit(1.0), *z), F.col(features), *crossed, F.array(F.coalesce(y, F.lit(0.0))))
    keep = keep or []
    data = checkpointed(df.filter(F.col(fold_col).isNotNull()).select(
        *keep, F.col(fold_col).alias("fold"), y.alias("_y"), vector.alias("_u")))
    folds = fold_values(data, "fold")
    width = data.select(F.max(F.size("_u"))).first()[0] or len(z) + 2
    moments = newton.fold_moments(data.filter(F.col("_y").isNotNull()), "_u", "fold", folds, width)
    weights = newton.rfa_weights(moments, len(z), reg_param)
    steps = data.withColumn("_p", newton.dots(F.col("_u"), weights, F.col("fold"), folds))
    return steps.select(*keep, "fold", F.col("_y").alias(label), F.col("_p")[0].alias("step1"), F.col("_p")[1].alias("step2"),
                        (F.col("_p")[0] + F.col("_p")[1]).alias("prediction"))


# FEA07 / FEA08 / FEA09 -------------------------------------------------------------------
def _same_size(a: str, b: str):
    return F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(
        F.raise_error(F.lit("vectors to combine differ in width")))


def vec_average(a: str, b: str):
    """Element-wise mean; unequal widths raise (T21: zip_with would pad with null)."""
    return F.when(_same_size(a, b), F.zip_with(a, b, lambda x, y: (x + y) / 2))


def vec_sum(a: str, b: str):
    return F.when(_same_size(a, b), F.zip_with(a, b, lambda x, y: x + y))


def vec_concat(*cols: str):
    """Order as given — the reference uses [style, content], each [prompt, message]."""
    return F.concat(*[F.col(c) for c in cols])


# FEA10 -----------------------------------------------------------------------------
def projection_matrix(in_dim: int, out_dim: int, seed: int = 42) -> list[list[float]]:
    """Fixed random affine map (T7: never trained): W[j][i] from md5(seed:i:j) in ±1/sqrt(in_dim)."""
    scale = 1.0 / math.sqrt(in_dim)
    rows = []
    for j in range(out_dim):
        r = []
        for i in range(in_dim):
            h = int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16)
            r.append((h / 4294967295.0 * 2.0 - 1.0) * scale)
        rows.append(r)
    return rows


def project(col: str, matrix: list[list[float]]):
    """``W @ x`` of a vector column, one matrix product per Arrow batch.  The matrix goes with the
    function: out × in numbers, bounded by the vector widths."""
    import numpy as np
    w = np.asarray(matrix, dtype="float64")

    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.vstack(x.tolist()) @ w.T)) if len(x) else pd.Series([], dtype=object)
    return product(F.col(col))


# FEA11 -----------------------------------------------------------------------------
def combine_feature_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of several long feature tables with the table name as a ``feat`` prefix."""
    out = None
    for name, t in tables.items():
        t2 = t.select("group_id", F.concat(F.lit(name + ":"), F.col("feat")).alias("feat"), "value")
        out = t2 if out is None else out.unionByName(t2)
    return out
