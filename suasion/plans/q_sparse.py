"""Queries for sparse vectors: RSH05, TRN03 and FEA04 on tables as wide as a 1-gram vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.functions.numeric import r6
from suasion.operators import relational as rel
from suasion.operators import sparse
from suasion.operators.splits import group_kfold
from suasion.operators.train import HeadSetting
from suasion.plans import views as v
from suasion.plans.q_relational import sql_ngrams_cte
from suasion.plans.registry import register

W = v.with_views


@register("rsh05_long_to_sparse", W("feat_holes") + """
SELECT group_id, feat, round(avg(value), 6) + 0.0 AS value FROM feat_holes GROUP BY group_id, feat""")
def rsh05_sparse(spark, sf):
    """Long to sparse vectors and back: the cells that are there, no others."""
    vectors, dictionary = sparse.long_to_sparse(v.feat_holes(spark, sf))
    return sparse.sparse_to_long(vectors, dictionary).select("group_id", "feat", r6("value").alias("value"))


@register("rsh05_sparse_zscore", W("feat_holes") + """,
s AS (SELECT feat, avg(value) AS m, stddev_pop(value) AS d FROM feat_holes GROUP BY feat)
SELECT group_id, count(*) AS n_cells, round(sum(coalesce((value - m) / nullif(d, 0), 0)), 6) + 0.0 AS total
FROM feat_holes JOIN s USING (feat) GROUP BY group_id""")
def rsh05_zscore(spark, sf):
    """Z-scored sparse vectors: as many cells as before, no absent cell filled."""
    vectors, _ = sparse.long_to_sparse(sparse.zscore_cells(v.feat_holes(spark, sf)))
    total = F.aggregate("val", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("group_id", F.size("idx").cast("long").alias("n_cells"), r6(total).alias("total"))


def _gram_vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sparse 1-gram frequencies of all messages and the dictionary of the whole vocabulary."""
    grams = rel.ngram_counts(v.messages(spark, sf, claim=False, label=False), "message", "message_id")
    return sparse.long_to_sparse(grams.select("group_id", "feat", F.col("group_norm").alias("value")))


def _labelled_grams(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors, dictionary = _gram_vectors(spark, sf)
    labelled = v.messages(spark, sf, claim=False).filter(F.col("persuaded").isNotNull()).select(
        F.col("message_id").alias("group_id"), "persuaded")
    folds = group_kfold(labelled, "group_id", fold_col="folds_col")
    return vectors.join(folds, "group_id"), dictionary.select("feat_idx"), vectors


@register("trn03_sparse_first_epoch", W("messages") + sql_ngrams_cte() + """,
lab AS (SELECT message_id AS group_id, persuaded AS y FROM messages WHERE persuaded IS NOT NULL),
f AS (SELECT group_id, y, CAST((row_number() OVER (ORDER BY md5('42:' || group_id), group_id) - 1) % 5 AS INTEGER) AS fold FROM lab),
there AS (SELECT f.* FROM f WHERE group_id IN (SELECT group_id FROM ngrams)),
x AS (SELECT t.group_id, y, fold, feat, group_norm AS x FROM there t JOIN ngrams n ON t.group_id = n.group_id
      UNION ALL SELECT group_id, y, fold, NULL, 1.0 FROM there),
k AS (SELECT unnest(range(5)) AS k),
n AS (SELECT k, count(*) AS n FROM there, k WHERE fold <> k GROUP BY k),
s AS (SELECT fold, feat, sum((0.5 - y) * x) AS s FROM x GROUP BY fold, feat),
w AS (SELECT k, feat, -0.05 * g / (abs(g) + 1e-8) AS w
      FROM (SELECT n.k, s.feat, sum(CASE WHEN s.fold <> n.k THEN s.s ELSE 0 END) / any_value(n.n) AS g FROM s, n GROUP BY n.k, s.feat))
SELECT group_id, fold AS folds_col, round(1 / (1 + exp(-2 * sum(w * x))), 6) + 0.0 AS p1
FROM x JOIN w ON x.feat IS NOT DISTINCT FROM w.feat AND x.fold = w.k GROUP BY group_id, fold""")
def trn03_sparse_epoch(spark, sf):
    """Out-of-fold scores of five heads over the whole 1-gram vocabulary after one epoch: exact."""
    rows, features, vectors = _labelled_grams(spark, sf)
    _, oof = sparse.kfold_heads(rows, features, "group_id", "folds_col", [HeadSetting("run", lr=0.05, patience=0)], epochs=1, use_best=False,
                                 spent=vectors)
    return oof.select("group_id", "folds_col", r6("p1").alias("p1"))


@register("trn03_sparse_heads")
def trn03_sparse(spark, sf):
    """Five folds x two penalties over the whole 1-gram vocabulary, five epochs in common passes."""
    rows, features, vectors = _labelled_grams(spark, sf)
    settings = [HeadSetting(f"wd={wd:g}", lr=0.05, weight_decay=wd) for wd in (0.0, 1e-5)]
    _, oof = sparse.kfold_heads(rows, features, "group_id", "folds_col", settings, epochs=5, spent=vectors)
    return oof


@register("fea04_sparse_pca")
def fea04_sparse(spark, sf):
    """Three principal components of the whole 1-gram table."""
    grams = rel.ngram_counts(v.messages(spark, sf, claim=False, label=False), "message", "message_id")
    return sparse.pca_reduce(grams.select("group_id", "feat", F.col("group_norm").alias("value")), 3)


@register("fea04_score_covariance", """
WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
c AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM e),
r AS (SELECT (aa + bb) / 2 AS middle, sqrt(((aa - bb) / 2) ** 2 + ab ** 2) AS half FROM c)
SELECT 0 AS i, 0 AS j, round(middle + half, 6) + 0.0 AS covariance FROM r
UNION ALL SELECT 0, 1, 0.0 UNION ALL SELECT 1, 1, round(middle - half, 6) + 0.0 FROM r""")
def fea04_covariance(spark, sf):
    """The components' scores of the first two features of every embedding: uncorrelated, their variances the eigenvalues."""
    two = v.feat(spark, sf).filter(F.col("feat").isin("dim_feat_000", "dim_feat_001"))
    vectors, dictionary = sparse.long_to_sparse(two)
    blocks = sparse.pack(vectors, "group_id")
    scores = sparse.pca_scores(blocks, sparse.principal_components(blocks, dictionary.select("feat_idx"), 2))
    s = scores.select(F.col("features")[0].alias("s0"), F.col("features")[1].alias("s1"))
    sums = s.agg(F.covar_samp("s0", "s0").alias("a"), F.covar_samp("s0", "s1").alias("b"), F.covar_samp("s1", "s1").alias("c"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r6(n).alias("covariance")) for i, j, n in ((0, 0, "a"), (0, 1, "b"), (1, 1, "c"))])
    return sums.select(F.inline(cells))
