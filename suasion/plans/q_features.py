"""Queries for AGG01, FEA*, RSH02-05, JON01 (feature-table jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suasion.functions.numeric import r6
from suasion.operators import features as fe
from suasion.operators import shape as sh  # noqa: F401
from suasion.plans import views as v
from suasion.plans.registry import register


def flagship(spark, sf_dir):
    """Embeddings → long feature table → per-feature stats → z-score (FEA01)."""
    z = fe.zscore_sql_form(v.feat(spark, sf_dir))
    return z.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


FLAGSHIP_SQL = v.with_views("feat") + """,
stats AS (SELECT feat, avg(value) AS mean, stddev_pop(value) AS stddev FROM feat GROUP BY feat)
SELECT t.group_id, t.feat,
       round((t.value - s.mean) / NULLIF(s.stddev, 0), 6) + 0.0 AS value,
       round((t.value - s.mean) / NULLIF(s.stddev, 0), 6) + 0.0 AS group_norm
FROM feat t JOIN stats s ON t.feat = s.feat"""

register("fea01_zscore_sql", FLAGSHIP_SQL)(flagship)


@register("fea02_zscore_dense", v.with_views("feat_holes") + """,
present AS (SELECT * FROM feat_holes WHERE value IS NOT NULL AND NOT isnan(value)),
stats AS (SELECT feat, avg(value) AS mean, stddev_pop(value) AS stddev FROM present GROUP BY feat),
grid AS (SELECT g.group_id, d.feat FROM (SELECT DISTINCT group_id FROM feat_holes) g,
         (SELECT DISTINCT feat FROM feat_holes) d),
z AS (SELECT grid.group_id, grid.feat,
             coalesce((f.value - s.mean) / NULLIF(s.stddev, 0), 0.0) AS value
      FROM grid LEFT JOIN present f ON f.group_id = grid.group_id AND f.feat = grid.feat
      LEFT JOIN stats s ON s.feat = grid.feat)
SELECT group_id, feat, round(value, 6) + 0.0 AS value, round(value, 6) + 0.0 AS group_norm FROM z""")
def fea02(spark, sf):
    z = fe.zscore_dense_form(v.feat_holes(spark, sf))
    return z.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


FEAT_SPLIT_SQL = """,
f_groups AS (SELECT DISTINCT group_id FROM feat),
f_split AS (SELECT group_id, CASE WHEN r < (g * 6) // 10 THEN 'train'
                                  WHEN r < (g * 6) // 10 + (g * 2) // 10 THEN 'validation' ELSE 'test' END AS split
            FROM (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id) NULLS FIRST,
                                                      group_id NULLS FIRST) - 1 AS r,
                         count(*) OVER () AS g FROM f_groups))"""


@register("fea03_fit_apply", v.with_views("feat") + FEAT_SPLIT_SQL + """,
stats AS (SELECT f.feat, avg(f.value) AS mean, stddev_pop(f.value) AS stddev
          FROM feat f JOIN f_split s ON f.group_id = s.group_id WHERE s.split = 'train' GROUP BY f.feat)
SELECT f.group_id, f.feat, s2.split, round((f.value - st.mean) / NULLIF(st.stddev, 0), 6) + 0.0 AS value
FROM feat f JOIN f_split s2 ON f.group_id = s2.group_id JOIN stats st ON f.feat = st.feat""")
def fea03(spark, sf):
    from suasion.operators.splits import three_way_split
    f = three_way_split(v.feat(spark, sf), "group_id")
    stats = fe.feature_stats(f.filter(F.col("split") == "train"))
    z = fe.apply_zscore(f, stats)
    return z.select("group_id", "feat", "split", r6("value").alias("value"))


HALVES_SQL = """
WITH h AS (SELECT CAST(vec_id AS VARCHAR) AS group_id,
                  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"""


def _halves(spark, sf):
    """Style = first half of a vector, content = second half; an odd width raises."""
    h = v.vectors(spark, sf)
    n = F.size("features")
    half = F.when(n % 2 == 0, (n / 2).cast("int")).otherwise(F.raise_error(F.lit("a vector of odd width has no halves")).cast("int"))
    h = h.withColumn("_half", half)
    return h.select("group_id", F.slice("features", F.lit(1), F.col("_half")).alias("style"),
                    F.slice("features", F.col("_half") + 1, F.col("_half")).alias("content"), "features")


def _long(df, col):
    return df.select("group_id", F.posexplode(col).alias("idx", "value")).select(
        "group_id", F.col("idx").cast("int").alias("idx"), r6("value").alias("value"))


@register("fea07_vec_average", HALVES_SQL + """
SELECT group_id, CAST(i AS INTEGER) AS idx, round((e[i + 1] + e[i + 1 + len(e) // 2]) / 2, 6) + 0.0 AS value
FROM h, LATERAL (SELECT unnest(range(len(e) // 2)) AS i)""")
def fea07(spark, sf):
    h = _halves(spark, sf)
    return _long(h.select("group_id", fe.vec_average("style", "content").alias("v")), "v")


@register("fea08_vec_sum", HALVES_SQL + """
SELECT group_id, CAST(i AS INTEGER) AS idx, round(e[i + 1] + e[i + 1 + len(e) // 2], 6) + 0.0 AS value
FROM h, LATERAL (SELECT unnest(range(len(e) // 2)) AS i)""")
def fea08(spark, sf):
    h = _halves(spark, sf)
    return _long(h.select("group_id", fe.vec_sum("style", "content").alias("v")), "v")


@register("fea09_vec_concat", HALVES_SQL + """
SELECT group_id, CAST(i AS INTEGER) AS idx,
       round(e[(i + len(e) // 2) % len(e) + 1], 6) + 0.0 AS value
FROM h, LATERAL (SELECT unnest(range(len(e))) AS i)""")
def fea09(spark, sf):
    h = _halves(spark, sf)
    # content first, then style: the order is the caller's choice and is preserved
    return _long(h.select("group_id", fe.vec_concat("content", "style").alias("v")), "v")


PROJ_IN, PROJ_OUT = 40, 24


def _proj_sql():
    scale = f"(1.0 / sqrt({PROJ_IN}))"
    return HALVES_SQL + f""",
w AS (SELECT i, j, (CAST(('0x' || substr(md5('42:' || i || ':' || j), 1, 8)) AS UBIGINT) / 4294967295.0 * 2.0 - 1.0)
                 * {scale} AS w
      FROM (SELECT unnest(range({PROJ_IN})) AS i), (SELECT unnest(range({PROJ_OUT})) AS j)),
x AS (SELECT group_id, i, e[i + 1] AS x FROM h, LATERAL (SELECT unnest(range({PROJ_IN})) AS i)),
y AS (SELECT x.group_id, w.j, sum(x.x * w.w) AS y FROM x JOIN w ON x.i = w.i GROUP BY x.group_id, w.j)
SELECT h.group_id, CAST(y.j AS INTEGER) AS idx, round((y.y + e[{PROJ_IN} + y.j + 1]) / 2, 6) + 0.0 AS value
FROM h JOIN y ON h.group_id = y.group_id"""


@register("fea10_projection", _proj_sql())
def fea10(spark, sf):
    """The first 40 values are projected to the width of the other 24, then both are averaged."""
    h = v.vectors(spark, sf).select("group_id", F.slice("features", 1, PROJ_IN).alias("x"),
                                    F.expr(f"slice(features, {PROJ_IN + 1}, size(features))").alias("rest"))
    m = fe.projection_matrix(PROJ_IN, PROJ_OUT)
    p = h.select("group_id", fe.project("x", m).alias("p"), "rest")
    return _long(p.select("group_id", fe.vec_average("p", "rest").alias("v")), "v")


def _sets_sql() -> str:
    """Six feature sets: style, content or both, of messages alone or of messages and their claims."""
    parts = []
    for claims in (False, True):
        for name, kinds in (("style", ["style"]), ("content", ["content"]), ("style+content", ["style", "content"])):
            for kind in kinds:
                for who in ["message"] + ["claim"] * claims:
                    at = "i + 1" if kind == "style" else "i + 1 + len(e) // 2"
                    src = "h" if who == "message" else "c"
                    parts.append(f"""SELECT '{name}{"+claims" if claims else ""}' AS feature_set, {src}.group_id,
       '{who}_{kind}:' || printf('dim_feat_%03d', i) AS feat, e[{at}] AS value
FROM {src}, LATERAL (SELECT unnest(range(len(e) // 2)) AS i)""")
    return HALVES_SQL + """,
lab AS (SELECT CAST(vec_id AS VARCHAR) AS group_id, CAST(label >= 5 AS INTEGER) AS persuaded, label FROM embeddings),
claim AS (SELECT label, arg_min(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), vec_id) AS e FROM embeddings GROUP BY label),
c AS (SELECT lab.group_id, claim.e FROM lab JOIN claim ON lab.label IS NOT DISTINCT FROM claim.label),
t AS (""" + "\nUNION ALL ".join(parts) + """)
SELECT t.feature_set, t.group_id, t.feat, round(t.value, 6) + 0.0 AS value, lab.persuaded
FROM t JOIN lab ON t.group_id = lab.group_id"""


@register("fea11_feature_sets", _sets_sql())
def fea11(spark, sf):
    """One to four feature tables joined to the outcome, for six feature sets.  A vector's claim is the
    first vector of its label."""
    from suasion.operators import relational as rel
    from suasion.operators.skew import key_join
    both = v.vectors(spark, sf).join(_halves(spark, sf).drop("features"), "group_id").select("group_id", "label", "style", "content")
    claims = both.groupBy("label").agg(F.min_by(F.struct("style", "content"), F.col("group_id").cast("long")).alias("c"))
    with_claim = key_join(both, claims, "label", "left", null_safe=True)

    def long(col):
        return sh.vector_to_long(with_claim.select("group_id", F.col(col).alias("features")))
    tables = {"message_style": long("style"), "message_content": long("content"),
              "claim_style": long("c.style"), "claim_content": long("c.content")}
    outcome = v.emb_cls(spark, sf).select("group_id", "persuaded")
    out = None
    for name, kinds in fe.FEATURE_SETS.items():
        one = rel.with_outcome({k: tables[k] for k in kinds}, outcome).withColumn("feature_set", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("feature_set", "group_id", "feat", r6("value").alias("value"), "persuaded")


@register("fea04_pca")
def fea04(spark, sf):
    """P: PCA of the z-scored feature table (properties checked in tests)."""
    dense, _ = fe.zscore_dense_vectors(v.feat(spark, sf))
    return fe.pca_vectors(dense, 3)


@register("fea06_rfa_interactions")
def fea06(spark, sf):
    """P: factors = 3 PCA components of the table itself; features and features × factors."""
    f = v.feat(spark, sf)
    factors = fe.pca_reduce(f, 3).select("group_id", F.col("feat").alias("factor"),
                                         F.col("value").alias("fvalue"))
    return fe.factor_interactions(f, factors)


@register("fea03_stream_apply", FLAGSHIP_SQL)
def fea03_stream(spark, sf):
    """Stats fitted on the feature table, applied to the same rows arriving as a stream."""
    from suasion.session import scratch_path
    from suasion.sources.files import FEATURE_TABLE
    from suasion.streaming.feature_stream import zscore_stream

    f = v.feat(spark, sf)
    src = scratch_path(spark, "stream-src")
    f.write.mode("overwrite").parquet(src)
    sink = scratch_path(spark, "stream-sink")
    q = zscore_stream(spark, src, FEATURE_TABLE, fe.feature_stats(f), sink, max_files_per_trigger=2)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("group_id", "feat", r6("value").alias("value"), r6("group_norm").alias("group_norm"))


@register("fea06_interactions_exact", """
WITH f AS (SELECT CAST(vec_id AS VARCHAR) AS group_id, printf('dim_feat_%03d', i) AS feat,
                  CAST(embedding[i + 1] AS DOUBLE) AS value
           FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)),
z AS (SELECT CAST(vec_id AS VARCHAR) AS group_id, 'z' || CAST(j AS VARCHAR) AS factor,
             CAST(embedding[j + 1] AS DOUBLE) AS fvalue
      FROM embeddings, LATERAL (SELECT unnest(range(3)) AS j))
SELECT group_id, feat, round(value, 6) + 0.0 AS value FROM f
UNION ALL
SELECT f.group_id, f.feat || '*' || z.factor, round(f.value * z.fvalue, 6) + 0.0 FROM f JOIN z ON f.group_id = z.group_id""")
def fea06_exact(spark, sf):
    """FEA06 interactions with the factors given as data (each group's first three
    embedding values), so the operator itself is checked exactly."""
    from suasion.sources.tables import table
    e = table(spark, sf, "embeddings")
    z = e.select(F.col("vec_id").cast("string").alias("group_id"),
                 F.posexplode(F.slice("embedding", 1, 3)).alias("j", "fvalue")).select(
        "group_id", F.concat(F.lit("z"), F.col("j").cast("string")).alias("factor"),
        F.col("fvalue").cast("double").alias("fvalue"))
    out = fe.factor_interactions(v.feat(spark, sf).select("group_id", "feat", "value"), z)
    return out.select("group_id", "feat", r6("value").alias("value"))
