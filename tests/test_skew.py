"""key_join beyond the broadcast bound: repeated rows of a hot key, and streams."""

import pytest
from pyspark.sql import functions as F

from suasion.operators import features as fe
from suasion.operators import skew
from suasion.streaming.feature_stream import zscore_stream


@pytest.fixture(autouse=True)
def no_broadcast(monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)


def test_equal_rows_of_a_hot_key_are_spread(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3990, F.concat(F.lit("k"), F.col("id"))).alias("key"), F.lit(7).alias("x"))
    per = rows.select("key").distinct().withColumn("v", F.length("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert skew.salts_by_key(rows, "key")["hot"] == -(-3000 * parts // 4000)
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = skew.key_join(rows, per, "key", how)
        counts = {r["key"]: r["count"] for r in got.groupBy("key").count().collect()}
        want = {"left": (3000, 4000), "inner": (3000, 3990), "left_semi": (3000, 3990), "left_anti": (None, 10)}[how]
        assert (counts.get("hot"), sum(counts.values())) == want, how
    joined = skew.key_join(rows, per, "key", "inner")
    assert "_salt" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.columns == ["key", "x", "v"] and joined.filter("v <> length(key)").count() == 0


def test_size_of_a_table(spark, monkeypatch):
    df = spark.createDataFrame([("a" * 100, 1, [1, 2]), (None, 2, None)], "s string, n int, a array<int>")
    for bound, fits in ((100, False), (200, True)):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
        assert skew.fits_broadcast(df) == fits
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert skew.fits_broadcast(df.limit(0)) and not skew.fits_broadcast(df)


def test_stats_beyond_the_bound_serve_a_stream(spark, tmp_path):
    cells = spark.createDataFrame([(f"g{i}", f"f{i % 5}", float(i), float(i)) for i in range(60)], "group_id string, feat string, value double, group_norm double")
    cells.repartition(3).write.parquet(str(tmp_path / "in"))
    stats = fe.feature_stats(cells)
    query = zscore_stream(spark, str(tmp_path / "in"), cells.schema, stats, str(tmp_path / "out"), "beyond", max_files_per_trigger=1)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    want = fe.zscore_sql_form(cells).select(*got.columns)
    assert got.count() == 60 and got.exceptAll(want).count() == 0
