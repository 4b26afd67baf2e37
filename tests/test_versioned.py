"""SNK03 / SNK04: versions, batches sent twice, writes that die, and files pruned by either key."""

import pytest
from pyspark.sql import functions as F

from suasion.sources import files as io
from suasion.sources.versioned import VersionedTable, cluster_by_two, files_for


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").cast("string").alias("group_id"), F.lit("f").alias("feat"),
                                                F.col("id").cast("double").alias("value"), F.lit(0.0).alias("group_norm"))


def dying(df):
    return df.withColumn("value", F.when(F.col("value") > 5, F.raise_error(F.lit("dies")).cast("double")).otherwise(F.col("value")))


def test_versions_and_batches(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.replace(rows(spark, 10)) == 1 and t.append(rows(spark, 5, 10), "a") == 2
    old = t.read()
    assert t.append(rows(spark, 5, 10), "a") == 2 and t.read().count() == 15  # sent again
    assert t.append(rows(spark, 1, 90).select("value", "feat", "group_norm", "group_id"), "b") == 3
    assert t.replace(rows(spark, 3)) == 4 and t.read().count() == 3
    assert old.count() == 15 and t.read(1).count() == 10  # a reader keeps its version
    assert t.append(rows(spark, 2, 50), "a") == 5  # batches of a replaced table are forgotten
    assert io.read_feature_table(spark, str(tmp_path / "t")).count() == 5
    assert t.vacuum(keep=1) == 3 and t.versions() == [5] and t.read().count() == 5
    empty = VersionedTable(spark, str(tmp_path / "e"))
    assert empty.append(rows(spark, 0), "x") == 1 and empty.read().count() == 0


def test_a_write_that_dies_leaves_the_old_rows(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(rows(spark, 4))
    for write in (lambda: t.replace(dying(rows(spark, 10))), lambda: t.append(dying(rows(spark, 10)), "a")):
        with pytest.raises(Exception, match="dies"):
            write()
        assert t.versions() == [1] and sorted(r["value"] for r in t.read().collect()) == [0.0, 1.0, 2.0, 3.0]
    assert t.append(rows(spark, 2, 7), "a") == 2
    path = str(tmp_path / "plain")
    io.replace_table(rows(spark, 4), path)
    with pytest.raises(Exception, match="dies"):
        io.replace_table(dying(rows(spark, 10)), path)
    assert spark.read.parquet(path).count() == 4
    io.replace_table(rows(spark, 2), path, cluster_by=["group_id"])
    assert spark.read.parquet(path).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["plain", "t"]  # nothing is left aside


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.replace(rows(spark, 1))
    commit, seen = a._commit, []

    def late(state):
        if not seen:  # the other writer takes the number first
            seen.append(b.append(rows(spark, 5, 10), "b"))
        return commit(state)
    monkeypatch.setattr(a, "_commit", late)
    assert a.append(rows(spark, 2, 20), "a") == 3 and seen == [2]
    assert a.read().count() == 8 and a.state()["batches"] == ["b", "a"]


def test_files_are_pruned_by_either_key(spark, tmp_path):
    df = spark.range(64).crossJoin(spark.range(50).withColumnRenamed("id", "f")).select(
        F.format_string("g%03d", "id").alias("group_id"), F.format_string("f%03d", "f").alias("feat"), (F.col("id") * F.col("f")).cast("double").alias("value"),
        F.lit(0.0).alias("group_norm"))
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(cluster_by_two(df, "group_id", "feat", 8))
    back = t.read()
    assert back.count() == 3200 and back.exceptAll(df).count() == 0
    for key in (F.col("group_id") == "g017", F.col("feat") == "f033"):
        some, every = files_for(back, key)
        assert every >= 32 and some * 4 <= every
    hot = df.withColumn("group_id", F.when(F.col("value") % 3 == 0, "g000").otherwise(F.col("group_id")))
    assert cluster_by_two(hot, "group_id", "feat", 4).exceptAll(hot).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        cluster_by_two(df, "group_id", "feat", 3)
