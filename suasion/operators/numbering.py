"""Distributed global numbering (the basis of PRJ04/05 and the splitters).

A row's position in a total order without a one-partition window:
range-partition on the order, sort inside each partition, read the in-partition
position, materialise that assignment (reliable checkpoint), add the exclusive
prefix sum of the per-partition counts.  Only the count table (one row per
partition) is broadcast, so nothing grows with the data on the driver.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suasion.session import checkpointed


def global_index(df: DataFrame, order_cols: list, index_col: str = "_idx",
                 num_partitions: int | None = None, return_total: bool = False):
    """Add a 0-based ``index_col`` = position in ``order_cols`` order.

    The caller breaks ties (rows equal on every order column get arbitrary but
    distinct positions).  Hot keys cannot be split by range partitioning, so
    order columns should end in a near-unique key.  With ``return_total`` the row
    count comes back as well (it is the sum of the partition counts, no extra job).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    part = F.spark_partition_id()
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_part", part)
              .withColumn("_pos", F.monotonically_increasing_id()
                          - F.shiftleft(part.cast("bigint"), 33)))
    ranged = checkpointed(ranged)
    # at most one row per partition: the exclusive prefix sum becomes an array literal
    counts = {r[0]: r[1] for r in ranged.groupBy("_part").agg(F.count(F.lit(1))).collect()}
    offsets, acc = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o) for o in offsets] or [F.lit(0)]).cast("array<bigint>"),
                       F.col("_part") + 1)
    out = ranged.select(*[F.col(c) for c in cols], (F.col("_pos") + off).alias(index_col))
    return (out, acc) if return_total else out


def prefix_sums(df: DataFrame, order_cols: list, value_cols: list[str], by: list[str] | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Exclusive running sums of ``value_cols`` in ``order_cols`` order (``<col>_before``),
    restarted for every key of ``by``.

    Same two-level plan as ``global_index``: range partitions on (by, order), running
    sums inside a partition, plus the exclusive prefix of per-(partition, key) totals
    (a table with at most partitions × keys rows).  A key with most of the rows is
    spread over many range partitions instead of one window partition.  Rows must be
    distinct on (by, order).
    """
    by = by or []
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *[F.col(b) for b in by], *order_cols)
                          .withColumn("_part", F.spark_partition_id()))
    inside = (Window.partitionBy("_part", *by).orderBy(*order_cols)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}")
                                 for c in value_cols])
    totals = ranged.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *by, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0))
                                            .alias(f"_o_{c}") for c in value_cols])
    named = offsets.withColumnsRenamed({b: f"_b{i}" for i, b in enumerate(["_part", *by])})
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(["_part", *by])]  # a null key is a key
    out = local.join(named, reduce(and_, same))
    return out.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before")
                                     for c in value_cols])
