"""Per-row operators on a stream: apply fitted feature statistics to arriving
feature rows and append them to a feature table, batch by batch.

This is the Structured Streaming form of the reference's commit-per-batch insert
loop: ``readStream`` (schema given, no inference) → stream-static join with the
stats table (FEA03) → ``foreachBatch`` append.  The checkpoint lives under the
shared checkpoint folder, so a restarted query resumes where it stopped and a
lost executor only re-runs its micro-batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from suasion.operators.features import apply_zscore
from suasion.session import ensure_checkpoint_dir


def zscore_stream(spark: SparkSession, source_path: str, schema: T.StructType, stats: DataFrame,
                  sink_path: str, query_name: str = "zscore_stream", max_files_per_trigger: int | None = None):
    """Start the stream with ``availableNow`` (process what is there, then stop); returns the query."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_path)
    z = apply_zscore(rows, stats)
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", os.path.basename(sink_path.rstrip("/")))

    def append(batch: DataFrame, batch_id: int) -> None:
        # a batch that runs again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    return (z.writeStream.queryName(query_name).option("checkpointLocation", ckpt)
            .foreachBatch(append).trigger(availableNow=True).start())
