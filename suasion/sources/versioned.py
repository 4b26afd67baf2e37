"""SNK03 / SNK04 — tables that are replaced or extended in one step.

New rows are written into a folder of their own.  A version is a small file, ``_versions/<number>.json``,
that names the folders, the batches in them and the schema; it is written aside and renamed into place,
which fails if another writer took that number.  Readers take the highest version: they see the table
before or after a write, never in between, and a write that dies leaves the old version as it was.  A batch
is known by its id, so one that is sent again changes nothing.  ``vacuum`` deletes folders that no kept
version names.

``cluster_by_two`` lays a table out so that a lookup by either of two keys reads few files: rows are cut
into ranges of both keys, and a file holds one cell of that grid (cells in the order of their interleaved
bits).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suasion.session import drop_stored, stored


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # versions -----------------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict | None:
        """What a version names; None where there is none yet."""
        every = self.versions()
        if not every or (version is not None and version not in every):
            return None
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/_versions/{every[-1] if version is None else version}.json").first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> bool:
        """Whether version ``state['version']`` is now this one."""
        jvm = self.spark.sparkContext._jvm
        target = self._path(f"{self.root}/_versions/{state['version']}.json")
        aside = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            where = self._fs.makeQualified(aside).toUri()
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, self._conf).rename(
                self._fs.makeQualified(aside), self._fs.makeQualified(target), none)  # raises where the target exists
            return True
        except Exception:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                return False
            raise

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    # writes -------------------------------------------------------------------------
    def replace(self, df: DataFrame) -> int:
        """The table is ``df`` from the new version on; returns its number."""
        folder = self._write(df)
        while True:
            version = (self.versions() or [0])[-1] + 1
            if self._commit({"version": version, "folders": [folder], "batches": [], "schema": df.schema.json()}):
                return version

    def append(self, df: DataFrame, batch: str) -> int:
        """Rows of a batch, once: a batch that a version since the last ``replace`` holds changes nothing."""
        folder = None
        while True:
            now = self.state() or {"version": 0, "folders": [], "batches": [], "schema": df.schema.json()}
            if batch in now["batches"]:
                if folder:  # another writer sent it meanwhile
                    self._fs.delete(self._path(f"{self.root}/{folder}"), True)
                return now["version"]
            folder = folder or self._write(df.select(*T.StructType.fromJson(json.loads(now["schema"])).names))
            if self._commit({"version": now["version"] + 1, "folders": [*now["folders"], folder], "batches": [*now["batches"], batch],
                             "schema": now["schema"]}):
                return now["version"] + 1

    # reads --------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        found = self.state(version)
        if found is None:
            raise FileNotFoundError(f"{self.root} has no such version")
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        if not found["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in found["folders"]])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions and the folders that these don't name; returns how many folders.
        Only where no other writer is at work: a write in progress has a folder that no version names yet."""
        every = self.versions()
        named = {f for v in every[-keep:] for f in self.state(v)["folders"]}
        for v in every[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_versions/{v}.json"), False)
        data, gone = self._path(f"{self.root}/data"), 0
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def cluster_by_two(df: DataFrame, first: str, second: str, ranges: int = 16) -> DataFrame:
    """``df`` in ``ranges`` squared partitions, one per cell of the ranges of both keys (a power of two)."""
    if ranges & (ranges - 1) or not 1 <= ranges <= 256:
        raise ValueError("ranges must be a power of two up to 256")
    one = stored(df.repartitionByRange(ranges, F.col(first)).withColumn("_first", F.spark_partition_id()), "ranges-one")
    two = stored(one.repartitionByRange(ranges, F.col(second)).withColumn("_second", F.spark_partition_id()), "ranges-two")
    drop_stored(one)
    cell = F.lit(0)
    for bit in range(ranges.bit_length() - 1):
        for k, name in ((1, "_first"), (0, "_second")):
            one_bit = F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1))
            cell = cell.bitwiseOR(F.shiftleft(one_bit, 2 * bit + k))
    placed = two.withColumn("_cell", cell).repartitionByRange(ranges * ranges, "_cell").sortWithinPartitions("_cell", first, second)
    return placed.select(*df.columns)


def files_for(table: DataFrame, path_filter) -> tuple[int, int]:
    """(files with a row that passes, all files) of a file-based table."""
    named = table.withColumn("_file", F.input_file_name())
    return named.filter(path_filter).select("_file").distinct().count(), len(table.inputFiles())


def pointer_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_versions"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
