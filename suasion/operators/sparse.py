"""Sparse feature vectors (RSH05, TRN03, FEA04) for tables as wide as a 1-gram vocabulary.

A sparse vector is a sorted array of feature positions and an array of their values; absent
features are 0.  A z-score of the present cells (FEA01) stays sparse: absent cells are 0 in the
dense form too (FEA02).

Neither a dense vector nor a weight per feature is held in one place.  ``pack`` puts the rows into
blocks of about ``BLOCK_CELLS`` cells, once; a block knows its distinct features, ascending.  Features
lie in slices of ``SLICE`` positions.  A block and a slice exchange packages: the numbers of the
features they share, (columns x features) as bytes, one row a package.  Blocks and slices are stored
in buckets, so only packages are shuffled, and a task holds one block or one slice at a time.  Training
keeps its Adam state by slice; principal components keep their subspace by row, block by block.  The
driver sees small matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.operators.extra_trees import mix
from suasion.operators.minibatch import B1, B2, EPS, losses_at
from suasion.operators.shape import feature_dictionary, vector_to_long
from suasion.operators.skew import key_join
from suasion.session import drop_stored, shuffles_dropped, stored, stored_by, with_conf

BLOCK_CELLS = 1 << 19
ROWS_AT_ONCE = 256  # vectors in an Arrow batch
SLICE = 1 << 15  # features a slice may have; a place in it is two bytes
PACKED = "block long, ids array<string>, y array<double>, part array<string>, feats binary, ptr binary, at binary, val binary"
PACKAGES = "slice long, block long, idx binary, g binary"
REPLIES = "block long, slice long, w binary, z binary"


def _buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bytes(values: np.ndarray, kind: str = "<f8") -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _plain(column) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _gather(df: DataFrame) -> DataFrame:
    """Cells (group, feat, value) as they lie, in chunks of about ``BLOCK_CELLS``: runs of one group, the chunk's distinct
    features and codes into them.  A null value's cell is absent, its feature stays.  A run is cut only beyond 8 chunks' cells."""
    most, kind = BLOCK_CELLS, df.schema["group"].dataType.simpleString()

    def starts(t: pa.Table) -> np.ndarray:
        code = _plain(t["group"]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))

    def chunk_of(t: pa.Table, chunk: int) -> pa.RecordBatch:
        first = starts(t)
        coded, value = _plain(t["feat"]).dictionary_encode("encode"), _plain(t["value"])
        there = value.is_valid().to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(there)])
        ptr = before[np.append(first, t.num_rows)]
        at, val = coded.indices.to_numpy(zero_copy_only=False)[there], value.to_numpy(zero_copy_only=False)[there]
        groups = _plain(t["group"]).take(pa.array(first))
        cells = [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), groups),
                 pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
                 *[pa.array([b], pa.binary()) for b in (_bytes(ptr, "<i8"), _bytes(at, "<i4"), _bytes(val))]]
        return pa.RecordBatch.from_arrays(cells, ["chunk", "groups", "feats", "ptr", "at", "val"])

    def run(batches):
        chunk, held, goal, pieces = TaskContext.get().partitionId() << 32, 0, most, []
        for batch in batches:
            pieces.append(batch)
            held += batch.num_rows
            if held >= goal:
                t = pa.Table.from_batches(pieces).combine_chunks()
                last = int(starts(t)[-1])
                if not last and goal < 8 * most:
                    goal, pieces = 2 * goal, t.to_batches()
                    continue
                last = last or held
                yield chunk_of(t.slice(0, last), chunk)
                pieces = t.slice(last).to_batches()
                chunk, held, goal = chunk + 1, held - last, most
        if held:
            yield chunk_of(pa.Table.from_batches(pieces).combine_chunks(), chunk)
    schema = f"chunk long, groups array<{kind}>, feats array<string>, ptr binary, at binary, val binary"
    return stored_by(df.mapInArrow(run, schema), "chunks", "chunk", _buckets(df))


def long_to_sparse(df: DataFrame, dictionary: DataFrame | None = None, group_id: str = "group_id", feat: str = "feat",
                   value: str = "value") -> tuple[DataFrame, DataFrame]:
    """RSH05 without filling: long → (group, idx, val), positions ascending, duplicate cells averaged, null values
    absent; plus the dictionary (feat, feat_idx).  Features that a given dictionary lacks are left out.

    The table is read once, into chunks as its rows lie; a chunk's distinct features are joined to the dictionary, not its
    cells.  Where a group lies in several places (checked on the groups alone) its cells are shuffled, else none is.  The
    vectors are written."""
    spark, given = df.sparkSession, dictionary
    chunks = _gather(df.select(F.col(group_id).alias("group"), F.col(feat).cast("string").alias("feat"), F.col(value).cast("double").alias("value")))
    with shuffles_dropped(spark):
        if given is None:
            names = stored(chunks.select(F.explode("feats").alias(feat)).distinct(), "features")
            dictionary = feature_dictionary(names, feat)
            drop_stored(names)
        several = chunks.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    numbered = chunks.select("chunk", F.posexplode("feats").alias("pos", "_feat")).join(
        dictionary.select(F.col(feat).alias("_name"), F.col("feat_idx").cast("long").alias("feat_idx")), F.col("_feat") == F.col("_name")).select(
        F.col("chunk").alias("chunk"), "pos", "feat_idx")  # aliased: a key of its own beside the chunks' key
    kind = df.schema[group_id].dataType.simpleString()

    def vectors_of(chunk: pa.Table, numbers: pa.Table) -> pa.Table:
        place = np.full(len(chunk["feats"][0]), -1, np.int64)
        place[numbers["pos"].to_numpy()] = numbers["feat_idx"].to_numpy()
        ptr, at, val = (np.frombuffer(chunk[n][0].as_py(), t) for n, t in (("ptr", "<i8"), ("at", "<i4"), ("val", "<f8")))
        row, idx = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), place[at]
        row, idx, val = (row, idx, val) if (idx >= 0).all() else (x[idx >= 0] for x in (row, idx, val))
        if not several:
            rising = (row[1:] > row[:-1]) | (idx[1:] > idx[:-1])
            if not rising.all():
                order = np.lexsort((idx, row))
                row, idx, val = row[order], idx[order], val[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] > row[:-1]) | (idx[1:] > idx[:-1])]))
                if len(first) < len(row):
                    val = np.add.reduceat(val, first) / np.diff(np.append(first, len(row)))
                    row, idx = row[first], idx[first]
        n = np.bincount(row, minlength=len(ptr) - 1)
        ends = pa.array(np.concatenate([[0], np.cumsum(n[n > 0])]), pa.int32())
        groups = _plain(chunk["groups"]).flatten().take(pa.array(np.flatnonzero(n)))
        return pa.table([groups, pa.ListArray.from_arrays(ends, pa.array(idx, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(val, pa.float64()))],
                        names=[group_id, "idx", "val"])
    vectors = chunks.groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInArrow(
        vectors_of, f"`{group_id}` {kind}, idx array<long>, val array<double>")
    if several:
        cells = vectors.select(group_id, F.inline(F.arrays_zip("idx", "val"))).groupBy(group_id, "idx").agg(F.avg("val").alias("val"))
        per_group = cells.groupBy(group_id).agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("c"))
        vectors = per_group.select(group_id, F.col("c.idx").alias("idx"), F.col("c.val").alias("val"))
    with shuffles_dropped(spark):
        out = stored(vectors, "vectors")
    drop_stored(chunks)
    return out, dictionary


def sparse_to_long(vectors: DataFrame, dictionary: DataFrame, group_id: str = "group_id", feat: str = "feat") -> DataFrame:
    cells = vectors.select(group_id, F.inline(F.arrays_zip(F.col("idx"), F.col("val"))))
    return key_join(cells, dictionary.select(feat, "feat_idx").withColumnRenamed("feat_idx", "idx"), "idx", "inner").select(
        group_id, feat, F.col("val").alias("value"))


def zscore_cells(df: DataFrame, feat: str = "feat", value: str = "value") -> DataFrame:
    """Z-scores of the present cells, for ``long_to_sparse``: a feature without spread gives 0, as absent cells do."""
    from suasion.operators.features import zscore_sql_form
    return zscore_sql_form(df.withColumn("group_norm", F.col(value)), feat, value).withColumn(value, F.coalesce(value, F.lit(0.0)))


@dataclass
class Blocks:
    table: DataFrame  # PACKED, in buckets of block
    routes: DataFrame  # (slice, block, idx): the places of the slice's features that the block has, in buckets of slice
    n_rows: int
    buckets: int

    def drop(self) -> None:
        drop_stored(self.table, self.routes)


def pack(rows: DataFrame, id_col: str, label: Column | None = None, part: Column | None = None) -> Blocks:
    """Rows with sparse vectors (idx, val) in blocks, as they lie in the partitions.  Written once, re-read by every pass."""
    cells = rows.select(F.col(id_col).cast("string").alias("id"), (F.lit(None) if label is None else label).cast("double").alias("y"),
                        (F.lit(None) if part is None else part).cast("string").alias("part"), "idx", "val")
    most, n = BLOCK_CELLS, _buckets(rows)

    def packed(pieces: list, block: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(pieces).combine_chunks()
        ids, y, parts, idx, val = (_plain(t[n]) for n in ("id", "y", "part", "idx", "val"))
        ptr = np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False))])
        feats, at = np.unique(idx.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        row = [[block], [ids.to_pylist()], [y.to_pylist()], [parts.to_pylist()], [_bytes(feats, "<i8")], [_bytes(ptr, "<i8")], [_bytes(at, "<i4")],
               [_bytes(val.flatten().to_numpy(zero_copy_only=False))]]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.string())] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in PACKED.split(", ")])

    def run(batches):
        block, held, pieces = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            ends = np.cumsum(batch.column(batch.schema.get_field_index("idx")).value_lengths().to_numpy(zero_copy_only=False) + 1)
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = min(batch.num_rows, int(np.searchsorted(ends, before + most - held)) + 1)
                pieces.append(batch.slice(first, last - first))
                held += int(ends[last - 1] - before)
                if held >= most:
                    yield packed(pieces, block)
                    block, held, pieces = block + 1, 0, []
                first = last
        if pieces:
            yield packed(pieces, block)

    def routes(batches):
        for batch in batches:
            for d in _rows_of(batch):
                feats = np.frombuffer(d["feats"].as_py(), "<i8")
                found = [(s, _bytes(feats[a:b] - s * SLICE, "<u2")) for s, a, b in _slices(feats)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([d["block"].as_py()] * len(found), pa.int64()),
                                                  pa.array([x for _, x in found], pa.binary())], ["slice", "block", "idx"])
    with with_conf(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE)):
        table = stored_by(cells.mapInArrow(run, PACKED), "blocks", "block", n)
    sent = table.select("block", "feats").mapInArrow(routes, "slice long, block long, idx binary").repartition(n, "slice")
    return Blocks(table, stored_by(sent, "routes", "slice", n), table.agg(F.sum(F.size("ids"))).first()[0] or 0, n)


def _slices(feats: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, first, end) of ascending features."""
    if not len(feats):
        return []
    first = np.flatnonzero(np.concatenate([[True], feats[1:] // SLICE != feats[:-1] // SLICE]))
    return list(zip((feats[first] // SLICE).tolist(), first.tolist(), [*first[1:].tolist(), len(feats)], strict=True))


@dataclass
class Block:
    """One block in a task: rows by cells, and the pass's numbers of its features (columns x features)."""
    key: int
    ids: list
    y: np.ndarray
    part: np.ndarray
    feats: np.ndarray
    row: np.ndarray
    at: np.ndarray
    val: np.ndarray
    w: np.ndarray

    def dot(self) -> np.ndarray:
        """(rows x columns): each row's vector times the numbers."""
        out = np.zeros((len(self.ids), len(self.w)))
        for c, w in enumerate(self.w):
            out[:, c] = np.bincount(self.row, self.val * w[self.at], len(self.ids))
        return out

    def back(self, by_row: np.ndarray) -> np.ndarray:
        """(columns x features): for each feature the sum of value x the row's numbers."""
        out = np.zeros((by_row.shape[1], len(self.feats)))
        for c in range(len(out)):
            out[c] = np.bincount(self.at, self.val * by_row[self.row, c], len(self.feats))
        return out

    def packages(self, numbers: np.ndarray | None, extra: dict | None = None) -> pa.Table:
        """PACKAGES of (columns x features), if any, and further numbers under slices below 0."""
        rows = [] if numbers is None else [(s, _bytes(self.feats[a:b] - s * SLICE, "<u2"), _bytes(numbers[:, a:b])) for s, a, b in _slices(self.feats)]
        rows += [(s, b"", _bytes(x)) for s, x in (extra or {}).items()]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([self.key] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                         pa.array([r[2] for r in rows], pa.binary())], names=["slice", "block", "idx", "g"])


def _block(d: dict, replies: pa.Table | None = None, columns: int = 0) -> Block:
    feats, ptr, at, val = (np.frombuffer(d[n].as_py(), t) for n, t in (("feats", "<i8"), ("ptr", "<i8"), ("at", "<i4"), ("val", "<f8")))
    w = np.zeros((columns, len(feats)))
    if columns:
        spans = {s: (a, b) for s, a, b in _slices(feats)}
        for s, x in zip(replies["slice"].to_pylist(), replies["w"], strict=True):
            if s >= 0:
                a, b = spans[s]
                w[:, a:b] = np.frombuffer(x.as_buffer(), "<f8").reshape(columns, -1)
    return Block(d["block"].as_py(), d["ids"].as_py(), np.array(d["y"].as_py(), dtype="float64"), np.array(d["part"].as_py(), dtype=object), feats,
                 np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), at.astype(np.intp), val, w)


def _rows_of(batch: pa.RecordBatch | pa.Table):
    for r in range(batch.num_rows):
        yield {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}


def _at_blocks(blocks: Blocks, sent: DataFrame, give: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``give`` of each block's row and what is sent to it; the blocks stay where they lie."""
    def run(block: pa.Table, sent: pa.Table) -> pa.Table:
        return give(next(_rows_of(block)), sent)
    return blocks.table.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, schema)


def _replies(blocks: Blocks, numbers: DataFrame, columns: int, of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """REPLIES: to every block the numbers of its features.  ``of`` makes (columns x features) of a slice's rows of ``numbers``."""
    def run(routes: pa.Table, own: pa.Table) -> pa.Table:
        w = of(own) if own.num_rows else np.zeros((columns, SLICE))
        places = (np.frombuffer(x.as_buffer(), "<u2") for x in routes["idx"])
        return pa.table([routes["block"], routes["slice"], pa.array([_bytes(w[:, p]) for p in places], pa.binary()), pa.nulls(routes.num_rows, pa.binary())],
                        names=["block", "slice", "w", "z"])
    return blocks.routes.groupBy("slice").cogroup(numbers.groupBy("slice")).applyInArrow(run, REPLIES)


def _package_sum(packages: pa.Table, columns: int) -> np.ndarray:
    """(columns x features): a slice's packages added up, in the order of the blocks; the further numbers as one row."""
    packages = packages.sort_by("block")
    if packages["slice"][0].as_py() < 0:
        return sum(np.frombuffer(x.as_buffer(), "<f8") for x in packages["g"])[None, :]
    places = [np.frombuffer(x.as_buffer(), "<u2") for x in packages["idx"]]
    out = np.zeros((columns, 1 + max(int(p[-1]) for p in places)))
    for p, g in zip(places, packages["g"], strict=True):
        out[:, p] += np.frombuffer(g.as_buffer(), "<f8").reshape(columns, -1)
    return out


def _sums(blocks: Blocks, packages: DataFrame, columns: int) -> DataFrame:
    """(slice, g): the packages' sums by slice.  Written."""
    def run(packages: pa.Table) -> pa.Table:
        return pa.table([packages["slice"].slice(0, 1), pa.array([_bytes(_package_sum(packages, columns))], pa.binary())], names=["slice", "g"])
    return stored_by(packages.groupBy("slice").applyInArrow(run, "slice long, g binary"), "sums", "slice", blocks.buckets)


def _literals(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _listed(name: str, ids: list, h: np.ndarray) -> pa.Table:
    offsets = pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32())
    return pa.table([pa.array(ids, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(h.ravel()))], names=["id", name])


def dots(blocks: Blocks, numbers: DataFrame, columns: int) -> DataFrame:
    """(id, dot): the product of every row's vector with each column of the table (feat, w).  Written."""
    def dense(own: pa.Table) -> np.ndarray:
        out = np.zeros((columns, SLICE))
        out[:, own["idx"].to_numpy()] = _plain(own["w"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns).T
        return out
    by_slice = numbers.select(F.floor(F.col("feat") / SLICE).cast("long").alias("slice"), F.pmod("feat", F.lit(SLICE)).cast("long").alias("idx"), "w")

    def give(d: dict, sent: pa.Table) -> pa.Table:
        block = _block(d, sent, columns)
        return _listed("dot", block.ids, block.dot())
    with shuffles_dropped(blocks.table.sparkSession):
        return stored(_at_blocks(blocks, _replies(blocks, by_slice, columns, dense), give, "id string, dot array<double>"), "dots")


# TRN03 on sparse vectors -------------------------------------------------------------
STATE_BY_SLICE = "slice long, s binary, g binary"


@dataclass
class _Step:
    """An epoch of the columns (a setting, a fold).  A slice's state is (3 x columns x features): weights and Adam's two moments.
    ``on``: columns whose weights the pass is at; the others have ended, what the state goes on to be for them is not read.
    ``held``: columns that the pass before improved."""
    epoch: int
    n: np.ndarray
    lr: np.ndarray
    decay: np.ndarray
    on: np.ndarray
    held: np.ndarray
    final: bool  # no further epoch: no gradient is asked for

    def after(self, old: pa.Table, sums: np.ndarray) -> np.ndarray:
        w, m, v = np.frombuffer(old["s"][0].as_py(), "<f8").reshape(3, len(sums), -1) if old.num_rows else np.zeros((3, *sums.shape))
        g = sums / self.n[:, None] + self.decay[:, None] * w
        m, v = B1 * m + (1 - B1) * g, B2 * v + (1 - B2) * g * g
        return np.stack([w - self.lr[:, None] * (m / (1 - B1 ** (self.epoch + 1))) / (np.sqrt(v / (1 - B2 ** (self.epoch + 1))) + EPS), m, v])


def _head_pass(blocks: Blocks, state: DataFrame | None, step: _Step, bias: np.ndarray, folds: list) -> tuple[DataFrame, np.ndarray]:
    """The state after a pass, and (bias gradient, loss, hits, rows of training; loss, hits, rows of validation).  Without a
    state the weights are 0.  State rows: by slice, the weights and moments after the pass's gradients; under -2 - block
    the rows' scores, (g) the last and (s) the best before these."""
    count, none = len(folds), blocks.table.sparkSession.createDataFrame([], STATE_BY_SLICE)

    def give(d: dict, sent: pa.Table) -> pa.Table:
        block = _block(d, sent, count)
        h = block.dot() + bias
        p, loss, hit = losses_at(h, block.y[:, None])
        known = np.array([q is not None for q in block.part])[:, None]
        va = np.stack([block.part == ("validation" if f is None else str(f)) for f in folds], 1)
        tr = np.stack([block.part == "train" if f is None else block.part != str(f) for f in folds], 1) & known
        left = (p - block.y[:, None]) * tr
        extra = [left, loss * tr, hit * tr, tr, loss * va, hit * va, va]
        block.w = block.w[:0]
        return block.packages(None if step.final else block.back(left), {-1: np.stack([e.sum(0) for e in extra]).astype(float), -2 - block.key: h})

    def add(old: pa.Table, packages: pa.Table) -> pa.Table:
        if not packages.num_rows:  # after the final pass weights are not read
            return old.slice(0, 0)
        own, g = packages["slice"][0].as_py(), _package_sum(packages, count)
        s, old_g = b"", old["g"][0].as_py() if old.num_rows else b""
        if own >= 0:
            s, g = _bytes(step.after(old, g)), b""
        elif own < -1:
            last, best = (np.frombuffer(x, "<f8").reshape(-1, count) if x else np.zeros((g.size // count, count)) for x in (
                old_g, old["s"][0].as_py() if old.num_rows else b""))
            s, g = _bytes(np.where(step.held, last, best)), np.where(step.on | (not step.epoch), g.reshape(-1, count), last)
        return pa.table([pa.array([own], pa.int64()), pa.array([s], pa.binary()), pa.array([g if isinstance(g, bytes) else _bytes(g)], pa.binary())],
                        names=["slice", "s", "g"])
    if state is None:
        sent = blocks.table.select(F.col("block").alias("block"), F.lit(-1).cast("long").alias("slice"), *[F.lit(None).cast("binary").alias(n) for n in "wz"])
    else:
        sent = _replies(blocks, state.where("slice >= 0"), count, lambda own: np.frombuffer(own["s"][0].as_py(), "<f8").reshape(3, count, -1)[0])
    packages = _at_blocks(blocks, sent, give, PACKAGES)
    out = stored_by((none if state is None else state).groupBy("slice").cogroup(packages.groupBy("slice")).applyInArrow(add, STATE_BY_SLICE),
                    "heads", "slice", blocks.buckets)
    more = out.where("slice = -1").select("g").collect()  # one row
    return out, np.frombuffer(more[0]["g"], "<f8").reshape(7, count)


def train(blocks: Blocks, settings: list, epochs: int, col_runs: list[int], col_folds: list) -> tuple[list, DataFrame, np.ndarray]:
    """Full-batch Adam (as ``train.train_heads``) for the columns (a setting, a fold or None for splits), the state a table
    by slice; early stopping per column.  A feature that no row has keeps weight 0 and has no state.  The best weights are
    not kept, only the rows' scores at them.  Returns (metrics, state, columns whose last scores are the best)."""
    count = len(col_runs)
    mine = [settings[r] for r in col_runs]
    lr, decay = np.array([s.lr for s in mine]), np.array([s.weight_decay for s in mine])
    bias = {n: np.zeros(count) for n in ("w", "m", "v")}
    limit = np.array([s.epochs or epochs for s in mine])
    active, best, bad, rows = limit > 0, np.full(count, math.inf), np.zeros(count, int), []
    improved, most = np.zeros(count, bool), int(limit.max(initial=0))
    parts = {r["part"]: r["n"] for r in blocks.table.select(F.explode("part").alias("part")).where("part is not null").groupBy("part").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per fold
    n = np.maximum([parts.get("train", 0) if f is None else sum(parts.values()) - parts.get(str(f), 0) for f in col_folds], 1)
    state, extra = _head_pass(blocks, None, _Step(0, n, lr, decay, active, improved, not most), bias["w"], col_folds)
    for ep in range(1, most + 1):
        active &= ep <= limit
        if not active.any():
            break
        g = extra[0] / n + decay * bias["w"]
        m, v = B1 * bias["m"] + (1 - B1) * g, B2 * bias["v"] + (1 - B2) * g * g
        w = bias["w"] - lr * (m / (1 - B1 ** ep)) / (np.sqrt(v / (1 - B2 ** ep)) + EPS)
        for name, new in (("m", m), ("v", v), ("w", w)):
            bias[name] = np.where(active, new, bias[name])
        before, old = extra, state
        state, extra = _head_pass(blocks, old, _Step(ep, n, lr, decay, active.copy(), improved, ep == most), bias["w"], col_folds)
        drop_stored(old)
        with np.errstate(invalid="ignore", divide="ignore"):
            eval_loss, eval_hit = extra[4] / extra[6], extra[5] / extra[6]
        improved = np.zeros(count, bool)
        for c in np.flatnonzero(active):
            s = mine[c]
            rows.append((s.run_id, None if col_folds[c] is None else int(col_folds[c]), ep, float(before[1][c] / n[c]), float(before[2][c] / n[c]),
                         float(eval_loss[c]), float(eval_hit[c])))
            improved[c] = eval_loss[c] + s.min_delta < best[c]
            best[c], bad[c] = (eval_loss[c], 0) if improved[c] else (best[c], bad[c] + 1)
            active[c] = not (s.patience > 0 and bad[c] >= s.patience)
    return rows, state, improved


def _head_scores(blocks: Blocks, state: DataFrame, improved: np.ndarray, use_best: bool) -> DataFrame:
    """(id, h): every row's scores at the best or the last weights of each column.  Written."""
    count = len(improved)

    def give(d: dict, sent: pa.Table) -> pa.Table:
        last, best = (np.frombuffer(sent[n][0].as_py(), "<f8").reshape(-1, count) for n in "gs")
        return _listed("h", d["ids"].as_py(), np.where(improved, last, best) if use_best else last)
    mine = state.where("slice < -1").select((-2 - F.col("slice")).alias("block"), "s", "g")
    with shuffles_dropped(blocks.table.sparkSession):
        return stored(_at_blocks(blocks, mine, give, "id string, h array<double>"), "scores")


def kfold_heads(vectors: DataFrame, features: DataFrame, id_col: str, fold_col: str, settings: list, label: str = "persuaded", epochs: int = 30,
                use_best: bool = True, spent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``train.kfold_heads`` on sparse vectors (id, idx, val, fold, label): out-of-fold scores (run_id, id, fold, label, p1,
    pred), one row per row and setting, and the epochs' metrics first.  Rows without a label or fold are left out.
    ``features`` (feat_idx) may name more than the rows have: their weights stay 0.
    ``spent``: a stored table that only ``vectors`` read, deleted when they lie in blocks."""
    from suasion.operators.train import METRICS_SCHEMA, fold_values
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(label).isNotNull() & F.col(fold_col).isNotNull()).select(
        F.col(id_col), "idx", "val", F.col(fold_col).cast("int").alias("_fold"), F.col(label).cast("double").alias("_label"))
    with shuffles_dropped(spark):
        blocks = pack(rows, id_col, F.col("_label"), F.col("_fold"))
        rows = stored(blocks.table.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("part").cast("array<int>").alias("fold"),
                                                                F.col("y").cast("array<int>").alias("label")))), "sparse-rows")
    if spent is not None:
        drop_stored(spent)
    folds = fold_values(rows, "fold")
    if not folds:
        named = rows.select(F.lit("").alias("run_id"), F.col("id").alias(id_col), F.col("fold").alias(fold_col), F.col("label").alias(label),
                            F.lit(0.0).alias("p1"), F.lit(0).alias("pred"))
        return spark.createDataFrame([], METRICS_SCHEMA), named
    col_runs, col_folds = [r for r in range(len(settings)) for _ in folds], [f for _ in settings for f in folds]
    metrics, state, improved = train(blocks, settings, epochs, col_runs, [int(f) for f in col_folds])
    found = _head_scores(blocks, state, improved, use_best)
    drop_stored(state)
    blocks.drop()
    known = found.join(rows, "id")
    place = F.array_position(F.array(*[F.lit(int(f)) for f in folds]), F.col("fold")).cast("int") - 1
    per_run = F.array(*[F.struct(F.lit(s.run_id).alias("run_id"), F.col("h")[place + r * len(folds)].alias("h"))
                        for r, s in enumerate(settings)])
    scored = known.select("id", "fold", "label", F.inline(per_run))
    out = scored.select("run_id", F.col("id").alias(id_col), F.col("fold").alias(fold_col), F.col("label").alias(label),
                        (1.0 / (1.0 + F.exp(-2.0 * F.col("h")))).alias("p1"), (F.col("h") > 0).cast("int").alias("pred"))
    return rows.sparkSession.createDataFrame(metrics, METRICS_SCHEMA), out


# FEA04 of wide or sparse tables ---------------------------------------------------------
@dataclass
class Components:
    loadings: DataFrame  # (feat, v array<double>)
    means: np.ndarray  # the mean row's coordinates, taken off the scores
    variances: np.ndarray
    rounds: int


STATE = "block long, q binary, z binary"
MOST_BLOCKS = 8  # a basis of more blocks of columns starts again from its best directions


def _matrix(cell, rows: int) -> np.ndarray:
    return np.frombuffer(cell.as_py(), "<f8").reshape(rows, -1)


def _state_row(block: int, q: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([block], pa.int64())] + [pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary()) for x in (q, z)]
    return pa.RecordBatch.from_arrays(cells, ["block", "q", "z"])


def _summed(state: DataFrame, width: int, give: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], shapes: list[tuple]) -> list[np.ndarray]:
    """Matrices that ``give`` makes of a block's (q, z), added up over the blocks: one small aggregate."""
    def run(batches):
        total = None
        for batch in batches:
            for d in _rows_of(batch):
                q = np.frombuffer(d["q"].as_py(), "<f8").reshape(-1, width)
                flat = np.concatenate([x.ravel() for x in give(q, _matrix(d["z"], len(q)))])
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "v"])
    with shuffles_dropped(state.sparkSession):
        got = state.mapInArrow(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    sizes = [math.prod(x) for x in shapes]
    out = np.zeros(sum(sizes))
    out[got["pos"].to_numpy(dtype=np.int64)] = got["v"].to_numpy()
    return [x.reshape(shape) for x, shape in zip(np.split(out, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def _orthonormaliser(gram: np.ndarray) -> np.ndarray:
    """M with M' gram M = 1 on the directions that are there (0 on the others); the columns are scaled first."""
    scale = np.where(np.diag(gram) > 0, 1 / np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1)), 0)
    values, vectors = np.linalg.eigh(gram * scale[:, None] * scale[None, :])
    good = values > 1e-12 * max(values.max(initial=0), 1e-300)
    return scale[:, None] * ((vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T)


@dataclass
class _Turn:
    """Small matrices that make the next columns of the basis, z a - 1 shift - q b, and what stays of the basis, q keep.
    ``middle`` is the columns' measured mean, which is rounding alone but would grow from round to round."""
    a: np.ndarray
    shift: np.ndarray
    b: np.ndarray
    keep: np.ndarray
    middle: float | np.ndarray = 0.0

    def fresh(self, q: np.ndarray, z: np.ndarray) -> np.ndarray:
        return z @ self.a - self.shift - q @ self.b - self.middle


def _times_gram(blocks: Blocks, state: DataFrame, turn: _Turn) -> DataFrame:
    """The state with the next columns q of the basis and z = X X' q: X' q is added up by slice and written, then sent back."""
    width = turn.a.shape[1]

    def out(d: dict, own: pa.Table) -> pa.Table:
        block = _block(d)
        return block.packages(block.back(turn.fresh(*(_matrix(own[c][0], len(block.ids)) for c in ("q", "z")))))

    def back(d: dict, sent: pa.Table) -> pa.Table:
        block = _block(d, sent, width)
        mine = sent["slice"].to_pylist().index(-1)
        q, z = (_matrix(sent[c][mine], len(block.ids)) for c in ("w", "z"))
        return pa.Table.from_batches([_state_row(block.key, np.hstack([q @ turn.keep, turn.fresh(q, z)]), np.hstack([z @ turn.keep, block.dot()]))])
    sums = _sums(blocks, _at_blocks(blocks, state, out, PACKAGES), width)
    replies = _replies(blocks, sums, width, lambda own: np.frombuffer(own["g"][0].as_py(), "<f8").reshape(width, -1))
    own = state.select("block", F.lit(-1).cast("long").alias("slice"), F.col("q").alias("w"), "z")
    new = stored_by(_at_blocks(blocks, replies.unionByName(own), back, STATE), "subspace", "block", blocks.buckets)
    drop_stored(sums)
    return new


def principal_components(blocks: Blocks, features: DataFrame, k: int = 3, spare: int = 13, tolerance: float = 1e-9, most_rounds: int = 200,
                         seed: int = 42) -> Components:
    """The first ``k`` principal components of sparse rows, by a block Krylov space of the centred rows' products.

    The basis has a number per row, not per feature, and lies by block.  A round multiplies its last ``k`` columns by X X'
    (one pass), turns the whole basis to the best directions (Rayleigh-Ritz on small matrices; the mean is taken off in
    them, no cell is filled) and adds the first k directions' residuals as the next columns.  A basis of more than
    ``MOST_BLOCKS`` x (k + spare) columns starts again from its best 2 (k + spare).  It ends when the residuals are below
    ``tolerance`` of the largest eigenvalue.  Each loading's largest entry is positive (ties: the first feature's)."""
    wide = features.select(F.col("feat_idx").alias("feat"))
    width = k = min(k, wide.count())
    if not k:
        return Components(wide.select("feat", F.array().cast("array<double>").alias("v")), np.zeros(0), np.zeros(0), 0)
    spark, most, again = wide.sparkSession, MOST_BLOCKS * (k + spare), 2 * (k + spare)

    def start(batches):
        key = mix(mix(np.array([seed % (1 << 64)], np.uint64)) ^ np.arange(width, dtype=np.uint64))
        for batch in batches:
            for d in _rows_of(batch):
                ids = pd.util.hash_array(np.array([i or "" for i in d["ids"].as_py()], dtype=object), categorize=False)
                drawn = (mix(ids[:, None] ^ key) >> np.uint64(11)) * 2.0 ** -52 - 1.0
                yield _state_row(d["block"].as_py(), np.zeros_like(drawn), drawn)
    state = stored_by(blocks.table.select("block", "ids").mapInArrow(start, STATE), "subspace", "block", blocks.buckets)
    n = max(1, blocks.n_rows)
    gram, total = _summed(state, width, lambda q, z: [z.T @ z, z.sum(0)], [(width, width), (width,)])
    mean = total / n
    a = _orthonormaliser(gram - n * np.outer(mean, mean))
    turn, m = _Turn(a, mean @ a, np.zeros((width, width)), np.zeros((width, 0))), width
    for rounds in range(1, most_rounds + 1):
        turn.middle = _summed(state, len(turn.b), lambda q, z, turn=turn: [turn.fresh(q, z).sum(0)], [(width,)])[0] / n
        before, state = state, _times_gram(blocks, state, turn)
        drop_stored(before)
        gram, cross, total = _summed(state, m, lambda q, z: [q.T @ q, q.T @ z, z.sum(0)], [(m, m), (m, m), (m,)])
        straight = _orthonormaliser(gram)
        values, u = np.linalg.eigh(straight.T @ ((cross + cross.T) / 2) @ straight)
        values, u, mean = values[::-1], straight @ u[:, ::-1], total / n
        best, lift = u[:, :width], u[:, :width] * values[:width]
        shift = mean @ best

        def left(q, z, best=best, lift=lift, shift=shift):
            r = z @ best - shift - q @ lift
            return [r.T @ r, q.T @ r]
        rest, along = _summed(state, m, left, [(width, width), (m, width)])
        size = np.sqrt(np.diag(rest))
        if (size[:k] <= tolerance * max(values[0], 1e-300)).all():
            break
        open_ = size > 1e-13 * values[0]  # the others are rounding
        next_ = _orthonormaliser((rest - along.T @ along) * open_[:, None] * open_)
        keep = np.eye(m) if m + width <= most else u[:, :again]
        turn, m = _Turn(best @ next_, shift @ next_, (lift + along) @ next_, keep), keep.shape[1] + width
    top, there = u[:, :k], values[:k] > 1e-13 * max(values[0], 1e-300)

    def across(d: dict, own: pa.Table) -> pa.Table:
        block = _block(d)
        q, _ = (_matrix(own[c][0], len(block.ids)) for c in ("q", "z"))
        return block.packages(block.back(np.hstack([q @ top, np.ones((len(block.ids), 1))])))

    def by_feature(batches):
        for batch in batches:
            for d in _rows_of(batch):
                g = np.frombuffer(d["g"].as_py(), "<f8").reshape(k + 1, -1)
                feats = d["slice"].as_py() * SLICE + np.arange(g.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(feats, pa.int64()), *[pa.array(x) for x in g]], ["_feat", *[f"g{j}" for j in range(k + 1)]])
    sums = _sums(blocks, _at_blocks(blocks, state, across, PACKAGES), k + 1)
    numbers = sums.mapInArrow(by_feature, ", ".join(["_feat long", *[f"g{j} double" for j in range(k + 1)]]))
    with shuffles_dropped(spark):
        raw = stored(wide.join(numbers, F.col("feat") == F.col("_feat"), "left").select("feat", *[
            F.coalesce(F.col(f"g{j}"), F.lit(0.0)).alias(f"v{j}") for j in range(k + 1)]), "loadings")
    largest = raw.agg(*[F.max_by(f"v{j}", F.struct(F.abs(f"v{j}"), -F.col("feat"))).alias(f"l{j}") for j in range(k)],
                      *[F.sum(F.col(f"v{j}") * F.col(f"v{j}")).alias(f"s{j}") for j in range(k)],
                      *[F.sum(F.col(f"v{k}") * F.col(f"v{j}")).alias(f"m{j}") for j in range(k)]).first()
    norm = np.sqrt(np.array([largest[k + j] or 0.0 for j in range(k)]))
    scale = np.where(there & (norm > 0), np.where(np.array([largest[j] or 0.0 for j in range(k)]) < 0, -1.0, 1.0) / np.where(norm > 0, norm, 1), 0.0)
    means = scale * np.array([largest[2 * k + j] or 0.0 for j in range(k)]) / n
    fixed = raw.select("feat", F.array(*[F.col(f"v{j}") * F.lit(float(scale[j])) for j in range(k)]).alias("v"))
    drop_stored(state, sums)
    return Components(fixed, means, np.maximum(values[:k], 0) / max(1, blocks.n_rows - 1), rounds)


def pca_scores(blocks: Blocks, found: Components, places: int = 8) -> DataFrame:
    """(id, features): the rows' coordinates along the components, rounded half to even."""
    means = _literals(found.means)
    return dots(blocks, found.loadings.select("feat", F.col("v").alias("w")), len(found.means)).select(
        "id", F.transform("dot", lambda x, j: F.bround(x - means[j], places)).alias("features"))


def pca_reduce(df: DataFrame, n_components: int = 3, group_id: str = "group_id", feat: str = "feat", value: str = "value",
               prefix: str = "dim_feat_") -> DataFrame:
    """FEA04 of a long table of any width: missing cells are 0, nothing dense, no width x width matrix."""
    vectors, dictionary = long_to_sparse(df, group_id=group_id, feat=feat, value=value)
    blocks = pack(vectors, group_id)
    drop_stored(vectors)
    features = dictionary.select("feat_idx")
    scores = pca_scores(blocks, principal_components(blocks, features, n_components))
    blocks.drop()
    return vector_to_long(scores.withColumnRenamed("id", group_id), group_id=group_id, prefix=prefix)
