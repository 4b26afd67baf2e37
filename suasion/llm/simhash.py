"""Operator 6 — SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank (the inverse Gray code), so neighbours differ in few
bits.  A block of the order is a tree: groups of 16 neighbours at the bottom, four nodes
under each upper node; a node keeps the bits that all below it share (a mask and their
pattern).  A search walks two trees at once: where the shared bits of both nodes already
differ in more than the allowed number, the whole pair of groups is pruned; differences
that upper nodes have counted stay part of the lower nodes' masks.  The blocks' own masks
are the topmost level: only pairs of blocks that may hold a link meet (one row per block
on the driver, at most MAX_BLOCKS).  Inside a pair of blocks links go into a union-find,
and pairs of groups that are one class already are pruned too, so a group of many near
copies gives a spanning star, never all pairs.

Exact copies are one fingerprint before any search.  Cases: null and blank texts have
fingerprint zero, linked like any other; a null doc_id takes part, and a component of
null ids alone has a null component id; repeated rows each give a row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm.components import components
from suasion.llm.shared import drop_written, partitions, written

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BLOCK, MAX_BLOCKS, LEAF, FAN = 1 << 14, 4096, 16, 4
PAIRS_AT_ONCE = 1 << 14
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, as a signed number."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        ones, n = np.unpackbits(np.array(hashes, "<u8").view(np.uint8)).astype(np.int64), 1
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.r_[0, ends[:-1] + 1].tolist()
        last = ends[shingle - 1:].tolist()
        digest, n = xxhash.xxh64_intdigest, len(last)
        ones = np.zeros(64, np.int64)
        for a in range(0, n, 1 << 16):
            h = np.fromiter((digest(flat[x:y], SEED) for x, y in zip(first[a:a + (1 << 16)], last[a:a + (1 << 16)])),
                            np.uint64, min(1 << 16, n - a))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp)."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid and t.as_buffer() is not None else b"", shingle)
                   for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit pattern in Gray order, shifted so that signed order is unsigned order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Tree over fingerprints in Gray order: per level the bits set in all, and in any, below a node."""

    def __init__(self, fps: np.ndarray, height: int):
        self.leaves = _padded(fps, LEAF)
        low, high = np.bitwise_and.reduce(self.leaves, 1), np.bitwise_or.reduce(self.leaves, 1)
        self.levels = [(low, ~(low ^ high))]
        for _ in range(height):
            low, high = _padded(low, FAN), _padded(high, FAN)
            low, high = np.bitwise_and.reduce(low, 1), np.bitwise_or.reduce(high, 1)
            self.levels.append((low, ~(low ^ high)))


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([x, np.repeat(x[-1:], -len(x) % width)]).reshape(-1, width)


def height_for(n: int) -> int:
    height, nodes = 0, -(-n // LEAF)
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // FAN)
    return height


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def linked(a: np.ndarray, b: np.ndarray, same: bool, max_bits: int = MAX_BITS) -> np.ndarray:
    """Class label (smallest index) of the fingerprints a ++ b (a alone if ``same``), both in Gray order,
    by all links between a and b."""
    height = height_for(max(len(a), len(b)))
    ta = GrayIndex(a, height)
    tb = ta if same else GrayIndex(b, height)
    base = 0 if same else len(a)
    label = np.arange(base + len(b))
    idx_a = np.minimum(np.arange(ta.leaves.size), len(a) - 1).reshape(ta.leaves.shape)
    idx_b = np.minimum(np.arange(tb.leaves.size), len(b) - 1).reshape(tb.leaves.shape) + base
    work = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    fan = np.arange(FAN)
    while work:
        level, pa_, pb_ = work.pop()
        if len(pa_) > PAIRS_AT_ONCE:
            half = len(pa_) // 2
            work += [(level, pa_[half:], pb_[half:]), (level, pa_[:half], pb_[:half])]
            continue
        (low_a, com_a), (low_b, com_b) = ta.levels[level], tb.levels[level]
        near = np.bitwise_count((low_a[pa_] ^ low_b[pb_]) & com_a[pa_] & com_b[pb_]) <= max_bits
        pa_, pb_ = pa_[near], pb_[near]
        if not len(pa_):
            continue
        if level:
            na, nb = len(ta.levels[level - 1][0]), len(tb.levels[level - 1][0])
            ca = (pa_[:, None, None] * FAN + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
            cb = (pb_[:, None, None] * FAN + fan[None, None, :] + 0 * fan[None, :, None]).ravel()
            ok = (ca < na) & (cb < nb)
            if same:
                ok &= ca <= cb
            work.append((level - 1, ca[ok], cb[ok]))
            continue
        one_a, one_b = label[idx_a], label[idx_b]
        la, lb = one_a.min(1), one_b.min(1)
        whole = (la == one_a.max(1))[pa_] & (lb == one_b.max(1))[pb_] & (la[pa_] == lb[pb_])
        pa_, pb_ = pa_[~whole], pb_[~whole]
        for k in range(0, len(pa_), PAIRS_AT_ONCE // 4):
            qa, qb = pa_[k:k + PAIRS_AT_ONCE // 4], pb_[k:k + PAIRS_AT_ONCE // 4]
            p, i, j = np.nonzero(np.bitwise_count(ta.leaves[qa][:, :, None] ^ tb.leaves[qb][:, None, :]) <= max_bits)
            if len(p):
                label = _unite(label, idx_a[qa[p], i], idx_b[qb[p], j])
    return label


def _blocks(fps: DataFrame, n: int) -> DataFrame:
    """(block, low, high, fps): consecutive stretches of Gray order with the bits set in all and in any."""
    count = max(1, min(MAX_BLOCKS, -(-n // BLOCK)))
    size = -(-n // count) * 2
    ranged = fps.select("fp").repartitionByRange(count, gray_rank(F.col("fp"))).coalesce(count)

    def pack(batches):
        from pyspark import TaskContext
        got = [np.asarray(b.column(0)) for b in batches]
        if not got or not sum(map(len, got)):
            return
        x = np.concatenate(got)
        rank = x.view(np.uint64).copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        x = x[np.argsort(rank)]
        for k, a in enumerate(range(0, len(x), size)):
            part = x[a:a + size]
            yield pa.RecordBatch.from_pydict({
                "block": [TaskContext.get().partitionId() << 24 | k], "low": [int(np.bitwise_and.reduce(part))],
                "high": [int(np.bitwise_or.reduce(part))], "fps": [part.astype("<i8").tobytes()]})
    return written(ranged.mapInArrow(pack, "block long, low long, high long, fps binary"), "gray-blocks")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``fp`` at up to ``max_bits`` differing bits.  Written."""
    spark = fps.sparkSession
    blocks = _blocks(fps, fps.count())
    top = sorted(tuple(r) for r in blocks.select("block", "low", "high").collect())  # bounded by MAX_BLOCKS (and its splits)
    ids = np.array([t[0] for t in top], np.int64)
    low, high = (np.array([t[k] for t in top], np.int64).view(np.uint64) for k in (1, 2))
    common = ~(low ^ high)
    pairs = []
    for i in range(len(ids)):
        near = np.bitwise_count((low[i] ^ low[i:]) & common[i] & common[i:]) <= max_bits
        pairs += [(int(ids[i]), int(j)) for j in ids[i:][near]]
    want = spark.createDataFrame(pairs or [], "i long, j long")
    a = blocks.select(F.col("block").alias("i"), F.col("fps").alias("a"))
    b = blocks.select(F.col("block").alias("j"), F.col("fps").alias("b"))

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u8")  # unsigned: bit counts
                same = r["i"] == r["j"]
                label = linked(x, y, same, max_bits)
                both = x if same else np.concatenate([x, y])
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(both[moved].view(np.int64)), pa.array(both[label[moved]].view(np.int64))], ["u", "v"])
    met = want.join(a, "i").join(b, "j").repartition(max(partitions(spark), min(len(pairs), 4 * partitions(spark))))
    found = written(met.mapInArrow(search, "u long, v long"), "links")
    drop_written(blocks)
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): the smallest doc_id reachable over links, itself
    included; ``root`` names the component even where document ids repeat."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    linked_pairs = links(classes, max_bits)
    parts = components(linked_pairs)
    rooted = written(classes.join(parts, F.col("fp") == F.col("node"), "left")
                     .select("fp", "rep", F.coalesce("component", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = written(rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "component-of")
    drop_written(classes, linked_pairs, rooted)
    return fps.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component (its smallest doc_id), all columns as they came.  Only rows whose
    id and text occur more than once are told apart by a shuffle of their own; the others meet the kept
    ids in one join."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("fp"), F.col("text_hash"))
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    times = found.groupBy("root", order.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = written(times.groupBy("root").agg(F.min(F.struct("k", "n")).alias("m"))
                   .select(F.col("m.k.doc_id").alias("__id"), F.col("m.k.text_hash").alias("__hash"), (F.col("m.n") > 1).alias("__repeated"))
                   .distinct(), "kept")
    keyed = docs.withColumns({"__key": F.col(id_col).cast("long"), "__th": F.xxhash64(text_col)})

    def of(wanted: DataFrame) -> DataFrame:
        return keyed.join(wanted, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hash")), "left_semi")
    out = of(kept.where("not __repeated")).select(*docs.columns)
    repeated = kept.where("__repeated")
    if repeated.isEmpty():
        return out
    return out.unionByName(of(repeated).dropDuplicates(["__key", "__th"]).select(*docs.columns))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
