"""Operator 10 — document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each phrase is the longest one known so far plus
one more character, and becomes known (LZ78, as in Lempel-Ziv Jaccard distance).  The set
of phrases is hashed and sketched by one-permutation minimum hashing: BUCKETS buckets, the
16-bit minimum of each.  The likeness of two fingerprints is the share of equal buckets
among those filled in either, an estimate of the phrase sets' Jaccard similarity; texts
that compress alike share phrases.

``edited_likeness`` also fingerprints each text with its last quarter replaced by the
beginning of the next document in ascending id order.  The parse of the first three
quarters serves both texts.  "Next" comes from one range partitioning of the compressed
texts; the last document of a partition meets the first of the following one in a small
second step (one row per partition).

Cases: null text is empty; an empty text has the empty fingerprint, likeness 1 to another
empty text and 0 to any other; null ids sort first, rows with one id are ordered by their
texts' hashes; a table of one row has itself as next document; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm.shared import partitions, texts_of, written

BUCKETS = 128
EMPTY = 0xFFFF
GROUP_CHARS = 2 << 20
_MASK = (1 << 64) - 1
ROWS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double")
STAGED = ROWS + ", part int, first_text binary, last_text binary"


def _walk(chars: str, root: dict, node: dict, hashes: list, added: list | None = None) -> dict:
    """Go on parsing at ``node``; a new phrase's hash (from its parent's) is appended."""
    for ch in chars:
        known = node.get(ch)
        if known is None:
            h = (node[None] * 0x9E3779B97F4A7C15 + ord(ch) + 1) & _MASK
            node[ch] = {None: h}
            hashes.append(h)
            if added is not None:
                added.append((node, ch))
            node = root
        else:
            node = known
    return node


def phrases(text: str, edit: str | None = None) -> tuple[list[int], list[int]]:
    """Phrase hashes of the text, and of the text whose last quarter is replaced by ``edit``'s beginning."""
    root: dict = {None: 1}
    quarter = len(text) // 4
    own: list[int] = []
    if edit is None:
        _walk(text, root, root, own)
        return own, []
    cut = len(text) - quarter
    node = _walk(text[:cut], root, root, own)
    edited, added = own.copy(), []
    _walk(text[cut:], root, node, own, added)
    for parent, ch in reversed(added):
        del parent[ch]
    _walk(edit[:quarter], root, node, edited)
    return own, edited


def signatures(hash_lists: list[list[int]]) -> np.ndarray:
    """One row of BUCKETS 16-bit minima per list."""
    n = np.fromiter(map(len, hash_lists), np.int64, len(hash_lists))
    x = np.concatenate([np.array(h, np.uint64) for h in hash_lists]) if n.sum() else np.zeros(0, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bucket = (x % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS * np.repeat(np.arange(len(n)), n)
    out = np.full(len(n) * BUCKETS, EMPTY, np.uint16)
    np.minimum.at(out, bucket, np.minimum(x >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16))
    return out.reshape(-1, BUCKETS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: equal buckets over buckets filled in either (1 where both are empty)."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def _rows(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
    """Result rows of consecutive documents; ``after`` is the text that follows the last one."""
    nexts = [*texts[1:], after]
    parsed = [phrases(t, e) for t, e in zip(texts, nexts, strict=True)]
    own = signatures([p[0] for p in parsed] + [phrases(after)[0]])
    edited = signatures([p[1] for p in parsed])
    sha = [hashlib.sha256((t[:len(t) - len(t) // 4] + e[:len(t) // 4]).encode()).hexdigest()
           for t, e in zip(texts, nexts, strict=True)]
    raw = [r.astype("<u2").tobytes() for r in own[:-1]], [r.astype("<u2").tobytes() for r in edited]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha),
         pa.array(raw[0], pa.binary()), pa.array(raw[1], pa.binary()),
         pa.array(likeness(own[:-1], edited)), pa.array(likeness(own[:-1], own[1:]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _with_edge(rows: pa.RecordBatch | None, edge: tuple | None) -> pa.RecordBatch:
    """Add the columns of a partition's edge: empty for ready rows, alone in the edge row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    if edge is None:
        n = rows.num_rows
        more = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        cols = rows.columns
    else:
        doc_id, part, first, last = edge
        cols = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:])]
        more = [pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())]
    return pa.RecordBatch.from_arrays([*cols, *more], [*names, "part", "first_text", "last_text"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each document alone: no order, no shuffle."""
    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            sig = signatures([phrases(t)[0] for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([r.astype("<u2").tobytes() for r in sig], pa.binary())],
                                             ["doc_id", "n_chars", "fingerprint"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, n_chars long, fingerprint binary")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROWS: fingerprints of every text and its edited text, and their likenesses."""
    import zstandard
    spark = docs.sparkSession

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([z.compress(t.encode()) for t in texts_of(b.column(2))], pa.binary())],
                ["doc_id", "tie", "packed"])
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"),
                         F.col(text_col).alias("text")).mapInArrow(pack, "doc_id long, tie long, packed binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = packed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "packed")

    def run(batches):
        z, pack_z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        ids, texts, held, first = [], [], 0, None
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = z.decompress(raw).decode() if raw else ""
                if first is None:
                    first = raw
                if held >= GROUP_CHARS:
                    yield _with_edge(_rows(ids, texts, text), None)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            if len(ids) > 1:
                yield _with_edge(_rows(ids[:-1], texts[:-1], texts[-1]), None)
            yield _with_edge(None, (ids[-1], TaskContext.get().partitionId(), first, pack_z.compress(texts[-1].encode())))
    staged = written(ranged.mapInArrow(run, STAGED), "lz-fingerprints")
    edges = staged.where("part is not null").select("doc_id", "part", "first_text", "last_text")
    parts = sorted(r["part"] for r in edges.select("part").collect())  # partition numbers
    follow = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, follows int")
    met = edges.select("doc_id", "part", "last_text").join(follow, "part").join(
        edges.select(F.col("part").alias("follows"), "first_text"), "follows").select("doc_id", "last_text", "first_text")

    def finish(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                a, n = (z.decompress(r[c]).decode() if r[c] else "" for c in ("last_text", "first_text"))
                yield _rows([r["doc_id"]], [a], n)
    ready = staged.where("part is null").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                "near_edited", "near_next")
    return ready.unionByName(met.repartition(max(1, len(parts))).mapInArrow(finish, ROWS))
