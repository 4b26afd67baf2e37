"""Operator 1 — token-id files: flat unsigned integers plus 64-bit document offsets.

Layout of a token file set (one pair per shard; shards follow each other in ascending
document order):

``shard-00000.bin``  the ids of the shard's documents, end to end, little-endian
                     unsigned, 2 bytes where the vocabulary has at most 65,536 ids, else 4
``shard-00000.idx``  48-byte header (magic, id width, documents, base), then
                     int64[documents + 1] token offsets counted over the WHOLE set,
                     int64[documents] document ids, uint8[documents] 1 where the id isn't null

Both can be memory-mapped.  The writing job knows only its own shard's counts; the base
of a shard is the prefix sum of the token counts of the shards before it (one number per
shard), added to the offsets in a second, idempotent pass over the small ``.idx`` files.

Cases: a null text is an empty document (one end id); null document ids sort first;
rows with one id are ordered by the hash of their text and all stay (an id with many rows
fills several shards); an empty table gives
a set without documents; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.llm.chunks import ChunkTable, grouped, pieces
from suasion.llm.shared import open_store, partitions, texts_of, written
from suasion.session import scratch_path

MAGIC = b"TOKENIDX"
HEADER = "<8sIIqqq8x"
HEADER_SIZE = struct.calcsize(HEADER)
ROWS_PER_BATCH = 2000
_NO_ID = -(1 << 63)  # a null id's place in the order
_SPACE = re.compile("[ \n]")
# Characters whose lower-casing, normal form and class need no Unicode tables: printable
# ASCII and the Latin-1 letters.  Other chunks go through the library unchanged.
_PLAIN = re.compile("[ \n!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \n0-9a-zß-öø-ÿ]+")
_tables: dict[str, tuple[ChunkTable, re.Pattern | None]] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable stand-in for each byte value."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_encoder(path: str):
    """Encode function of a chunk table for the lower-casing word tokenizer at ``path``:
    both ways end in the tokenizers library's BPE."""
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    bare = Tokenizer(whole.model)
    letters = _byte_letters()
    word_end = np.zeros(whole.get_vocab_size() + 1, np.int64)
    word_end[[i for w, i in bare.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = 1

    def encode(chunks: list[str]):
        lens = np.zeros(len(chunks), np.int64)
        marked = np.fromiter((c[:1] == "\n" for c in chunks), bool, len(chunks))
        owner, other = np.flatnonzero(~marked), np.flatnonzero(marked).tolist()
        found = []
        if len(owner):
            words = [c if c.isascii() else c.encode().decode("latin-1").translate(letters)
                     for c in chunks if c[0] != "\n"]
            ids = np.asarray(bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            word = np.cumsum(word_end[ids]) - word_end[ids]  # a word's last id, and no other, is a word-end id
            if int(word_end[ids].sum()) != len(words):
                raise ValueError(f"{path}: words don't end in exactly one word-end id")
            found.append((owner[word], ids))
        if other:
            for i, e in zip(other, whole.encode_batch_fast([chunks[i][1:] for i in other],
                                                           add_special_tokens=False), strict=True):
                found.append((np.full(len(e.ids), i), np.asarray(e.ids, np.uint32)))
        if not found:
            return np.zeros(0, np.uint32), lens
        at = np.concatenate([f[0] for f in found])
        ids = np.concatenate([f[1] for f in found])
        lens = np.bincount(at, minlength=len(chunks))
        return ids[np.argsort(at, kind="stable")], lens
    return encode


def _table(path: str) -> tuple[ChunkTable, re.Pattern | None]:
    """The worker's chunk table of a tokenizer, and a pattern of the tokenizer's added tokens."""
    if path not in _tables:
        from tokenizers import Tokenizer
        added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
        _tables[path] = ChunkTable(word_encoder(path)), re.compile("|".join(map(re.escape, added))) if added else None
    return _tables[path]


def _chunks(piece: str, added: re.Pattern | None) -> list[str]:
    """A piece of plain text as the tokenizer's own words (few distinct ones), else as
    its stretches between white space (the library finds added tokens in them)."""
    if _PLAIN.fullmatch(piece) and not (added and added.search(piece)):
        return _PARTS.findall(piece.lower())
    return ["\n" + c for c in piece.replace("\n", " ").split(" ")]  # a mark that no word holds


ENCODED = "doc_id long, tie long, shard int, n_tokens long, ids binary"


def shard_bounds(docs: DataFrame, shards: int, id_col: str = "doc_id") -> list[int]:
    """``shards - 1`` ascending document ids (null as the smallest) that cut the rows into about equal
    parts, from the id column alone.  An id repeats where it holds several parts."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    cuts = [k / shards for k in range(1, shards)]
    found = docs.agg(F.percentile_approx(key, cuts, 10_000).alias("b")).first()["b"] if cuts else []
    return sorted(found or [])


def shard_of(ids: np.ndarray, ties: np.ndarray, bounds: list[int]) -> np.ndarray:
    """The part of each row.  Rows of an id that fills several parts are dealt over them by their tie, so
    that parts ascend by (id, tie)."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = (ties.astype(np.float64) + 2.0 ** 63) / 2.0 ** 64
    return (low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)).astype(np.int32)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_bytes: int = 2, bounds: list[int] = (),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ENCODED: ids little-endian unsigned, ``id_bytes`` wide, end id included; the text's hash as tie-break;
    the row's shard by ``bounds``."""
    kind = f"<u{id_bytes}"
    bounds = list(bounds)

    def run(batches):
        table, added = _table(tokenizer_path)
        for batch in batches:
            texts = texts_of(batch.column(2))
            shards = shard_of(np.asarray(batch.column(0).fill_null(_NO_ID)), np.asarray(batch.column(1)), bounds)
            ids_out, n_out = [], []
            for a, b in grouped(texts):
                lists, doc_of = [], []
                for d in range(a, b):
                    for p in pieces(texts[d], _SPACE):
                        lists.append(_chunks(p, added))
                        doc_of.append(d - a)
                flat, per_piece = table.ids(lists)
                per_doc = np.bincount(doc_of, per_piece, b - a).astype(np.int64)
                ends = np.cumsum(per_doc)
                for d in range(b - a):
                    own = flat[ends[d] - per_doc[d]:ends[d]]
                    ids_out.append(np.append(own, np.uint32(end_id)).astype(kind).tobytes())
                n_out += (per_doc + 1).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(shards, pa.int32()), pa.array(n_out, pa.int64()), pa.array(ids_out, pa.binary())],
                ["doc_id", "tie", "shard", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"),
                       F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def _save(uri: str, name: str, write) -> None:
    """Write a file beside its place, then put it there in one step (safe to repeat)."""
    fs, root = open_store(uri)
    fs.create_dir(root, recursive=True)
    tmp = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(tmp) as out:
        write(out)
    fs.move(tmp, f"{root}/{name}")


def write_token_files(encoded: DataFrame, uri: str, shards: int, id_bytes: int = 2) -> DataFrame:
    """Write ENCODED rows as a file set in the shared folder ``uri``; returns the manifest
    (shard, documents, tokens, base), one row per shard.  Ids are shuffled once, straight to their shard."""
    spark = encoded.sparkSession
    ranged = encoded.repartitionById(shards, F.col("shard")) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie").asc())

    def write(batches):
        shard = TaskContext.get().partitionId()
        sizes, ids, valid = [], [], []

        def body(out):
            for batch in batches:
                for payload in batch.column(2):
                    out.write(payload.as_buffer())
                sizes.append(np.asarray(batch.column(1)))
                ids.append(np.asarray(batch.column(0).fill_null(0)))
                valid.append(np.asarray(batch.column(0).is_valid()))
        _save(uri, f"shard-{shard:05d}.bin", body)
        n = np.concatenate([np.zeros(1, np.int64), *sizes])
        _save(uri, f"shard-{shard:05d}.idx", lambda out: out.write(
            struct.pack(HEADER, MAGIC, id_bytes, 0, len(n) - 1, 0, 0) + np.cumsum(n).astype("<i8").tobytes()
            + np.concatenate([np.zeros(0, np.int64), *ids]).astype("<i8").tobytes()
            + np.concatenate([np.zeros(0, bool), *valid]).astype("u1").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [len(n) - 1], "tokens": [int(n.sum())]},
                                         schema=pa.schema([("shard", pa.int32()), ("documents", pa.int64()),
                                                           ("tokens", pa.int64())]))

    counts = written(ranged.select("doc_id", "n_tokens", "ids")
                     .mapInArrow(write, "shard int, documents long, tokens long"), "shards")
    rows = sorted(counts.collect())  # one row per shard: bounded by the partition count
    bases = np.cumsum([0, *(r["tokens"] for r in rows)]).tolist()
    shards = spark.createDataFrame([(r["shard"], r["documents"], r["tokens"], b) for r, b in zip(rows, bases, strict=False)],
                                   "shard int, documents long, tokens long, base long")
    shards = shards.repartition(max(1, len(rows)))

    def rebase(batches):
        for batch in batches:
            for r in batch.to_pylist():
                name = f"shard-{r['shard']:05d}.idx"
                fs, root = open_store(uri)
                with fs.open_input_file(f"{root}/{name}") as f:
                    raw = f.read()
                magic, width, zero, n, old, spare = struct.unpack_from(HEADER, raw)
                at = np.frombuffer(raw, "<i8", n + 1, HEADER_SIZE) - old + r["base"]
                tail = raw[HEADER_SIZE + 8 * (n + 1):]
                _save(uri, name, lambda out, h=struct.pack(HEADER, magic, width, zero, n, r["base"], spare), a=at, t=tail:
                      out.write(h + a.astype("<i8").tobytes() + t))
            yield batch
    return written(shards.mapInArrow(rebase, shards.schema), "manifest")


def read_token_files(manifest: DataFrame, uri: str) -> DataFrame:
    """Read a file set back: (doc_id, start, n_tokens, ids), ids as little-endian unsigned 32-bit."""
    def read(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                fs, root = open_store(uri)
                local = fs.type_name == "local"

                def mapped(name):
                    path = f"{root}/shard-{shard:05d}.{name}"
                    if local:
                        return np.memmap(path, np.uint8, "r") if fs.get_file_info(path).size else np.zeros(0, np.uint8)
                    with fs.open_input_file(path) as f:
                        return np.frombuffer(f.read(), np.uint8)
                idx = mapped("idx")
                _, width, _, n, base, _ = struct.unpack(HEADER, idx[:HEADER_SIZE].tobytes())
                tokens = mapped("bin").view(f"<u{width}")
                at = HEADER_SIZE
                off = idx[at:at + 8 * (n + 1)].view("<i8")
                at += 8 * (n + 1)
                ids, valid = idx[at:at + 8 * n].view("<i8"), idx[at + 8 * n:at + 9 * n].view("u1")
                for a in range(0, n, ROWS_PER_BATCH):
                    b = min(n, a + ROWS_PER_BATCH)
                    o = off[a:b + 1] - base
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.asarray(ids[a:b]), pa.int64(), mask=valid[a:b] == 0),
                        pa.array(np.asarray(off[a:b])), pa.array(np.diff(o)),
                        pa.array([tokens[x:y].astype("<u4").tobytes() for x, y in zip(o[:-1], o[1:], strict=True)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])
    shards = manifest.select("shard").repartition(max(1, partitions(manifest.sparkSession)))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int,
                vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Encode, write and return (manifest, folder)."""
    width = 2 if vocabulary <= 1 << 16 else 4
    uri, shards = scratch_path(spark, "token-files"), partitions(spark)
    encoded = encode_documents(docs, tokenizer_path, end_id, width, shard_bounds(docs, shards, id_col), id_col, text_col)
    return write_token_files(encoded, uri, shards, width), uri
