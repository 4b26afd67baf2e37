"""Operator 3 — byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its share of the corpus block by block.  The distinct words of a block are
laid end to end as one array of byte symbols; an inverted index from merge rank (the
token a pair makes) to word positions is built from all neighbouring pairs at once, and
the merges are replayed in rank order: each rank's positions from left to right, touching
only the two neighbours of a merged place.  A pair that comes up with a LOWER rank than
the current one is replayed before the current rank goes on, so every word ends as the
rule "merge the lowest rank first, leftmost first" says.  A word that is a token as a whole
needs no merges.  Documents are put together from
their words' ids by array gathers, so nothing is shuffled and a word that fills a third
of all rows is merged once per block.

Cases: null text is empty (no ids, empty bytes); any other text, however long, is encoded
whole (blocks hold about 4M characters, a longer text is cut only between words); repeated
rows and ids each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm.chunks import ChunkTable, gather, grouped, pieces
from suasion.llm.shared import texts_of

# Before a single space between two non-blank characters no match of the pattern runs on.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
DECODED = "doc_id long, n_tokens long, ids binary, decoded binary"
_codecs: dict[str, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Ranks, the pairs that make each token, and the byte strings for decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        for b in range(256):
            self.byte_id[b] = ranks[bytes([b])]
        # (left << 20 | right) -> rank of the joined token, for every way to split a token in two tokens
        self.pair = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items()
                     for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.pair.values(), np.int64, len(keys))[order]
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.tokens, self.rank_of = tokens, ranks
        self.table = ChunkTable(self.encode_chunks)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has: the merge replay."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum())
        if not n:
            return np.zeros(0, np.int64), lens
        sym_a = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lens)
        last = np.zeros(n, bool)
        last[ends[lens > 0] - 1] = True
        # the index: rank -> ascending positions whose symbol and right neighbour make it
        left = np.flatnonzero(~last)
        key = sym_a[left] << 20 | sym_a[left + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        left, rank = left[hit], self.ranks[at[hit]]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
        index = {r: p for r, p in zip(rank[cut].tolist(), (x.tolist() for x in np.split(left, cut[1:])), strict=True)} if len(rank) else {}
        sym = sym_a.tolist()
        nxt = np.where(last, -1, np.arange(1, n + 1)).tolist()
        prv = np.where(np.r_[True, last[:-1]], -1, np.arange(-1, n - 1)).tolist()
        heap = list(index)
        heapq.heapify(heap)
        pair = self.pair
        while heap:
            r = heapq.heappop(heap)
            todo = index.pop(r, None)
            if todo is None:
                continue
            todo.sort()
            for k, i in enumerate(todo):
                s = sym[i]
                j = nxt[i]
                if s < 0 or j < 0 or pair.get(s << 20 | sym[j]) != r:
                    continue  # touched since: another pair stands here now
                sym[i] = r
                sym[j] = -1
                after = nxt[j]
                nxt[i] = after
                low = r
                if after >= 0:
                    prv[after] = i
                    q = pair.get(r << 20 | sym[after])
                    if q is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heapq.heappush(heap, q)
                        low = min(low, q)
                before = prv[i]
                if before >= 0:
                    q = pair.get(sym[before] << 20 | r)
                    if q is not None:
                        if q in index:
                            index[q].append(before)
                        else:
                            index[q] = [before]
                            heapq.heappush(heap, q)
                        low = min(low, q)
                if low < r:  # a lower rank came up: it goes first, then the rest of this rank
                    if k + 1 < len(todo):
                        index.setdefault(r, []).extend(todo[k + 1:])
                        heapq.heappush(heap, r)
                    break
        out = np.asarray(sym, np.int64)
        kept = out >= 0
        total = np.r_[0, np.cumsum(kept)]
        return out[kept], total[ends] - total[ends - lens]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has.  A word that is a token is that token, even
        where the merges would not arrive at it; the others are merged."""
        whole = np.fromiter((self.rank_of.get(w, -1) for w in words), np.int64, len(words))
        rest = whole < 0
        merged, n = self.merged([w for w, r in zip(words, rest.tolist(), strict=True) if r])
        lens = np.ones(len(words), np.int64)
        lens[rest] = n
        out = np.repeat(whole, lens)
        out[np.repeat(rest, lens)] = merged
        return out, lens

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, each distinct match of the pattern merged once."""
        number: dict[str, int] = {}
        seq, counts = [], np.zeros(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            found = self.split(c)
            counts[i] = len(found)
            for w in found:
                seq.append(number.setdefault(w, len(number)))
        ids, lens = self.words([w.encode() for w in number])
        which = np.asarray(seq, np.int64)
        per = lens[which]
        ends = np.r_[0, np.cumsum(per)]
        at = np.r_[0, np.cumsum(counts)]
        return gather(ids, (np.cumsum(lens) - lens)[which], per), ends[at[1:]] - ends[at[:-1]]

    def chunks(self, text: str):
        """Lists of the text's chunks; every chunk but the text's first has its space back."""
        first = True
        for piece in pieces(text, _BREAK):
            parts = _BREAK.split(piece)
            yield [p if first and not k else " " + p for k, p in enumerate(parts)]
            first = False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists, owner = [], []
        for d, t in enumerate(texts):
            if t:
                for c in self.chunks(t):
                    lists.append(c)
                    owner.append(d)
        flat, per = self.table.ids(lists)
        per_doc = np.bincount(np.asarray(owner, np.int64), per, len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per_doc)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(read_ranks(path), pattern)
    return _codecs[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids little-endian unsigned 32-bit."""
    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in grouped(texts):
                ids = c.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])
    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to the rows of ``encode``."""
    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            texts = [c.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())],
                                             ["doc_id", "n_tokens", "ids", "decoded"])
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256).
    The same codec as ``encode`` and ``decode``; ids and bytes never leave the Python worker."""
    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in grouped(texts):
                ids = c.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
