"""Operator 2 — benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the token postings of ALL training documents.  The index is
partitioned by document, as search engines do: a task turns about ``SEGMENT_WORDS`` words
of whole documents into one index row, so no posting is shuffled and a word, line or
passage that a third of the documents share is spread evenly.  A row (segment) has the
segment's terms, one ascending position list per term (delta-coded) and the documents'
first positions; neighbouring documents are one position apart, so no match spans two.

``phrase_matches`` takes the test items as the query set, in blocks of at most
``ITEM_BYTES`` of text (broadcast; the bound is checked, more items mean more blocks), and
intersects offset-adjusted lists beginning with each window's rarest term in the segment:
the rarest list minus its offset gives candidate starts, and each next-rarest list keeps
the candidates c with c + offset in it.  ``proximity_matches`` does the same for unordered
terms within a distance.

Cases: a null text has no words (document without hits; item without windows); an item of
fewer words than a window is one window, an item without words matches nothing; repeated
rows count each on their own (documents are known by segment and place, not by id), items
with one id are one item; empty tables give no matches; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm.chunks import _Slots, gather
from suasion.llm.shared import written

WINDOW = 10
SEGMENT_WORDS = 1 << 19
ITEM_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CUT = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
INDEX = ("segment string, doc_ids array<long>, hashes array<long>, starts array<int>, n_words array<int>, "
         "terms binary, counts binary, postings binary")
MATCHES = "segment string, place int, item_id long, spans array<struct<first:int,last:int>>"


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased (every byte of a non-ASCII character is a word byte)."""
    return _WORD.findall(text.translate(_LOWER))


def _byte_pieces(text: bytes):
    """The text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        m = _CUT.search(text, at + PIECE_BYTES)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:] if at else text


class _Segment:
    """Documents gathered for one index row."""

    def __init__(self):
        self.slots, self.ids, self.pos = _Slots(), [], []
        self.doc_ids, self.hashes, self.starts, self.n_words, self.end = [], [], [], [], 0

    def add(self, doc_id, text_hash: int, text: bytes | None):
        n = 0
        for piece in _byte_pieces(text or b""):
            words = words_of(piece)
            if words:
                self.ids.append(np.fromiter(map(self.slots.__getitem__, words), np.int32, len(words)))
                self.pos.append(np.arange(self.end + n, self.end + n + len(words), dtype=np.int32))
                n += len(words)
        self.doc_ids.append(doc_id)
        self.hashes.append(text_hash)
        self.starts.append(self.end)
        self.n_words.append(n)
        self.end += n + 1

    def row(self, name: str) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        pos = np.concatenate(self.pos) if self.pos else ids
        counts = np.bincount(ids, minlength=len(self.slots)).astype(np.int32)
        pos = pos[np.argsort(ids, kind="stable")]
        gaps = np.diff(pos, prepend=np.int32(0))
        first = np.cumsum(counts) - counts
        gaps[first] = pos[first]
        values = [[name], [self.doc_ids], [self.hashes], [self.starts], [self.n_words], [b"\n".join(self.slots)],
                  [counts.astype("<i4").tobytes()], [gaps.astype("<i4").tobytes()]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                                          ["segment", "doc_ids", "hashes", "starts", "n_words", "terms", "counts", "postings"])


def _index_partition(batches):
    part, k, held = TaskContext.get().partitionId(), 0, _Segment()
    for batch in batches:
        for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            buf = text.as_buffer() if text.is_valid else None
            held.add(doc_id, text_hash, buf.to_pybytes() if buf is not None else None)
            if held.end >= SEGMENT_WORDS:
                yield held.row(f"{part}-{k}")
                k, held = k + 1, _Segment()
    if held.doc_ids:
        yield held.row(f"{part}-{k}")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, one row per segment (Parquet in the shared folder)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_index_partition, INDEX), "positional-index")


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, place, doc_id, text_hash, n_words) of every indexed document."""
    both = F.arrays_zip("doc_ids", "hashes", "n_words")
    return (index.select("segment", F.posexplode(both).alias("place", "d"))
            .select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.hashes").alias("text_hash"),
                    F.col("d.n_words").cast("long").alias("n_words")))


class Postings:
    """One segment's position lists, by query-term number."""

    def __init__(self, row: dict, query_terms: dict[bytes, int]):
        """Only the query terms' lists are decoded."""
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        gaps = np.frombuffer(row["postings"], "<i4")
        slot_of = np.full(len(query_terms), -1)
        for slot, term in enumerate(row["terms"].split(b"\n") if len(counts) else []):
            n = query_terms.get(term)
            if n is not None:
                slot_of[n] = slot
        first = np.cumsum(counts) - counts
        here = np.flatnonzero(slot_of >= 0)
        self.count = np.zeros(len(query_terms), np.int64)
        self.count[here] = counts[slot_of[here]]
        flat = gather(gaps, first[slot_of[here]], self.count[here]).astype(np.int64)
        ends = np.cumsum(self.count[here])
        self.at = np.zeros(len(query_terms), np.int64)
        self.at[here] = ends - self.count[here]
        run = np.cumsum(flat)
        before = np.repeat(run[self.at[here]] - flat[self.at[here]], self.count[here]) if len(here) else run
        self.pos = run - before
        # ascending over (term, position): one search finds a position in any term's list
        self.keys = np.repeat(np.arange(len(here)), self.count[here]) << 40 | self.pos
        self.rank = np.zeros(len(query_terms), np.int64)
        self.rank[here] = np.arange(len(here))

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        want = self.rank[terms] << 40 | np.maximum(positions, 0)
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[i] == want) & (positions >= 0)


def _windows(items: list[tuple[int, list[bytes]]], size: int):
    """Query terms, and per window length: term matrix and item number of every window."""
    terms: dict[bytes, int] = {}
    by_len: dict[int, tuple[list, list]] = {}
    for item, words in items:
        nums = [terms.setdefault(w, len(terms)) for w in words]
        n = min(size, len(nums))
        if n:
            rows, owner = by_len.setdefault(n, ([], []))
            for i in range(len(nums) - n + 1):
                rows.append(nums[i:i + n])
                owner.append(item)
    return terms, [(np.asarray(r, np.int64), np.asarray(o, np.int64)) for r, o in by_len.values()]


def _occurrences(post: Postings, rows: np.ndarray, owner: np.ndarray):
    """Starts of every occurrence of every window (rows: terms by offset), with the item."""
    freq = post.count[rows]
    live = np.flatnonzero((freq > 0).all(axis=1))
    rows, owner, freq = rows[live], owner[live], freq[live]
    rarest_first = np.argsort(freq, axis=1, kind="stable")
    each = np.arange(len(rows))
    off = rarest_first[:, 0]
    term = rows[each, off]
    n = post.count[term]
    window = np.repeat(each, n)
    start = gather(post.pos, post.at[term], n) - np.repeat(off, n)
    for k in range(1, rows.shape[1]):
        if not len(window):
            break
        off = rarest_first[window, k]
        kept = post.holds(rows[window, off], start + off)
        window, start = window[kept], start[kept]
    ok = start >= 0
    return owner[window[ok]], start[ok]


def _spans(places, items, first, last):
    """Merge touching occurrences of an item in a document: rows (place, item, [(first, last)…])."""
    order = np.lexsort((first, items, places))
    places, items, first, last = places[order], items[order], first[order], last[order]
    group = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (items[1:] != items[:-1])])
    for a, b in zip(group, np.r_[group[1:], len(places)], strict=True):
        out = []
        for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True):
            if out and x <= out[-1]["last"] + 1:
                out[-1]["last"] = max(out[-1]["last"], y)
            else:
                out.append({"first": x, "last": y})
        yield int(places[a]), int(items[a]), out


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (item number, id, words): each holds at most about ITEM_BYTES of text."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    keyed = rows.where(F.octet_length("text") > 0).withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, n))))
    for b in range(n):
        yield [(r["item"], words_of(bytes(r["text"]))) for r in keyed.where(F.col("block") == b).collect()]


def _search(index: DataFrame, items: DataFrame, find, id_col: str, text_col: str) -> DataFrame:
    """Run ``find(postings, row, prepared)`` for each block of items over every segment."""
    spark = index.sparkSession
    out = None
    for block in _blocks(items, id_col, text_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            ready = None
            for batch in batches:
                for row in batch.to_pylist():
                    ready = ready or find.prepare(sent.value)
                    found = list(find(Postings(row, ready[0]), row, ready))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["segment"]] * len(found)), pa.array([f[0] for f in found], pa.int32()),
                             pa.array([f[1] for f in found], pa.int64()),
                             pa.array([f[2] for f in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                            ["segment", "place", "item_id", "spans"])
        part = index.select("segment", "starts", "n_words", "terms", "counts", "postings").mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


class _Phrases:
    def __init__(self, size: int):
        self.size = size

    def prepare(self, items):
        numbers = [(i, words) for i, (_, words) in enumerate(items)]
        terms, tables = _windows(numbers, self.size)
        return terms, tables, [item for item, _ in items]

    def __call__(self, post, row, ready):
        if not len(post.pos):
            return
        starts = np.asarray(row["starts"], np.int64)
        item, first, last = [], [], []
        for rows, owner in ready[1]:
            o, s = _occurrences(post, rows, owner)
            item.append(o)
            first.append(s)
            last.append(s + rows.shape[1] - 1)
        if not item:
            return
        item, first, last = (np.concatenate(x) for x in (item, first, last))
        if len(first):
            place = np.searchsorted(starts, first, side="right") - 1
            ids = ready[2]
            for p, i, spans in _spans(place, item, first - starts[place], last - starts[place]):
                yield p, ids[i], spans


class _Near:
    """Documents where every word of an item lies within len + slop words, in any order."""

    def __init__(self, slop: int):
        self.slop = slop

    def prepare(self, items):
        terms: dict[bytes, int] = {}
        return terms, [sorted({terms.setdefault(w, len(terms)) for w in words}) for _, words in items], items

    def __call__(self, post, row, ready):
        starts = np.asarray(row["starts"], np.int64)
        for (item, words), nums in zip(ready[2], ready[1], strict=True):
            nums = np.asarray(nums, np.int64)
            if not len(nums) or not len(post.pos) or (post.count[nums] == 0).any():
                continue
            nums = nums[np.argsort(post.count[nums], kind="stable")]
            width = len(words) + self.slop
            lists = [post.pos[post.at[t]:post.at[t] + post.count[t]] for t in nums]
            near = lists[0]  # places round the rarest term that every other term reaches
            for other in lists[1:]:
                i = np.searchsorted(other, near - width + 1)
                near = near[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] < near + width)]
            if not len(near):
                continue
            pos = np.concatenate(lists)
            which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            order = np.argsort(pos, kind="stable")
            pos, which = pos[order], which[order]
            i = np.searchsorted(near, pos)
            gap = np.minimum(np.abs(near[np.minimum(i, len(near) - 1)] - pos), np.abs(near[np.maximum(i - 1, 0)] - pos))
            pos, which = pos[gap < width], which[gap < width]
            seen = np.full(len(lists), -1, np.int64)
            hits: dict[int, list] = {}
            for p, w in zip(pos.tolist(), which.tolist(), strict=True):
                seen[w] = p
                low = int(seen.min())
                place = int(np.searchsorted(starts, p, side="right")) - 1
                if low >= starts[place] and p - low < width:
                    out = hits.setdefault(place, [])
                    a, b = int(low - starts[place]), int(p - starts[place])
                    if out and a <= out[-1]["last"]:
                        out[-1]["last"] = b
                    else:
                        out.append({"first": a, "last": b})
            for place, spans in hits.items():
                yield place, item, spans


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW,
                   id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(segment, place, item_id, spans): word spans (first, last) of each item's windows in each document."""
    return _search(index, items, _Phrases(window), id_col, text_col)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 10,
                      id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(segment, place, item_id, spans): spans of at most (item words + slop) words that hold every item word."""
    return _search(index, items, _Near(slop), id_col, text_col)


def covered(spans: Column) -> Column:
    """Words covered by sorted (first, last) spans that may overlap."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(
        F.greatest(a["end"], s["last"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"] - 1))).alias("n")),
        lambda a: a["n"])


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted text ids), contaminated."""
    hit = (matches.groupBy("segment", "place")
           .agg(covered(F.flatten(F.collect_list("spans"))).alias("n_hit"),
                F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")))
    return (indexed_documents(index).join(hit, ["segment", "place"], "left")
            .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                    (F.col("n_hit") > 0).alias("contaminated")))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit word, all columns as they came."""
    index = build_index(docs, id_col, text_col)
    hit = written(contamination(index, phrase_matches(index, items, window)).where("contaminated")
                  .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(hit, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                     & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")
