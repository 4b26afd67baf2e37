"""Operator 11 — ranked lexical search over hashed max-sketches.

``build_index`` reads every text once.  A document becomes one row: its distinct terms with
their occurrences, and a sketch.  Each term has two hashed coordinates, and a coordinate keeps
the maximum over all terms that fall on it.  Within one document a term's impact grows with
its occurrences alone (the length norm is the same for all its terms), so the maximum impact
of a coordinate is the impact of the most occurrences there: the sketch keeps that number, in
one byte rounded up, and stays valid when the corpus totals change.  A sketch has about four
coordinates per distinct term, so long documents are not looser than short ones.  Each task
also writes the document counts of the terms it met (its dictionary), so a search adds up the
counts of its own terms without a shuffle of the vocabulary.

``search`` takes the queries in blocks of bounded size.  For each block:

1. weights from the dictionaries (an inner join with the block's terms, then a sum);
2. upper bounds from the sketches alone: all terms of the block are looked up at once, a
   term's bound is the smaller of its two coordinates; the highest bounds of each query are
   scored exactly, and the k-th of those scores is its first threshold;
3. every task goes through its documents in descending order of bound, scores exactly those
   whose bound reaches a query's threshold, raises the thresholds with its own k best, and
   stops when no bound is left above them.  At most k rows per query leave a task.

A bound is never below the score, so the result is exact.

Cases: null and empty texts have no term and are not counted; queries without a term that
occurs give no rows; rows with equal ids are documents of their own; equal scores go by
ascending id (null last), then by place in the index; a query row that occurs twice is
answered twice (``query`` numbers the rows); very long texts are one row each, in memory only
as their distinct terms; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suasion.llm.shared import written

#: Every byte that is no letter, digit or part of a longer character separates terms; A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: The most occurrences a coordinate's byte stands for: exact to 127, then in steps of 7 %, the last for any number.
_MOST = np.array([*range(128), *(int(127 * 1.07 ** i) + 1 for i in range(1, 128)), 1 << 40], np.int64)
_SPREAD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
COORDINATES, LEAST_BITS = 4, 6
DICTIONARY_TERMS = 1 << 18
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 512
CELLS = 1 << 20  # of a bound computation at once
OPENED_AT_ONCE = 64
INDEX = "row long, doc_id long, n long, bits int, sketch binary, terms binary, tfs binary, words array<string>, dfs array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def coordinates(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of terms (by crc32) in a sketch of ``2 ** bits`` coordinates."""
    shift = np.uint32(32 - bits)
    return tuple(((codes * k) >> shift).astype(np.int64) for k in _SPREAD)


def sketch_of(counts: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """(bits, coordinatewise maxima) of a document's term occurrences."""
    codes = np.fromiter(map(zlib.crc32, counts), np.uint32, len(counts))
    level = np.searchsorted(_MOST, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
    bits = min(31, max(LEAST_BITS, (COORDINATES * len(counts) - 1).bit_length()))
    sketch = np.zeros(1 << bits, np.uint8)
    for at in coordinates(codes, bits):
        np.maximum.at(sketch, at, level)
    return bits, sketch


@dataclass
class Index:
    table: DataFrame  # INDEX: rows of documents, and rows of dictionaries (words, dfs)
    n_docs: int
    n_terms: int

    def documents(self, *columns: str) -> DataFrame:
        return self.table.where("row is not null").select(*columns)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Sketches, term lists and dictionaries of all documents with a term, written in one pass."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        met: Counter = Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_buffer().to_pybytes()) if text.is_valid and text.as_buffer() is not None else ()
                if found:
                    counts = Counter(found)
                    bits, sketch = sketch_of(counts)
                    met.update(counts.keys())
                    rows.append((row, doc_id, len(found), bits, sketch.tobytes(), b" ".join(counts),
                                 np.fromiter(counts.values(), "<i4", len(counts)).tobytes(), None, None))
                    row += 1
                if len(met) >= DICTIONARY_TERMS:
                    rows.append(_dictionary(met))
                    met = Counter()
            if rows:
                yield _index_batch(rows)
        if met:
            yield _index_batch([_dictionary(met)])
    table = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX), "search-index")
    n_docs, n_terms = table.where("row is not null").agg(F.count("row"), F.sum("n")).first()
    return Index(table, n_docs, n_terms or 0)


def _dictionary(met: Counter) -> tuple:
    words = sorted(met)
    return None, None, None, None, None, None, None, [w.decode() for w in words], [met[w] for w in words]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      [f.split()[0] for f in INDEX.split(", ")])


def document_frequencies(index: Index, words: list[str]) -> dict[str, int]:
    """Documents that hold each of the words (a bounded list: one block's); words that none holds are left out."""
    spark = index.table.sparkSession
    wanted = spark.createDataFrame([(w,) for w in words], "word string")
    met = (index.table.where("words is not null").select(F.inline(F.arrays_zip("words", "dfs")))
           .join(F.broadcast(wanted), F.col("words") == F.col("word"), "left_semi"))
    return dict(met.groupBy("words").agg(F.sum("dfs")).collect())


@dataclass
class Block:
    """Queries of one block, as arrays: ``of`` holds their terms end to end from ``starts`` on."""
    numbers: list[int]
    places: dict[bytes, int]
    codes: np.ndarray
    of: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    n_docs: int
    n_terms: int

    def norms(self, n: np.ndarray) -> np.ndarray:
        return 10 + (90 * n * self.n_docs) // self.n_terms

    def totals(self, impacts: np.ndarray) -> np.ndarray:
        """(documents x terms) impacts → (documents x queries) weighted sums."""
        return np.add.reduceat(impacts[:, self.of] * self.weights, self.starts, axis=1)

    def bounds(self, bits: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """(documents x queries) upper bounds from sketches alone."""
        out = np.zeros((len(n), len(self.numbers)), np.int64)
        norms = self.norms(n)
        step = max(1, CELLS // len(self.of))
        for width in np.unique(bits):
            first, second = coordinates(self.codes, int(width))
            all_of = np.flatnonzero(bits == width)
            for a in range(0, len(all_of), step):
                at = all_of[a:a + step]
                maxima = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), -1)
                level = np.minimum(maxima[:, first], maxima[:, second])
                impact = impacts(np.minimum(_MOST, n[at, None]), norms[at, None])  # of each byte, for each document
                out[at] = self.totals(np.take_along_axis(impact, level.astype(np.int64), 1))
        return out

    def scores(self, n: np.ndarray, terms: list[bytes], tfs: list[bytes]) -> np.ndarray:
        """(documents x queries) exact scores."""
        tf = np.zeros((len(n), len(self.places)), np.int64)
        get = self.places.get
        for k, (words, counts) in enumerate(zip(terms, tfs, strict=True)):
            place = np.fromiter((get(w, -1) for w in words.split(b" ")), np.int64)
            known = np.flatnonzero(place >= 0)
            tf[k, place[known]] = np.frombuffer(counts, "<i4")[known]
        return self.totals(impacts(tf, self.norms(n)[:, None]))


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Best:
    """The k highest (score, id, row) of each query so far; ``least`` is what a score must reach to matter."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.floor = k, least
        self.score = np.zeros((queries, 0), np.int64)
        self.key = np.zeros((queries, 0), np.int64)
        self.row = np.zeros((queries, 0), np.int64)

    @property
    def least(self) -> np.ndarray:
        own = self.score[:, self.k - 1] if self.score.shape[1] >= self.k else 0
        return np.maximum(np.maximum(self.floor, own), 1)

    def add(self, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        """Scores (documents x queries) of documents with these sort keys and rows, the same for all queries
        or (queries x documents)."""
        new = (score.T, np.broadcast_to(key, score.T.shape), np.broadcast_to(row, score.T.shape))
        every = [np.concatenate(x, 1) for x in zip((self.score, self.key, self.row), new, strict=True)]
        order = np.lexsort((every[2], every[1], -every[0]), axis=-1)[:, :self.k]
        self.score, self.key, self.row = (np.take_along_axis(x, order, 1) for x in every)

    def batch(self, numbers: list[int]) -> pa.RecordBatch:
        q, i = np.nonzero(self.score > 0)
        columns = (np.array(numbers, np.int64)[q], self.score[q, i], self.key[q, i], self.row[q, i])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "score", "key", "row"])


FOUND = "query long, score long, key long, row long"
_LAST = (1 << 63) - 1  # sort key of a null id


def _keys(column) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _first_k(found: DataFrame, k: int, *order) -> DataFrame:
    return (found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
            .where(F.col("rank") <= k))


def _thresholds(index: Index, block: Block, k: int) -> np.ndarray:
    """A score that k documents reach, for each query (0 where fewer are known): the k-th exact score
    among the documents of highest bound."""
    seeds = 2 * k

    def highest(batches):
        best = Best(len(block.numbers), seeds, np.zeros(len(block.numbers), np.int64))
        for batch in batches:
            row, n, bits = (_numbers(batch.column(i)) for i in range(3))
            bound = block.bounds(bits, n, batch.column(3).to_pylist()).T
            top = np.argpartition(-bound, min(seeds, len(n)) - 1, axis=1)[:, :seeds]
            best.add(np.take_along_axis(bound, top, 1).T, row[top], row[top])
        yield best.batch(block.numbers)

    def exact(batches):
        best = Best(len(block.numbers), k, np.zeros(len(block.numbers), np.int64))
        for batch in batches:
            row, n = (_numbers(batch.column(i)) for i in range(2))
            for a in range(0, len(n), OPENED_AT_ONCE):
                part = batch.slice(a, OPENED_AT_ONCE)
                best.add(block.scores(n[a:a + OPENED_AT_ONCE], part.column(2).to_pylist(), part.column(3).to_pylist()),
                         row[a:a + OPENED_AT_ONCE], row[a:a + OPENED_AT_ONCE])
        yield best.batch(block.numbers)
    bounds = index.documents("row", "n", "bits", "sketch").mapInArrow(highest, FOUND)
    # at most 2 k rows a query: bounded by the block
    wanted = _first_k(bounds, seeds, F.desc("score"), "row").select(F.col("row").alias("_row")).distinct()
    opened = index.documents("row", "n", "terms", "tfs").join(F.broadcast(wanted), F.col("row") == F.col("_row"), "left_semi").mapInArrow(exact, FOUND)
    kth = dict(_first_k(opened, k, F.desc("score"), "row").where(F.col("rank") == k).select("query", "score").collect())
    return np.array([kth.get(q, 0) for q in block.numbers], np.int64)


def _matches(index: Index, block: Block, k: int) -> DataFrame:
    """(query, score, key, row): at most k rows a query from each task, the k best of all among them."""
    least = _thresholds(index, block, k)

    def run(batches):
        best = Best(len(block.numbers), k, least)
        for batch in batches:
            row, n, bits = (_numbers(batch.column(i)) for i in range(3))
            key, terms, tfs = _keys(batch.column(6)), batch.column(4), batch.column(5)
            bound = block.bounds(bits, n, batch.column(3).to_pylist())
            order = np.argsort(-(bound / best.least).max(1), kind="stable")  # descending: a document opens for all its queries
            at = 0
            while at < len(order):
                ahead = order[at:at + 16 * OPENED_AT_ONCE]
                open_ = ahead[(bound[ahead] >= best.least).any(1)][:OPENED_AT_ONCE]
                if not len(open_):
                    if not (bound[order[at:]] >= best.least).any():
                        break
                    at += len(ahead)
                    continue
                at += int(np.flatnonzero(ahead == open_[-1])[0]) + 1
                best.add(block.scores(n[open_], [terms[int(i)].as_py() for i in open_], [tfs[int(i)].as_py() for i in open_]), key[open_], row[open_])
        yield best.batch(block.numbers)
    return index.documents("row", "n", "bits", "sketch", "terms", "tfs", "doc_id").mapInArrow(run, FOUND)


def _blocks(index: Index, queries: DataFrame, text_col: str):
    """Blocks of the numbered queries, each of bounded size (one longer query is a block's only one)."""
    size, count = queries.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    n = max(1, -(-(size or 0) // BLOCK_BYTES), -(-count // BLOCK_ITEMS))
    for b in range(n):
        rows = queries.where(F.pmod("query", F.lit(n)) == b).select("query", F.encode(F.coalesce(text_col, F.lit("")), "utf-8")).collect()
        wanted = {q: sorted(set(terms_of(bytes(text)))) for q, text in sorted(rows)}
        every = sorted({w for words in wanted.values() for w in words})
        df = document_frequencies(index, [w.decode() for w in every]) if every else {}
        known = [w for w in every if w.decode() in df]
        places = {w: i for i, w in enumerate(known)}
        weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[w.decode()] + 1))) for w in known], np.int64)
        of = {q: [places[w] for w in words if w in places] for q, words in wanted.items()}
        of = {q: p for q, p in of.items() if p}
        if of:
            flat = np.array([i for p in of.values() for i in p], np.int64)
            lens = np.array([len(p) for p in of.values()], np.int64)
            yield Block(list(of), places, np.fromiter(map(zlib.crc32, known), np.uint32, len(known)), flat, weight[flat],
                        np.cumsum(lens) - lens, index.n_docs, index.n_terms)


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, item_id, rank, doc_id, score): the k highest-scoring documents of every query row, best first,
    scores above 0."""
    spark = queries.sparkSession
    numbered = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "queries")
    found = [written(_matches(index, block, k), "search-matches") for block in _blocks(index, numbered, "text")]
    every = found[0] if found else spark.createDataFrame([], FOUND)
    for part in found[1:]:
        every = every.unionByName(part)
    ranked = written(_first_k(every, k, F.desc("score"), "key", "row"), "search-ranks")
    named = ranked.join(index.documents(F.col("row").alias("_row"), "doc_id"), F.col("row") == F.col("_row"))
    return named.join(numbered.select(F.col("query").alias("_query"), "item_id"), F.col("query") == F.col("_query")).select(
        "query", "item_id", "rank", "doc_id", "score")
