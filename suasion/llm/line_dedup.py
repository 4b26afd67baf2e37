"""Operator 8 — near-duplicate lines by a deletion-neighbourhood join.

Two lines are near copies when one word replaced, inserted or deleted turns one into the
other (edit bound 1 over words) and the longer has at least MIN_WORDS words, which makes
an edit similarity of 0.8 or more; equal lines (same words) are copies at any length.  A
line goes when an EARLIER line (document id, then line number) is its copy or near copy;
the earliest stays.  Blank lines stay.

* Equal lines become one class each: a map-side combined minimum over 128-bit hashes.
* Pruning that loses nothing: with one edit, the first or the last half of the words is
  untouched, so a class sharing neither half (hashed, for both lengths that can meet) with
  another class has no near copy and emits no variants.
* Deletion neighbourhood: of the others, every variant with one word of the half that may
  differ deleted, as a 64-bit hash with the place of deletion, and the whole line as its own
  variant.  Equal (variant, place) = one word replaced; a variant equal to a whole line =
  one word inserted or deleted.
* Each match names the earliest line of its variant (an aggregate, so a variant shared by
  a third of all lines costs one row per line, never pairs); the word edit distance of the
  named pair is then verified on the lines themselves.
* Removal is a join on the document of line numbers to drop.

Cases: null and empty texts have no lines and come back unchanged; rows equal in id and
text are one document (all keep what it keeps), rows with one id and different texts are
ordered by their texts' hashes; null ids sort first; an empty table gives an empty one;
all columns of the table come back, ``text`` without the dropped lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm.shared import drop_written, texts_of, written

MIN_WORDS = 5
_NO_ID = -(1 << 63)  # a null id, in keys
LINES = "h1 long, h2 long, doc long, th long, line int, n int, a0 long, a1 long, z0 long, z1 long"
VARIANTS = "v long, place int, h1 long, h2 long, doc long, th long, line int"


def _h(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)


def _line_keys(line: str, min_words: int):
    """(h1, h2, words, first halves, last halves) of a line that isn't blank."""
    words = line.split()
    n = len(words)
    flat = " ".join(words)
    a = z = (None, None)
    if n >= min_words - 1:
        sizes = (n // 2, (n - 1) // 2)  # halves of both lengths this line can meet
        a = tuple(_h(" ".join(words[:k]), 2 * k + 1) for k in sizes)
        z = tuple(_h(" ".join(words[n - k:]), 2 * k + 2) for k in sizes)
        if sizes[0] == sizes[1]:
            a, z = (a[0], None), (z[0], None)
    return _h(flat), _h(flat, 1), n, *a, *z


def _slices(batches, rows: int = 512):
    """The batches in small pieces: a task holds the lines of one."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("th"), text.alias("text"))


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that isn't blank: hashes, place, word count, half hashes.  Written."""
    def run(batches):
        for b in _slices(batches):
            rows = []
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                for i, line in enumerate(text.split("\n")):
                    if line and not line.isspace():
                        h1, h2, n, *halves = _line_keys(line, min_words)
                        rows.append((h1, h2, doc, th, i, n, *halves))
            if rows:
                yield _batch(rows, LINES)
    return written(_keyed(docs, id_col, text_col).mapInArrow(run, LINES), "lines")


def line_classes(lines: DataFrame) -> DataFrame:
    """One row per distinct line, with its earliest place."""
    at = F.min(F.struct("doc", "th", "line")).alias("at")
    return (lines.groupBy("h1", "h2").agg(at, *[F.min(c).alias(c) for c in ("n", "a0", "a1", "z0", "z1")])
            .select("h1", "h2", "at.*", "n", "a0", "a1", "z0", "z1"))


_KIND = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KIND[k]) for (_, k), c in zip(fields, zip(*rows, strict=True), strict=True)],
                                      [name for name, _ in fields])


def _candidates(classes: DataFrame) -> DataFrame:
    """(doc, th, line, h1, h2, first, last): lines that share their first / last half with another class.  Written."""
    halves = classes.where("n > 0").select(
        "h1", "h2", "doc", "th", "line",
        F.explode(F.array(F.struct(F.col("a0").alias("half"), F.lit(True).alias("front")),
                          F.struct(F.col("a1").alias("half"), F.lit(True).alias("front")),
                          F.struct(F.col("z0").alias("half"), F.lit(False).alias("front")),
                          F.struct(F.col("z1").alias("half"), F.lit(False).alias("front")))).alias("k"))
    keys = halves.select("k.half").where("half is not null")
    shared = written(keys.groupBy("half").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("half").alias("_half")), "shared-halves")
    met = halves.where("k.half is not null").join(shared, F.col("k.half") == F.col("_half"))
    out = written(met.groupBy("h1", "h2", "doc", "th", "line")
                  .agg(F.max(F.col("k.front").cast("int")).alias("first"), F.max((~F.col("k.front")).cast("int")).alias("last")), "line-candidates")
    drop_written(shared)
    return out


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)


def _sequence_hash(total: np.ndarray, n: int) -> np.ndarray:
    """Spread the polynomial sum of ``n`` word hashes over all 64 bits, as signed numbers."""
    x = total + np.uint64(n * _BACK & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _variants(words: list[str], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the line itself (place -1) and of its deletions: a line that shares only
    its first half can differ only after it, and the other way round.  A sequence's hash is the sum of
    word hash x base ** place, so each deletion costs one step however long the line is."""
    n = len(words)
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power)])
    low, high = (0 if last else (n - 1) // 2), (n if first else n - (n - 1) // 2)
    p = np.arange(low, high)
    without = prefix[p] + (prefix[n] - prefix[p + 1]) * np.uint64(_BACK)
    return (np.concatenate([_sequence_hash(prefix[n:], n), _sequence_hash(without, n - 1)]),
            np.concatenate([[-1], p]).astype(np.int32))


def distance_one(a: list[str], b: list[str]) -> bool:
    """Word edit distance at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1:] == short[i:]


def near_lines(docs: DataFrame, cand: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2) of the candidates with an earlier line within the bound.  Written; drops ``cand``."""
    per_doc = cand.groupBy("doc", "th").agg(F.collect_list(F.struct("line", "h1", "h2", "first", "last")).alias("wanted"))
    texts = _keyed(docs, id_col, text_col).join(per_doc, ["doc", "th"]).select("doc", "th", "text", "wanted")

    def lines_of(batches):
        for b in _slices(batches):
            rows = []
            for doc, th, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = text.split("\n")
                rows += [(w["h1"], w["h2"], doc, th, w["line"], w["first"], w["last"], lines[w["line"]]) for w in wanted]
            if rows:
                yield _batch(rows, CANDIDATES)
    CANDIDATES = "h1 long, h2 long, doc long, th long, line int, first int, last int, words string"
    found = written(texts.mapInArrow(lines_of, CANDIDATES).dropDuplicates(["h1", "h2"]), "candidate-lines")
    drop_written(cand)

    def emit(batches):
        for b in batches:
            first, last, texts = (b.column(k).to_pylist() for k in (5, 6, 7))
            for a in range(0, len(texts), 4096):
                found = []
                for f, z, text in zip(first[a:a + 4096], last[a:a + 4096], texts[a:a + 4096], strict=True):
                    words = text.split()
                    hashes, places = _variants(words, f, z)
                    found.append((hashes, places) if len(words) >= min_words else (hashes[:1], places[:1]))
                of = np.repeat(np.arange(a, a + len(found)), [len(h) for h, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), pa.array(np.concatenate([p for _, p in found])),
                                                  *b.select(list(range(5))).take(pa.array(of)).columns], [f.split()[0] for f in VARIANTS.split(", ")])
    variants = written(found.mapInArrow(emit, VARIANTS), "line-variants")
    order = F.struct("doc", "th", "line", "h1", "h2")
    # earliest line of a (variant, place), and of a variant's deletions and whole lines
    groups = variants.groupBy("v", "place").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("m"))
    replaced = written(groups.where("m > 1 and place >= 0").select(F.col("v").alias("_v"), F.col("place").alias("_p"), "low"), "replaced")
    deleted = F.min(F.when(F.col("place") >= 0, order)).alias("low_deleted")
    whole = F.min(F.when(F.col("place") < 0, order)).alias("low_whole")
    inserted = written(variants.groupBy("v").agg(deleted, whole).where("low_deleted is not null and low_whole is not null")
                       .select(F.col("v").alias("_v"), "low_deleted", "low_whole"), "inserted")
    own = [F.col(c) for c in ("h1", "h2", "doc", "th", "line")]
    pairs = (variants.join(replaced, (F.col("v") == F.col("_v")) & (F.col("place") == F.col("_p"))).select(*own, "low")
             .unionByName(variants.join(inserted, F.col("v") == F.col("_v"))
                          .select(*own, F.when(F.col("place") < 0, F.col("low_deleted")).otherwise(F.col("low_whole")).alias("low"))))
    named = written(pairs.where(F.col("low") < order).select("h1", "h2", F.col("low.h1").alias("k1"), F.col("low.h2").alias("k2")).distinct(),
                    "line-pairs")
    drop_written(variants, replaced, inserted)
    text = found.select("h1", "h2", "words")
    kept = text.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("words").alias("kept_words"))

    def verify(batches):
        for b in batches:
            ok = [distance_one(x.split(), y.split()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:2]], ["h1", "h2"])
    near = written(named.join(text, ["h1", "h2"]).join(kept, ["k1", "k2"])
                   .select("h1", "h2", "words", "kept_words").mapInArrow(verify, "h1 long, h2 long").distinct(), "near-lines")
    drop_written(found, named)
    return near


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, lines): the line numbers each document loses.  Written."""
    wide = line_table(docs, min_words, id_col, text_col)
    classes = written(line_classes(wide), "line-classes")
    cand = _candidates(classes)
    place = ["h1", "h2", "doc", "th", "line"]  # the halves have done their work
    lines, first = written(wide.select(place), "line-places"), written(classes.select(place), "first-places")
    drop_written(wide, classes)
    near = near_lines(docs, cand, min_words, id_col, text_col)
    found = near.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    verdict = (first.withColumnsRenamed({"h1": "c1", "h2": "c2", "doc": "cdoc", "th": "cth", "line": "cline"})
               .join(found, (F.col("c1") == F.col("n1")) & (F.col("c2") == F.col("n2")), "left").withColumn("near", F.col("n1").isNotNull()))
    out = lines.join(verdict, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))) \
        .where(F.col("near") | (F.struct("cdoc", "cth", "cline") != F.struct("doc", "th", "line")))
    lost = written(out.groupBy("doc", "th").agg(F.collect_set("line").alias("lines")), "dropped-lines")
    drop_written(lines, first, near)
    return lost


def without_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                            text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns of ``docs``; ``text_col`` without lines that repeat an earlier one (``count_col``, if
    given, becomes the new text's length in characters)."""
    drop = dropped_lines(docs, min_words, id_col, text_col).select(
        F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("lines").alias("__lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(drop, (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col("__doc"))
                       & (F.xxhash64(text) == F.col("__th")), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1),
                                 lambda _, i: ~F.array_contains(F.col("__lines"), i)), "\n")
    new = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(left)
    cols = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        cols = [F.when(F.col("__lines").isNull(), F.col(c)).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c)
                if c == count_col else col for c, col in zip(docs.columns, cols, strict=True)]
    return joined.select(*cols)
