"""Text encoders (ENC01/02).

The pretrained networks of the reference are not reachable offline; what is
owed is the *job*: encode a text column once, keyed by id, into a fixed-width
vector, and persist it.  Two offline families:

* content — hashed bag of 1-gram tokens (L2-normalised counts per bucket);
* style   — hashed character 3-grams plus punctuation rate and mean word length.

Both work row by row (native tokens, numpy histograms of bounded slices of an Arrow batch): no shuffle.

A real encoder plugs in through ``encode_with``: a ``mapInPandas`` that loads the
model once per task and encodes Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.functions.text import lower_tokens, sentences, word_count


def token_bucket(tok, dim: int, hashing: str = "xxhash64"):
    """Bucket of a token: ``xxhash64`` (fast default) or the first 32 bits of ``md5``
    (reproducible outside Spark, e.g. by the SQL oracle)."""
    if hashing == "md5":
        return (F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")
    if hashing == "xxhash64":
        return F.pmod(F.xxhash64(tok), F.lit(dim)).cast("int")
    raise ValueError(f"unknown hashing {hashing!r}")


CELLS = 1 << 18  # tokens or characters in work at once: a task's memory doesn't follow the texts of its Arrow batch


def _unit_rows(counts):
    import numpy as np
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(counts / np.where(norm > 0, norm, 1.0)))


def _add_pieces(counts, pieces: Iterable, buckets: Callable) -> None:
    """Adds the buckets of ``pieces`` (row, cells; rows ascending) to the rows of ``counts``, at most about
    ``CELLS`` cells at a time.  ``buckets`` gives (place of the piece, bucket) of a list of cells."""
    import numpy as np
    dim = counts.shape[1]

    def add(rows: list, cells: list) -> None:
        place, bucket = buckets(cells)
        first, last = rows[0], rows[-1] + 1
        at = (np.array(rows, dtype=np.int64) - first)[place] * dim + bucket
        counts[first:last] += np.bincount(at, minlength=(last - first) * dim).reshape(last - first, dim)
    rows, cells, held = [], [], 0
    for row, piece in pieces:
        rows.append(row)
        cells.append(piece)
        held += len(piece)
        if held >= CELLS:
            add(rows, cells)
            rows, cells, held = [], [], 0
    if rows:
        add(rows, cells)


def _unit_histogram(dim: int):
    """Arrow function: buckets of a row → L2-normalised counts."""
    import numpy as np

    def placed(cells: list):
        return np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)

    @F.pandas_udf("array<double>")
    def histogram(buckets: pd.Series) -> pd.Series:
        counts = np.zeros((len(buckets), dim))
        _add_pieces(counts, ((i, b[a:a + CELLS]) for i, b in enumerate(buckets) if b is not None for a in range(0, len(b), CELLS)), placed)
        return _unit_rows(counts)
    return histogram


def _trigram_histogram(dim: int):
    """Arrow function: L2-normalised counts of each text's hashed code-point 3-grams, on texts end to end."""
    import numpy as np

    def placed(cells: list):
        a = np.frombuffer("".join(cells).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        h = (a[:-2] * np.uint64(1000003) + a[1:-1] * np.uint64(10007) + a[2:]) % np.uint64(dim)
        place = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        inside = place[:-2] == place[2:]
        return place[:-2][inside], h[inside].astype(np.int64)

    @F.pandas_udf("array<double>")
    def histogram(texts: pd.Series) -> pd.Series:
        counts = np.zeros((len(texts), dim))
        _add_pieces(counts, ((i, t[a:a + CELLS + 2]) for i, t in enumerate(texts) for a in range(0, len(t) - 2, CELLS)), placed)
        return _unit_rows(counts)
    return histogram


def content_column(text: str, dim: int = 64, hashing: str = "xxhash64"):
    """Hashed 1-gram counts of a text column, per row."""
    return _unit_histogram(dim)(F.transform(lower_tokens(text), lambda t: token_bucket(t, dim, hashing)))


def style_column(text: str, dim: int = 64):
    """Hashed character 3-grams (dim - 2 buckets), punctuation rate, mean word length / 10."""
    t = F.col(text)
    punct = F.length(F.regexp_replace(t, "[^\\p{Punct}]", "")) / F.greatest(F.length(t), F.lit(1))
    letters = F.length(F.regexp_replace(t, "[ \\t\\n\\r\\f\\x0B]+", ""))
    wlen = letters / F.greatest(word_count(text), F.lit(1)) / 10.0
    grams = _trigram_histogram(dim - 2)(F.lower(F.coalesce(t, F.lit(""))))
    return F.concat(grams, F.array(punct.cast("double"), wlen.cast("double")))


def encode(df: DataFrame, text: str = "message", group_id: str | list[str] = "message_id", family: str = "content",
           dim: int = 64, hashing: str = "xxhash64") -> DataFrame:
    """ENC01: ``(group_id, features array<double>)``, one row per input row, without a shuffle; a
    null text encodes to zeros."""
    if family == "content":
        vec = content_column(text, dim, hashing)
    elif family == "style":
        vec = style_column(text, dim)
    else:
        raise ValueError(f"unknown encoder family {family!r}")
    keys = [group_id] if isinstance(group_id, str) else group_id
    zeros = F.array_repeat(F.lit(0.0), dim)
    return df.select(*keys, F.when(F.col(text).isNotNull(), vec).otherwise(zeros).alias("features"))


def encode_with(df: DataFrame, text: str, group_id: str, load_encoder: Callable, dim: int) -> DataFrame:
    """Plug-in encoder: ``load_encoder()`` returns ``f(list[str]) -> ndarray (n, dim)``;
    it is called once per task, batches arrive as Arrow record batches."""
    import numpy as np
    import pandas as pd

    def run(it):
        enc = load_encoder()
        for pdf in it:
            texts = pdf[text].fillna("").tolist()
            arr = np.asarray(enc(texts), dtype="float64").reshape(len(texts), dim)
            yield pd.DataFrame({group_id: pdf[group_id], "features": list(arr)})

    gtype = dict(df.dtypes)[group_id]
    return df.select(group_id, text).mapInPandas(run, f"{group_id} {gtype}, features array<double>")


def _sentence_sums(dim: int):
    """Arrow function: the buckets of each sentence of a row → sum of the sentences' L2-normalised counts."""
    import numpy as np

    @F.arrow_udf("array<double>")
    def sums(buckets: pa.Array) -> pa.Array:
        out = np.zeros((len(buckets), dim))
        inner = buckets.flatten()  # null rows have no sentences
        sentence = np.concatenate([[0], np.cumsum(buckets.value_lengths().fill_null(0).to_numpy())])  # first of each row
        cell = np.concatenate([[0], np.cumsum(inner.value_lengths().fill_null(0).to_numpy())])  # first of each sentence
        cells, row = inner.flatten().to_numpy(), np.repeat(np.arange(len(buckets)), np.diff(sentence))
        a = 0
        while a < len(inner):  # sentences of at most about CELLS histogram cells and, if more than one, CELLS tokens
            b = max(a + 1, min(a + max(1, CELLS // dim), int(np.searchsorted(cell, cell[a] + CELLS, "right")) - 1))
            counts = np.zeros((b - a) * dim)
            for c in range(cell[a], cell[b], CELLS):
                d = min(c + CELLS, cell[b])
                place = np.searchsorted(cell[a + 1:b + 1], np.arange(c, d), "right")
                counts += np.bincount(place * dim + cells[c:d], minlength=len(counts))
            counts = counts.reshape(-1, dim)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            counts /= np.where(norm > 0, norm, 1.0)
            first = np.flatnonzero(np.diff(row[a:b], prepend=-1))
            out[row[a:b][first]] += np.add.reduceat(counts, first)
            a = b
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
    return sums


def sentence_vectors(df: DataFrame, text: str = "message", group_id: str = "message_id",
                     family: str = "content", dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """ENC02: encode every sentence (kept at ``group_id:idx``) and average them per message.

    Sentences of the content family are summed where their text lies; only one vector of each row goes to
    its message's mean."""
    split = df.select(group_id, sentences(text).alias("_s"))
    sents = split.select(group_id, F.posexplode("_s").alias("sent_idx", "sentence"))
    sents = sents.withColumn("sent_id", F.concat(F.col(group_id), F.lit(":"), F.col("sent_idx").cast("string")))
    sv = encode(sents, "sentence", [group_id, "sent_id"], family, dim)  # the message id stays on the row
    vectors = sv.select("sent_id", "features")
    if family != "content":
        return vectors, average_vectors(sv, group_id, "features")
    buckets = F.transform("_s", lambda s: F.transform(lower_tokens(s), lambda t: token_bucket(t, dim)))
    rows = split.filter(F.col("_s").isNotNull()).select(group_id, F.size("_s").alias("_n"), _sentence_sums(dim)(buckets).alias("_v"))
    # one sum per position: partial sums, so a message id on very many rows is combined in each task first
    total = rows.groupBy(group_id).agg(F.sum("_n").alias("_n"), *[F.sum(F.col("_v")[i]).alias(f"_{i}") for i in range(dim)])
    return vectors, total.select(group_id, F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)]).alias("features"))


def average_vectors(df: DataFrame, group_id: str, features: str = "features") -> DataFrame:
    """Element-wise mean of the vectors of each group (ENC02's message vector).

    Cells are averaged by (group, position) — a partial aggregate, so a group with a
    third of all rows is pre-combined per task — and re-assembled in position order;
    a group's final row holds one vector.
    """
    cells = df.select(group_id, F.posexplode(features).alias("i", "x"))
    avg = cells.groupBy(group_id, "i").agg(F.avg("x").alias("x"))
    return avg.groupBy(group_id).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_s")).select(
        group_id, F.transform("_s", lambda s: s["x"]).alias(features))
