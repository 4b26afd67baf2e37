"""Encoders: same vectors whatever the slices, memory of a task bounded by the slice and not by the batch's texts."""

import tracemalloc

import numpy as np
import pandas as pd

from suasion.operators import encode as en

TEXTS = ["", "a", "ab", "abc", "hello, world", "x" * 50, "日本語テキスト", "🙂🙃🙂🙃", "", "abcabc" * 9, "ab"]


def by_hand(text, dim):
    out = np.zeros(dim)
    for i in range(len(text) - 2):
        out[(ord(text[i]) * 1000003 + ord(text[i + 1]) * 10007 + ord(text[i + 2])) % dim] += 1
    return out / (np.sqrt((out * out).sum()) or 1.0)


def test_slices_give_the_whole_histogram(spark, monkeypatch):
    for cells in (1, 2, 7, 1 << 18):
        monkeypatch.setattr(en, "CELLS", cells)
        got = en._trigram_histogram(62).func(pd.Series(TEXTS))
        assert all(np.allclose(g, by_hand(t, 62), atol=1e-15) for g, t in zip(got, TEXTS, strict=True))
        buckets = pd.Series([None, np.array([1, 1, 2], np.int32), np.array([], np.int32), np.array([0] * 20, np.int32), None])
        got = np.vstack(en._unit_histogram(3).func(buckets).tolist())
        assert np.allclose(got, [[0, 0, 0], [0, 2 / 5 ** .5, 1 / 5 ** .5], [0, 0, 0], [1, 0, 0], [0, 0, 0]])
    assert len(en._trigram_histogram(62).func(pd.Series([], dtype=object))) == 0


def peak(f, x) -> float:
    tracemalloc.start()
    try:
        f(x)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_does_not_follow_the_texts(spark):
    text = "abcdefghij" * 500
    style = getattr(en, "_trigram_histogram", None)
    style = style(62).func if style else lambda x: en._unit_histogram(62).func(en._trigram_buckets(62).func(x))
    assert peak(style, pd.Series([text] * 2000)) < 60  # 10 million 3-grams
    one = np.arange(5000, dtype=np.int32) % 64
    assert peak(en._unit_histogram(64).func, pd.Series([one] * 2000)) < 60
