"""ENC02: a message's vector is the mean of its sentences' vectors, of whatever rows and slices; one vector per row is moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from suasion.operators import encode as en

ROWS = [("a", "One two. Three! two?  Four"), ("b", ""), ("c", None), ("a", "two two. ..."), (None, "Lost words. more"), ("d", "x " * 700 + ". y"), ("e", ". "), (None, "more")]


def test_sentence_means(spark):
    df = spark.createDataFrame(ROWS, "message_id string, message string").repartition(3)
    for dim in (64, 5):
        _, got = en.sentence_vectors(df, dim=dim)
        by_sentence = df.select("message_id", F.explode(en.sentences("message")).alias("s"))
        want = en.average_vectors(en.encode(by_sentence, "s", ["message_id"], "content", dim), "message_id")
        got, want = ({r["message_id"]: r["features"] for r in x.collect()} for x in (got, want))
        assert set(got) == {"a", "b", "d", "e", None}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in got)


def test_slices_give_the_same_sums(spark, monkeypatch):
    import pyarrow as pa
    rows = [[[1, 1, 2], []], None, [], [[0] * 20, [2], None], [[1]]]
    want = [[0, 2 / 5 ** .5, 1 / 5 ** .5], [0, 0, 0], [0, 0, 0], [1, 0, 1], [0, 1, 0]]
    for cells in (1, 2, 7, 1 << 18):
        monkeypatch.setattr(en, "CELLS", cells)
        for kind in (rows, rows[:1] + rows):
            array = pa.array(kind, pa.list_(pa.list_(pa.int32())))
            got = en._sentence_sums(3).func(array[len(kind) - 5:]).to_pylist()
            assert np.allclose(got, want, atol=1e-15)


def test_sentences_are_not_spread_into_cells(spark, capsys):
    df = spark.createDataFrame(ROWS, "message_id string, message string")
    en.sentence_vectors(df)[1].explain()
    assert "Generate" not in capsys.readouterr().out


@pytest.mark.parametrize("family", ["style"])
def test_other_families_average_sentences(spark, family):
    df = spark.createDataFrame(ROWS[:2], "message_id string, message string")
    assert {r["message_id"] for r in en.sentence_vectors(df, family=family, dim=8)[1].collect()} == {"a", "b"}
