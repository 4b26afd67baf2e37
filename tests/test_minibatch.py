"""TRN01: mini-batches against plain numpy, against full batches, and their independence of the partitions."""

import hashlib

import numpy as np
import pytest

from suasion.operators import grid as gr
from suasion.operators import minibatch
from suasion.operators import train as tr


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=90) / 2 > 0).astype(int)
    return x, y


def frame(spark, table, parts=3):
    x, y = table
    split = ["test" if i % 10 == 9 else "validation" if i % 10 > 6 else "train" for i in range(len(y))]
    rows = [(f"k{i}", x[i].tolist(), int(y[i]), split[i], i % 3) for i in range(len(y))] + [("k_null", [0.0] * 4, None, "train", 0)]
    return spark.createDataFrame(rows, "id string, features array<double>, persuaded int, split string, fold int").repartition(parts)


def plain(x, y, keys, setting, epochs, rows_per_block):
    """Weights after each epoch: the blocks one after the other, then averaged."""
    x = np.hstack([x, np.ones((len(x), 1))])
    order = sorted(range(len(x)), key=lambda i: (hashlib.md5(keys[i].encode()).hexdigest(), keys[i]))
    blocks = [order[a:a + rows_per_block] for a in range(0, len(x), rows_per_block)]
    state, out = (np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0), []
    for epoch in range(1, epochs + 1):
        ends = []
        for block in blocks:
            w, m, v, t = state
            mine = sorted(block, key=lambda i: (hashlib.md5(f"{setting.seed}:{epoch}:{keys[i]}".encode()).hexdigest(), keys[i]))
            for a in range(0, len(mine), setting.batch_size):
                at = mine[a:a + setting.batch_size]
                g = x[at].T @ (1 / (1 + np.exp(-2 * x[at] @ w)) - y[at]) / len(at) + setting.weight_decay * w
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - setting.lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            ends.append((w, m, v, t, len(block)))
        total = sum(e[4] for e in ends)
        state = tuple(sum(e[k] * e[4] for e in ends) / total for k in range(4))
        out.append(state[0])
    return out


@pytest.mark.parametrize("rows_per_block", [None, 20])
def test_epochs_equal_plain_numpy(spark, table, rows_per_block):
    x, y = table
    settings = [tr.HeadSetting("a", lr=0.05, batch_size=8, seed=3, patience=0, weight_decay=0.01),
                tr.HeadSetting("b", lr=0.02, batch_size=50, seed=4, patience=0)]
    train = [i for i in range(90) if i % 10 <= 6]
    for parts in (1, 5):
        metrics, final = tr.train_heads(frame(spark, table, parts), settings, epochs=4, id_col="id", rows_per_block=rows_per_block)
        for s in settings:
            want = plain(x[train], y[train], [f"k{i}" for i in train], s, 4, rows_per_block or 1000)
            assert np.allclose(final[s.run_id]["last_theta"], want[-1], atol=1e-9)
        assert metrics.count() == 8


def test_one_batch_of_all_rows_is_the_full_batch(spark, table):
    def settings(size):
        return [tr.HeadSetting("wd0", lr=0.05, batch_size=size), tr.HeadSetting("wd1", lr=0.02, weight_decay=0.1, patience=0, batch_size=size)]
    full, a = tr.train_heads(frame(spark, table), settings(None), epochs=12)
    mini, b = tr.train_heads(frame(spark, table), settings(10_000), epochs=12)
    assert np.allclose(full.orderBy("run_id", "epoch").drop("run_id").toPandas(), mini.orderBy("run_id", "epoch").drop("run_id").toPandas(), atol=1e-9)
    for run in ("wd0", "wd1"):
        assert np.allclose(a[run]["theta"], b[run]["theta"], atol=1e-9)
        assert {k: v for k, v in a[run].items() if "theta" not in k} == {k: v for k, v in b[run].items() if "theta" not in k}


def test_both_kinds_of_settings_and_all_folds_train_together(spark, table):
    x, y = table
    settings = [tr.HeadSetting("full", lr=0.05), tr.HeadSetting("small", lr=0.05, batch_size=7, seed=9, patience=0)]
    _, oof = tr.kfold_heads(frame(spark, table), "fold", settings, epochs=3, keep=["id"], use_best=False, id_col="id")
    got = {(r["run_id"], r["id"]): r["p1"] for r in oof.collect()}
    assert len(got) == 180
    for k in range(3):
        rest = [i for i in range(90) if i % 3 != k]
        w = plain(x[rest], y[rest], [f"k{i}" for i in rest], settings[1], 3, 1000)[-1]
        for i in range(k, 90, 3):
            assert got["small", f"k{i}"] == pytest.approx(1 / (1 + np.exp(-2 * (x[i] @ w[:-1] + w[-1]))), abs=1e-9)


def test_seed_and_batch_size_act_in_a_grid(spark, table):
    grid = gr.expand_grid(spark, {"parameters": {"batch_size": {"values": [8, 64]}, "seed": {"values": [1, 2]}, "epochs": {"value": 2}, "lr": {"value": 0.05}}})
    metrics, final = gr.run_grid(frame(spark, table), grid, features="features")
    assert metrics.count() == 8 and len({tuple(np.round(f["theta"], 9)) for f in final.values()}) >= 3  # 64 holds all 63 rows


def test_empty_and_repeated_rows(spark, table):
    empty = frame(spark, table).limit(0)
    metrics, final = tr.train_heads(empty, [tr.HeadSetting("a", batch_size=4)], epochs=2)
    assert final["a"]["theta"] == [0.0] and metrics.filter("eval_loss = eval_loss and eval_loss is not null and not isnan(eval_loss)").count() == 0
    twice = frame(spark, table).unionByName(frame(spark, table))
    blocks = minibatch.packed(twice.filter("persuaded is not null").withColumnRenamed("id", "key"), "features", "persuaded", "split", "key", 16)
    rows = blocks.collect()
    assert sum(len(r["keys"]) for r in rows) == 180 and max(len(r["keys"]) for r in rows) == 16
