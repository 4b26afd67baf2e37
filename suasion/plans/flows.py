"""End-to-end flows of SURVEY §3, composed only of the operators.

Flow A (feature path): pairs → time cut → group holdout (checked disjoint) → group folds →
pair melt → split files → message table → encode message and claim (style / content) → long
feature tables → z-score → PCA → 1-gram threshold → k-fold classifiers over the fold column
→ accuracy, macro-F1, ROC-AUC and most-frequent-class accuracy per feature set and model,
plus ROC-AUC on both held-out sets.

Flow B (trainer): labelled messages → three-way split by claim → frozen vectors of
claim and message (style, content) → concatenation [style, content], each [claim,
message] → head trained with Adam and early stopping → metrics of the best epoch on
validation and test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.functions.numeric import utc_cutoff
from suasion.operators import encode as en
from suasion.operators import evaluate as ev
from suasion.operators import features as fe
from suasion.operators import relational as rel
from suasion.operators import shape as sh
from suasion.operators import splits as sp
from suasion.operators import train as tr
from suasion.operators.skew import key_join
from suasion.plans import views as v
from suasion.session import checkpointed, scratch_path
from suasion.sources import files as io


def _message_table(spark: SparkSession, sf_dir: str, cutoff: int) -> DataFrame:
    """Stages 1-7: the message table (D3) with its split, from written split files."""
    in_time, out_time = rel.time_cut(v.pairs(spark, sf_dir), cutoff, "claim_created_utc")
    held = checkpointed(sp.group_holdout(in_time, "claim_id"))
    test, train = held.filter("held_out").drop("held_out"), held.filter(~F.col("held_out")).drop("held_out")
    rel.assert_disjoint(train, test, "claim_id")
    none = F.lit(None).cast("int")
    parts = {"train": sp.group_kfold(train, "claim_id", 5, fold_col="folds_col"),
             "test_in_time": test.withColumn("folds_col", none), "test_out_of_time": out_time.withColumn("folds_col", none)}
    rows = None
    for name, part in parts.items():
        one = sh.melt_pairs(part, folds_col="folds_col").withColumn("split", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    # a turn can answer several claims: the message id names both
    rows = rows.withColumn("message_id", F.concat("claim_id", F.lit(">"), "message_id"))
    path = scratch_path(spark, "flow-a-splits")
    io.write_json_splits(rows, path, "split")
    back = spark.read.schema(rows.schema).json(path)
    table = sh.to_message_table(back.withColumnRenamed("split", "_split")).alias("t")
    out = scratch_path(spark, "flow-a-messages")
    io.replace_table(table.select("t.*"), out, cluster_by=["message_id"])
    return spark.read.parquet(out).join(back.select("message_id", "split"), "message_id")


def flow_a(spark: SparkSession, sf_dir: str, cutoff: int | None = None, dim: int = 32, components: int = 8,
           min_tokens: int = 10, models: tuple[str, ...] = ("lr", "etc")) -> DataFrame:
    msgs = checkpointed(_message_table(spark, sf_dir, cutoff if cutoff is not None else utc_cutoff(2024, 1, 4)))
    grams = rel.ngram_counts(msgs, "message", "message_id")
    kept = rel.keep_frequent_groups(msgs.select(F.col("message_id").alias("group_id"), "persuaded", "folds_col", "split"),
                                    grams, min_tokens)
    data = kept
    for who in ("message", "claim"):
        for family in ("style", "content"):
            long = sh.vector_to_long(en.encode(msgs, who, "message_id", family, dim).withColumnRenamed("message_id", "group_id"))
            path = scratch_path(spark, f"flow-a-{who}-{family}")
            io.replace_table(long, path, cluster_by=["group_id", "feat"])
            dense, _ = fe.zscore_dense_vectors(io.read_feature_table(spark, path))
            reduced = fe.pca_dense(dense, components).withColumnRenamed("features", f"{who}_{family}")
            data = data.join(reduced, "group_id")
    data = checkpointed(data)  # every fold, set and model re-reads these rows
    out = None
    for name, tables in fe.FEATURE_SETS.items():
        rows = data.select("group_id", "persuaded", "folds_col", "split", fe.vec_concat(*tables).alias("features"))
        train = rows.filter(F.col("split") == "train")
        for model in models:
            params = {} if model == "lr" else {"trees": 20, "max_depth": 5}
            folds = tr.kfold_scores(train, "folds_col", "features", "persuaded", model, keep=["persuaded"], **params)
            whole = tr.fit(train, "features", "persuaded", model, **params)
            held = tr.score(whole, rows.filter(F.col("split") != "train"), "features", ["persuaded", "split"])
            s = folds.withColumn("split", F.lit("train")).unionByName(held).select(
                F.lit(name).alias("feature_set"), F.lit(model).alias("model"), *folds.columns, "split")
            out = s if out is None else out.unionByName(s)
    s = checkpointed(out)
    by = ["feature_set", "model"]
    train = s.filter(F.col("split") == "train")
    table = ev.accuracy(train, "persuaded", "pred", by)
    for more in (ev.macro_f1(train, "persuaded", "pred", by), ev.roc_auc(train, "persuaded", "p1", by),
                 ev.most_frequent_class(train, "persuaded", by)):
        table = table.join(more, by)
    for split in ("test_in_time", "test_out_of_time"):
        auc = ev.roc_auc(s.filter(F.col("split") == split), "persuaded", "p1", by).withColumnRenamed("roc_auc", f"auc_{split}")
        table = table.join(auc, by, "left")
    return table  # one row per feature set and model


def flow_b(spark: SparkSession, sf_dir: str, dim: int = 32, include_prompt: bool = True,
           epochs: int = 20, lr: float = 0.01, weight_decay: float = 0.0, patience: int = 3,
           min_delta: float = 0.0) -> DataFrame:
    msgs = v.messages(spark, sf_dir).filter(F.col("persuaded").isNotNull())
    split = checkpointed(sp.three_way_split(msgs, "claim_id"))
    claims = split.filter(F.col("claim_id").isNotNull()).groupBy("claim_id").agg(F.first("claim").alias("claim"))
    claim_vecs = claims.select("claim_id", en.style_column("claim", dim).alias("style_c"),
                               en.content_column("claim", dim).alias("content_c"))
    text = F.coalesce("message", F.lit(""))
    data = split.withColumn("message", text).select(
        "message_id", "claim_id", "persuaded", "split", en.style_column("message", dim).alias("style_m"),
        en.content_column("message", dim).alias("content_m"))
    cols = ["style_m", "content_m"]
    if include_prompt:
        data = key_join(data, claim_vecs, "claim_id", "inner")
        cols = ["style_c", "style_m", "content_c", "content_m"]
    data = checkpointed(data.select("message_id", "persuaded", "split", fe.vec_concat(*cols).alias("features")))
    setting = tr.HeadSetting("run", lr=lr, weight_decay=weight_decay, patience=patience, min_delta=min_delta)
    _, final = tr.train_heads(data, [setting], epochs=epochs)
    # logits of the antisymmetric head: l0 = -h, l1 = h with h = w·x + b
    h = data.select("split", "persuaded", tr.head_logit(final["run"]["theta"]).alias("l1"))
    base = ev.split_metrics(h.withColumn("l0", -F.col("l1")), "l0", "l1", "persuaded", ["split"])
    return base.select("split", "loss", "accuracy", "roc_auc",
                       F.lit(final["run"]["best_epoch"]).alias("best_epoch"),
                       F.lit(final["run"]["stopped_early"]).alias("stopped_early"))
