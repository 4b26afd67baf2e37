"""Grid search (GRD01-03).

GRD01 expands a grid config (``{"method": "grid", "metric": {...},
"parameters": {p: {"value": x} | {"values": [...]}}}``) into a settings table:
the Cartesian product comes from chained ``explode`` calls (no cross join), and
each combination is laid over the defaults; keys unknown to the defaults pass
through.  GRD02 trains every setting in one pass per epoch (``train_heads``);
GRD03 summarises runs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suasion.operators.train import HeadSetting, train_heads

# The reference's default training settings (modelling keys only).
DEFAULTS = {
    "seed": 42, "lr": 0.001, "batch_size": 64, "epochs": 30, "luar_max_length": 512,
    "combine_method": "average", "include_prompt": False, "weight_decay": 0.0, "only_luar": False,
    "classifier_output_dim": 2, "patience": 3, "min_delta": 0.0, "load_best_model": True,
}


def _values(spec: dict) -> list:
    if "values" in spec:
        return list(spec["values"])
    if "value" in spec:
        return [spec["value"]]
    raise ValueError(f"parameter needs 'value' or 'values': {spec}")


def expand_grid(spark: SparkSession, config: dict, defaults: dict | None = None) -> DataFrame:
    """Settings table ``(run_id, settings map<string,string>)``; values JSON-encoded."""
    if config.get("method", "grid") != "grid":
        raise ValueError("only method 'grid' is supported")
    defaults = dict(DEFAULTS if defaults is None else defaults)
    params = config.get("parameters", {})
    df = spark.range(1).select(F.create_map(*[x for k, val in sorted(defaults.items())
                                             for x in (F.lit(k), F.lit(json.dumps(val)))]).alias("base"))
    names = sorted(params)
    for i, p in enumerate(names):
        df = df.withColumn(f"_p{i}", F.explode(F.array(*[F.lit(json.dumps(x)) for x in _values(params[p])])))
    over = F.create_map(*[x for i, p in enumerate(names) for x in (F.lit(p), F.col(f"_p{i}"))]) if names \
        else F.create_map().cast("map<string,string>")
    # overlay: grid values win over defaults without relying on the duplicate-key policy
    merged = F.map_concat(F.map_filter("base", lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)
    out = df.select(merged.alias("settings"))
    key = F.to_json(F.map_entries(F.map_filter("settings", lambda k, _: F.array_contains(
        F.array(*[F.lit(p) for p in names]) if names else F.array().cast("array<string>"), k))))
    return out.select(F.md5(key).substr(1, 8).alias("run_id"), "settings")


# Settings that the trainer of frozen vectors cannot obey (kept as defaults, refused otherwise).
FIXED_SETTINGS = ("luar_max_length", "classifier_output_dim")


def settings_to_heads(settings: DataFrame) -> list[HeadSetting]:
    """The settings table is small (one row per run: the product of value lists).  A setting that
    cannot act here raises."""
    heads = []
    for r in settings.orderBy("run_id").collect():
        s = {k: json.loads(v) for k, v in r["settings"].items()}
        odd = [k for k in s if k not in DEFAULTS] + [k for k in FIXED_SETTINGS if s.get(k, DEFAULTS[k]) != DEFAULTS[k]]
        if odd:
            raise ValueError(f"settings without effect on this trainer: {sorted(odd)}")
        s = DEFAULTS | s
        heads.append(HeadSetting(r["run_id"], lr=float(s["lr"]), weight_decay=float(s["weight_decay"]),
                                 patience=int(s["patience"]), min_delta=float(s["min_delta"]), epochs=int(s["epochs"]),
                                 load_best=bool(s["load_best_model"]), batch_size=int(s["batch_size"]), seed=int(s["seed"]), extra=s))
    return heads


def run_features(setting: dict):
    """The vector a run trains on, from columns style_m, content_m and, with the prompt, style_c, content_c."""
    from suasion.operators.features import vec_average, vec_concat, vec_sum
    parts = ["style"] if setting["only_luar"] else ["style", "content"]
    sides = ["c", "m"] if setting["include_prompt"] else ["m"]
    how = setting["combine_method"]
    if how == "concat":
        return vec_concat(*[f"{p}_{s}" for p in parts for s in sides])
    if how not in ("average", "sum"):
        raise ValueError(f"no combine_method is called {how!r}")
    if len(sides) == 1:
        return vec_concat(*[f"{p}_m" for p in parts])
    pairwise = vec_average if how == "average" else vec_sum  # prompt with message, per encoder
    return F.concat(*[pairwise(f"{p}_c", f"{p}_m") for p in parts])


def run_grid(df: DataFrame, settings: DataFrame, label: str = "persuaded", split: str = "split",
             features: str | None = None) -> tuple[DataFrame, dict]:
    """GRD02: runs that share a feature vector are trained together; each obeys its own epochs, patience,
    step, penalty and choice of best or last epoch.  ``features``: one ready vector column for all runs,
    where no run may ask for another combination.  Returns epoch metrics per run and the final states."""
    heads = settings_to_heads(settings)
    by_vector: dict[tuple, list[HeadSetting]] = {}
    keys = ("only_luar", "include_prompt", "combine_method")
    for h in heads:
        if features and any(h.extra[k] != DEFAULTS[k] for k in keys):
            raise ValueError("one ready vector can't be combined in several ways")
        by_vector.setdefault(tuple(h.extra[k] for k in keys), []).append(h)
    metrics, final = None, {}
    for group in by_vector.values():
        vector = F.col(features) if features else run_features(group[0].extra)
        data = df.select(vector.alias("_v"), label, split)
        part, states = train_heads(data, group, "_v", label, split)
        metrics = part if metrics is None else metrics.unionByName(part)
        final |= states
    return metrics, final


def summarize_runs(metrics: DataFrame, metric: str = "eval_acc", maximize: bool = True) -> DataFrame:
    """GRD03: per run the best-epoch row by ``metric`` (ties → earlier epoch), ranked."""
    order = F.struct((F.col(metric) if maximize else -F.col(metric)).alias("m"), (-F.col("epoch")).alias("e"))
    best = metrics.groupBy("run_id").agg(F.max_by(F.struct(*metrics.columns), order).alias("b"))
    out = best.select("b.*")
    return out.orderBy(F.desc(metric) if maximize else F.asc(metric), "run_id")


def feature_model_table(metrics: DataFrame, metric: str = "roc_auc", row: str = "feature_set",
                        col: str = "model") -> DataFrame:
    """GRD03: feature set × model table of one metric (models as columns), ranked by the
    best value in the row.  The model list is the distinct values (a handful)."""
    models = sorted(r[0] for r in metrics.select(col).distinct().collect())
    wide = metrics.groupBy(row).pivot(col, models).agg(F.first(metric))
    best = F.greatest(*[F.col(m) for m in models]) if len(models) > 1 else F.col(models[0])
    return wide.withColumn("best", best).orderBy(F.desc("best"), F.asc(row))
