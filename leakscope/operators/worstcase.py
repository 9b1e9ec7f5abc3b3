"""Worst-case membership inference: an attack model that learns membership from the target's probabilities.

All repetitions are scored into one long table and measured in one pass of the
metric engine. Folds are the same for tuning and for the repetitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import argmax, sorted_probs
from leakscope.operators import metrics, models, sampling, significance
from leakscope.session import cut_lineage


def attack_features(records: DataFrame, sort_probs: bool = True, with_correct: bool = False) -> DataFrame:
    """(record_id, is_member, features): probabilities, sorted if wanted, and the flag of a correct prediction last."""
    correct = argmax(F.col("probs")) == F.col("y") if with_correct else None
    values = sorted_probs(F.col("probs"), correct) if sort_probs else F.col("probs") if correct is None else F.concat("probs", F.array(correct.cast("double")))
    return records.filter("probs is not null and is_member is not null").select("record_id", "is_member", values.alias("features"))


def yeom(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rates of the attack that calls a record a member if the target predicts it right; not rounded, signed."""
    correct = F.when(argmax(F.col("probs")) == F.col("y"), 1.0).otherwise(0.0)
    share = lambda m: F.avg(F.when(F.col("is_member") == m, correct))
    out = records.filter("probs is not null and y is not null and is_member is not null").groupBy(*(keys or [])).agg(share(1).alias("tpr"), share(0).alias("fpr"))
    return out.withColumn("advantage", F.col("tpr") - F.col("fpr"))


def tuning_grid(**options: list) -> list[dict]:
    """All combinations of the options."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())] if options else [{}]


def attack(records: DataFrame, n_reps: int = 10, test_prop: float = 0.2, seed: int = 10, model: str = "RandomForestClassifier", params: dict | None = None, **features) -> DataFrame:
    """`scored` of all repetitions (keys: rep): test records of every repetition scored by its attack model."""
    rows = attack_features(records, **features)
    folds = cut_lineage(sampling.repeated_splits(rows, ["is_member"], test_prop, "record_id", sampling.split_seeds(seed, n_reps)))
    settings = params if params is not None else (models.ATTACK_FOREST if model == "RandomForestClassifier" else {})
    out = None
    for rep in range(n_reps):
        fold = folds.filter(F.col("rep") == rep)
        fitted = models.fit(fold.filter("not in_test"), model, y="is_member", **settings)
        part = models.score(fitted, fold.filter("in_test"), y="is_member")
        part = part.select("rep", "record_id", "is_member", F.get("probs", F.lit(0)).alias("s0"), F.get("probs", F.lit(1)).alias("s1"))
        out = part if out is None else out.unionByName(part)
    return cut_lineage(out)


#: The parameters searched for an attack model unless others are named.
GRIDS = {
    "RandomForestClassifier": {"numTrees": [50, 100], "maxDepth": [3, 5], "minInstancesPerNode": [5, 10]},
    "MultilayerPerceptronClassifier": {"maxIter": [50, 100]},
    "LogisticRegression": {"regParam": [0.0, 0.01, 0.1]},
}


def random_grid(n: int, seed: int = 0, **options: list) -> list[dict]:
    """n different combinations of the options, drawn by hash; all of them if there are not more."""
    every = tuning_grid(**options)
    drawn = sorted(range(len(every)), key=lambda i: hashlib.blake2b(f"{seed}/{i}".encode(), digest_size=8).digest())
    return [every[i] for i in sorted(drawn[:n])]


def tuned(records: DataFrame, grid: list[dict], metric: str | Callable[[], Column] = "auc", **settings) -> dict:
    """The parameters of the best mean metric over the repetitions' folds; the first wins a tie.

    metric: a column of the metrics, or a function that makes one of them, as F.col("tpr") - F.col("fpr").
    """
    value = F.col(metric) if isinstance(metric, str) else metric()
    best: tuple[float, dict] | None = None
    for params in grid:
        runs = metrics.metrics(attack(records, params=params, **settings), ["rep"], p_values=not isinstance(metric, str) or metric == "p_higher_auc")
        mean = runs.agg(F.avg(value)).first()[0] or 0.0
        if best is None or mean > best[0]:
            best = mean, params
    return best[1] if best else {}


def summary(runs: DataFrame, keys: list[str], alpha: float = significance.P_THRESH) -> DataFrame:
    """Of each set of repetitions (rows of metrics): corrected counts of significant AUCs, and the null range of the first."""
    counts = significance.corrected(runs, keys, alpha=alpha).select(*keys, "n_total", "n_significant", "n_step_up")
    first = runs.groupBy(*keys).agg(F.min_by(F.struct("n_pos", "n_neg"), "rep").alias("first"))
    sd = F.sqrt(metrics.null_auc_variance(F.lit(0.5), F.col("first.n_pos"), F.col("first.n_neg")))
    return counts.join(first.select(*keys, significance.null_range(sd).alias("null_auc_range")), keys)


def report(records: DataFrame, n_dummy_reps: int = 1, **settings) -> DataFrame:
    """Metrics of every repetition, dummy baselines (under kind 'dummy') included."""
    runs = attack(records, **settings).withColumn("kind", F.lit("attack"))
    sizes = records.filter("probs is not null").agg(F.count_if(F.col("is_member") == 1).alias("p"), F.count_if(F.col("is_member") == 0).alias("n")).first()
    if n_dummy_reps:
        dummy = sampling.dummy_scores(records.sparkSession, sizes.p, sizes.n, n_dummy_reps).withColumn("kind", F.lit("dummy"))
        runs = runs.unionByName(dummy)
    return metrics.metrics(runs, ["kind", "rep"])
