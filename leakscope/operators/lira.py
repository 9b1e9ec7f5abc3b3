"""Likelihood-ratio scores from the confidences of shadow models.

`shadow` holds one row of a record and shadow model: model_idx, record_id, in_train,
conf (the logit of the true class; null where it is unknown). Means and standard
deviations in and out of training come from one aggregation by record; hot records
are combined before the shuffle.

Defined results: a record without in (or out) confidences has mean 0 and deviation
0; with fixed variance all records share the deviation of all confidences of that
side; records without a shadow row are scored against mean 0 and deviation 0;
records with a null target logit have null scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import EPS
from leakscope.functions.stats import log_density, normal_cdf, shapiro_p_of

MODES = ("offline", "offline-carlini", "online-carlini")


def shadow_stats(shadow: DataFrame, fix_variance: bool = False) -> DataFrame:
    """(record_id, in_mean, in_std, out_mean, out_std), population deviations."""
    conf = F.when(~F.isnan("conf"), F.col("conf"))
    side = lambda inside: F.when(F.col("in_train") == inside, conf)
    zero = F.lit(0.0)
    stats = shadow.groupBy("record_id").agg(
        *[F.coalesce(f(side(inside)), zero).alias(f"{name}_{what}") for name, inside in (("in", True), ("out", False)) for what, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    if not fix_variance:
        return stats
    whole = shadow.agg(*[F.coalesce(F.stddev_pop(side(inside)), zero).alias(f"all_{name}") for name, inside in (("in", True), ("out", False))])
    return stats.crossJoin(F.broadcast(whole)).select("record_id", "in_mean", F.col("all_in").alias("in_std"), "out_mean", F.col("all_out").alias("out_std"))


def offline_z(target: Column, mean: Column, std: Column) -> Column:
    """Standardised target logit."""
    return (target - mean) / (std + EPS)


def scores(targets: DataFrame, stats: DataFrame, mode: str = "offline") -> DataFrame:
    """targets (record_id, is_member, target_logit, ...) with s0 and s1 of the mode; s1 is the member score."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(MODES)}")
    filled = {c: 0.0 for c in ("in_mean", "in_std", "out_mean", "out_std")}
    both = targets.join(stats, "record_id", "left").fillna(filled)
    x = F.col("target_logit")
    out_density = log_density(x, F.col("out_mean"), F.col("out_std") + EPS)
    if mode == "offline":
        both = both.withColumn("s1", normal_cdf(offline_z(x, F.col("out_mean"), F.col("out_std"))))
        return both.withColumn("s0", 1 - F.col("s1"))
    if mode == "offline-carlini":
        s1 = -out_density
    else:
        s1 = log_density(x, F.col("in_mean"), F.col("in_std") + EPS) - out_density
    return both.withColumn("s1", s1).withColumn("s0", -F.col("s1"))


def normality(shadow: DataFrame) -> DataFrame:
    """(record_id, p_normal): Shapiro-Wilk of the out confidences; their number is that of the shadow models."""
    values = F.collect_list(F.when(~F.col("in_train") & ~F.isnan("conf"), F.col("conf")))
    return shadow.groupBy("record_id").agg(values.alias("out_conf")).select("record_id", shapiro_p_of("out_conf").alias("p_normal"))


def share_non_normal(normal: DataFrame) -> DataFrame:
    """One row n_normal: the share of records whose p is at most 0.05 (reports call it so, though these are not normal)."""
    return normal.agg(F.avg((F.col("p_normal") <= 0.05).cast("double")).alias("n_normal"))
