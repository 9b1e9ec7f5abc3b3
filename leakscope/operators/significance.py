"""Significance over repetitions: corrected counts, summaries and the recommendation.

Input is a frame of instances: key columns, auc, p_higher_auc, and others where named.
Defined results: null p-values are not significant and not counted in m; a group
without p-values has zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.operators import metrics
from leakscope.session import cut_lineage

P_THRESH = 0.05
#: Shares and bounds of the recommendation.
SIGNIFICANT_SHARE, MEAN_AUC, MIN_LEAF = 0.1, 0.65, 5
#: The reasons as a report prints them.
INSTANCE_MODELS = {"SVC": "Model is SVM", "KNeighborsClassifier": "Model is kNN"}
MANY_SIGNIFICANT, FEW_SIGNIFICANT = ">10% AUC are statistically significant", "<10% AUC are statistically significant"
HIGH_AUC, LOW_AUC = f"Attack AUC > threshold of {MEAN_AUC}", f"Attack AUC <= threshold of {MEAN_AUC}"
SMALL_LEAF, LARGE_LEAF = f"Min samples per leaf < {MIN_LEAF}", f"Min samples per leaf > {MIN_LEAF}"
SIGNIFICANT, NOT_SIGNIFICANT = "Significant at p={p:g}", "Not significant at p={p:g}"


def corrected(instances: DataFrame, keys: list[str], p: str = "p_higher_auc", alpha: float = P_THRESH) -> DataFrame:
    """Counts of significant p-values: uncorrected, step-up (largest rank that passes), rank by rank, and Bonferroni."""
    # ranks come from counts of distinct values: a value with n rows holds the ranks last - n + 1 .. last
    counts = instances.groupBy(*keys, F.col(p).cast("double").alias("value")).agg(F.count(p).alias("n_rows"))
    known = counts.filter("value is not null").select(*keys, (-F.col("value")).alias("s1"), F.col("n_rows").alias("p"), F.lit(0).cast("bigint").alias("n"))
    ranked = metrics.running_counts(cut_lineage(known), keys).select(*keys, (-F.col("s1")).alias("value"), F.col("p").alias("n"), F.col("cum_p").alias("last"), F.col("total_p").alias("m"))
    value, m = F.col("value"), F.col("m")
    passes = lambda rank: value <= rank / m * alpha
    near = F.ceil(value * m / alpha)
    least = F.when(passes(near - 1), near - 1).when(passes(near), near).otherwise(near + 1)  # the first rank that passes, rounding aside
    passing = F.greatest(F.lit(0), F.col("last") - F.greatest(least, F.col("last") - F.col("n") + 1) + 1)
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n_total"),
        F.sum(F.when(value <= alpha, F.col("n")).otherwise(0)).alias("n_significant"),
        F.coalesce(F.max(F.when(passing > 0, F.col("last"))), F.lit(0)).alias("n_step_up"),
        F.sum(passing).alias("n_bh"),
        F.sum(F.when(value <= alpha / m, F.col("n")).otherwise(0)).alias("n_bonferroni"),
    )
    return counts.select(*keys).distinct().join(sums, keys, "left").fillna(0)


def univariate(instances: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Least, largest, mean and median of each column."""
    return instances.groupBy(*keys).agg(
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", lambda x: F.percentile(x, F.lit(0.5))))]
    )


def display_summary(instances: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, variance and bounds over repetitions; pdif columns are shown as p-values."""
    shown = instances.withColumns({c: F.exp(-F.col(c)) for c in columns if c.startswith("pdif")})
    return shown.groupBy(*keys).agg(
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))]
    )


def pdif_p(pdif: Column) -> Column:
    """The p-value of a stored negative log."""
    return F.exp(-pdif)


def null_range(sd: Column) -> Column:
    """Three deviations around one half, as reports print it."""
    return F.format_string("%.4f -> %.4f", 0.5 - 3 * sd, 0.5 + 3 * sd)


def significance_text(p: Column, threshold: float = P_THRESH, strict: bool = False) -> Column:
    holds = p < threshold if strict else p <= threshold
    return F.when(holds, SIGNIFICANT.format(p=threshold)).otherwise(NOT_SIGNIFICANT.format(p=threshold))


def recommendation(instances: DataFrame, key: str = "experiment") -> DataFrame:
    """(experiment, bucket, reason): what speaks for or against release, each experiment by itself."""
    hit = F.col("p_higher_auc") < P_THRESH
    sums = instances.groupBy(key).agg((F.count_if(hit) / F.count(F.lit(1))).alias("share"), F.avg(F.when(hit, F.col("auc"))).alias("mean_auc"))
    many, high = F.col("share") > SIGNIFICANT_SHARE, F.col("mean_auc") > MEAN_AUC
    side = lambda c: F.when(c, "support_rejection").otherwise("support_release")
    reasons = [
        F.struct(side(many).alias("bucket"), F.when(many, MANY_SIGNIFICANT).otherwise(FEW_SIGNIFICANT).alias("reason")),
        F.struct(
            F.when(F.col("mean_auc").isNotNull(), side(high)).alias("bucket"),
            F.when(high, HIGH_AUC).otherwise(LOW_AUC).alias("reason"),
        ),
    ]
    return sums.select(key, F.explode(F.array(*reasons)).alias("r")).filter("r.bucket is not null").select(key, "r.bucket", "r.reason")


def model_recommendation(models: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, bucket, reason) of models (key, model_name, min_samples_leaf)."""
    named = F.coalesce(*[F.when(F.col("model_name") == m, F.lit(text)) for m, text in INSTANCE_MODELS.items()])
    leaf = F.col("min_samples_leaf")
    reasons = F.array(
        F.struct(F.when(named.isNotNull(), "immediate_rejection").alias("bucket"), named.alias("reason")),
        F.struct(F.when(leaf < MIN_LEAF, "support_rejection").when(leaf >= MIN_LEAF, "support_release").alias("bucket"), F.when(leaf < MIN_LEAF, SMALL_LEAF).otherwise(LARGE_LEAF).alias("reason")),
    )
    return models.select(key, F.explode(reasons).alias("r")).filter("r.bucket is not null").select(key, "r.bucket", "r.reason")


def leaderboard(runs: DataFrame, scenario: str = "scenario", attack: str = "attack", auc: str = "auc", seconds: str = "seconds") -> DataFrame:
    """(scenario, best, best_auc, fastest, least_seconds, best_rate): of each scenario the attack of largest auc, of least time, and of largest auc a second; ties go to the first name."""
    means = runs.groupBy(scenario, attack).agg(F.avg(auc).alias("auc"), F.avg(seconds).alias("seconds"))
    rate = F.col("auc") / F.when(F.col("seconds") > 0, F.col("seconds"))
    first = lambda value: F.min(F.struct(value.alias("v"), F.col(attack).alias("a")))
    top = means.groupBy(scenario).agg(first(-F.col("auc")).alias("b"), first(F.col("seconds")).alias("f"), F.min(F.when(rate.isNotNull(), F.struct((-rate).alias("v"), F.col(attack).alias("a")))).alias("r"))
    return top.select(scenario, F.col("b.a").alias("best"), (-F.col("b.v")).alias("best_auc"), F.col("f.a").alias("fastest"), F.col("f.v").alias("least_seconds"), F.col("r.a").alias("best_rate"))


def merged_reports(first: DataFrame, second: DataFrame, key: str, values: str = "values") -> DataFrame:
    """(key, values): maps of both sides, the second side's entries winning."""
    both = first.select(key, F.col(values).alias("ours")).join(second.select(key, F.col(values).alias("theirs")), key, "full_outer")
    entry = lambda c, only: F.map_filter(c, lambda k, _: only(k))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    ours, theirs = F.coalesce("ours", empty), F.coalesce("theirs", empty)
    return both.select(key, F.map_concat(entry(ours, lambda k: ~F.map_contains_key(theirs, k)), theirs).alias(values))
