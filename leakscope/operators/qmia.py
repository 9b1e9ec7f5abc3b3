"""Quantile-regression membership scores: hinge scores against a threshold for each record.

Thresholds may be given, or come from a quantile tree: a regression tree of the
non-members' scores whose leaves give the quantile of the scores that fall in.

Defined results: records without a threshold or score have a null margin; no
non-members, or a threshold that does not vary beside the scores, is a degenerate
regressor; a leaf that no non-member reaches takes the quantile of all.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import hinge
from leakscope.operators import metrics
from leakscope.session import cut_lineage, small_side

ALPHA, Z95 = 0.01, 1.96


def hinge_scores(records: DataFrame) -> DataFrame:
    """records with score: the hinge of the true class."""
    return records.withColumn("score", hinge(F.col("probs"), F.col("y")))


def quantile_tree(records: DataFrame, alpha: float = ALPHA, max_depth: int = 5, min_rows: int = 20, seed: int = 0) -> DataFrame:
    """(record_id, is_member, score, threshold): features ARRAY<DOUBLE> and y predict the 1 - alpha quantile of the score.

    Trained on non-members. One tree; its leaves give the quantiles.
    """
    width = records.select(F.max(F.size("features"))).first()[0] or 0
    columns = [F.coalesce(F.get("features", F.lit(i)), F.lit(0.0)).alias(f"f{i}") for i in range(width)]
    flat = records.filter("score is not null and y is not null").select("record_id", "is_member", "score", F.col("y").cast("double").alias("f_y"), *columns)
    assembled = VectorAssembler(inputCols=["f_y", *[f"f{i}" for i in range(width)]], outputCol="vec").transform(flat).select("record_id", "is_member", "score", "vec")
    others = assembled.filter("is_member = 0")
    if not others.limit(1).count():
        return assembled.select("record_id", "is_member", "score", F.lit(None).cast("double").alias("threshold"))
    tree = DecisionTreeRegressor(featuresCol="vec", labelCol="score", maxDepth=max_depth, minInstancesPerNode=min_rows, leafCol="leaf", seed=seed).fit(others)
    placed = tree.transform(assembled).select("record_id", "is_member", "score", "leaf")
    return leaf_thresholds(cut_lineage(placed), alpha).select("record_id", "is_member", "score", "threshold")


def leaf_thresholds(placed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """placed (leaf, is_member, score) with threshold: the 1 - alpha quantile of the leaf's non-members, of all where it has none.

    The quantile is the smallest score that so many do not exceed, found from running counts of distinct scores, whatever the size of a leaf.
    """
    others = placed.filter("is_member = 0 and score is not null and leaf is not null")
    own = cut_lineage(others.groupBy("leaf", (-F.col("score")).alias("s1")).agg(F.count(F.lit(1)).alias("p"), F.lit(0).cast("bigint").alias("n")))
    reached = F.col("cum_p") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("total_p") * (1 - alpha), 9)))
    leaves = metrics.running_counts(own, ["leaf"]).filter(reached).groupBy("leaf").agg(F.min(-F.col("s1")).alias("own"))
    every = cut_lineage(own.groupBy("s1").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("whole", F.lit(0)))
    whole = metrics.running_counts(every, ["whole"]).filter(reached).agg(F.min(-F.col("s1")).alias("every"))
    joined = placed.join(small_side(leaves), "leaf", "left").crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn("threshold", F.coalesce("own", "every")).drop("own", "every")


def margins(df: DataFrame) -> DataFrame:
    """df with margin = score - threshold, s0 = -margin and s1 = margin."""
    margin = F.col("score") - F.col("threshold")
    return df.withColumns({"margin": margin, "s0": -margin, "s1": margin})


def calibration(df: DataFrame, keys: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Observed false-positive rate of the margins of non-members, and whether it fits alpha."""
    margin = F.when(F.col("is_member") == 0, F.col("margin"))
    out = df.groupBy(*(keys or [])).agg(F.avg((margin > 0).cast("double")).alias("observed_fpr"), F.count(margin).alias("n_non_members"))
    allowed = F.lit(Z95) * F.sqrt(F.lit(alpha * (1 - alpha)) / F.when(F.col("n_non_members") > 0, F.col("n_non_members")))
    return out.withColumn("calibrated", F.abs(F.col("observed_fpr") - alpha) <= allowed)


def degenerate(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether the thresholds hardly vary beside the scores of non-members."""
    score = F.when(F.col("is_member") == 0, F.col("score"))
    spread = F.stddev_pop("threshold"), F.stddev_pop(score)
    floor: Column = F.greatest(F.lit(1e-10), 1e-6 * spread[1])
    return df.groupBy(*(keys or [])).agg(F.coalesce(spread[0] < floor, F.lit(True)).alias("degenerate"))
