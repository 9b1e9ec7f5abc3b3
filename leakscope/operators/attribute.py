"""Attribute inference: what a model's confidence over candidate values tells of a missing attribute.

Candidates are few (the distinct values of one feature, or a grid), so each sample
is exploded over an array literal of them; no table is crossed with another.

Defined results: samples without features are left out, and so are samples whose
value is missing where a grid is swept; a feature without values
gives no rows; the baseline of a feature with null values counts them as a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import argmax, linspace
from leakscope.operators import models, trees
from leakscope.session import small_side

#: Distinct values of a categorical feature beyond which the sweep is refused.
MAX_VALUES = 10_000
GRID, LIMIT = 100, 0.1


def feature_values(records: DataFrame, feature: Column) -> list:
    """Sorted distinct values of a feature over both splits; bounded by MAX_VALUES."""
    rows = records.select(feature.alias("v")).filter("v is not null").distinct().limit(MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values: treat the feature as quantitative")
    return sorted(r.v for r in rows)


def baseline(records: DataFrame, feature: Column, keys: list[str] | None = None) -> DataFrame:
    """Share (percent) of the most frequent value of a feature, and the number of values and rows."""
    keys = list(keys or [])
    counts = records.groupBy(*keys, feature.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg((F.max("n") / F.sum("n") * 100).alias("baseline"), F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_rows"))


def one_hot_candidates(records: DataFrame, feature: Column, values: list) -> DataFrame:
    """Every record with every candidate value: candidate_no, candidate, and its one-hot vector."""
    options = F.array(*[F.struct(F.lit(i).alias("candidate_no"), F.lit(v).alias("candidate")) for i, v in enumerate(values)])
    exploded = records.withColumn("actual", feature).withColumn("option", F.explode(options)).select("*", "option.*").drop("option")
    hot = F.transform(F.sequence(F.lit(0), F.lit(len(values) - 1)), lambda i: F.when(i == F.col("candidate_no"), 1.0).otherwise(0.0))
    return exploded.withColumn("one_hot", hot)


def substituted(features: Column, indices: list[int], values: Column) -> Column:
    """features with the columns of one feature replaced by an array of values."""
    places = F.array(*map(F.lit, indices))
    return F.transform(features, lambda x, at: F.when(F.array_contains(places, at), F.get(values, F.array_position(places, at).cast("int") - 1)).otherwise(x))


def infer_categorical(scored: DataFrame, threshold: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Per record from candidate scores (record_id, is_member, label, candidate, actual, probs): inferred and correct.

    A candidate counts if the model still predicts the record's label; the attribute is inferred
    if one candidate alone has the highest confidence and it reaches the threshold.
    """
    kept = scored.withColumn("conf", F.when(argmax(F.col("probs")) == F.col("label"), F.get("probs", F.col("label"))))
    keys = list(keys or [])
    best = kept.groupBy(*keys, "record_id", "is_member").agg(
        F.max("conf").alias("top"), F.max_by("candidate", "conf").alias("guess"), F.max("actual").alias("actual"), F.sort_array(F.collect_list("conf"), asc=False).alias("confs")
    )
    alone = F.size(F.filter("confs", lambda c: c == F.col("top"))) == 1
    inferred = F.coalesce((F.col("top") >= threshold) & alone, F.lit(False))
    return best.select(*keys, "record_id", "is_member", inferred.alias("inferred"), (inferred & (F.col("guess") == F.col("actual"))).alias("correct"))


def categorical_attack(records: DataFrame, model, feature_index: list[int], values: list, feature: Column, threshold: float = 0.0) -> DataFrame:
    """infer_categorical of a feature that occupies feature_index (one-hot, or one column holding the value)."""
    base = models.score(model, records.filter("features is not null")).withColumnRenamed("prediction", "label").drop("probs")
    swept = one_hot_candidates(base, feature, values)
    new = F.col("one_hot") if len(feature_index) > 1 else F.array(F.col("candidate").cast("double"))
    swept = swept.withColumn("features", substituted(F.col("features"), feature_index, new))
    return infer_categorical(models.score(model, swept), threshold)


def risk_totals(inferred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """correct, total inferred and records per split."""
    return inferred.groupBy(*(keys or []), "is_member").agg(F.count_if("correct").alias("n_correct"), F.count_if("inferred").alias("n_inferred"), F.count(F.lit(1)).alias("n_records"))


def risk_report(inferred: DataFrame, records: DataFrame, feature: Column, keys: list[str] | None = None) -> DataFrame:
    """risk_totals with the baseline (percent of the most frequent value) and number of values of the feature in the split."""
    own = [*(keys or []), "is_member"]
    base = baseline(records, feature, own).drop("n_rows")
    return risk_totals(inferred, keys).join(base, own, "left")


def swept_risk(rows: DataFrame, score: Callable[[Column], Column], low: Column, high: Column, n_points: int = GRID, limit: float = LIMIT) -> DataFrame:
    """rows (with actual, null where it is missing) with at_risk: a grid from low to high is scored within its row, so nothing is shuffled.

    Missing values are never at risk.
    """
    points = F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), lambda e: linspace(e["low"], e["high"], n_points))[0]
    swept = rows.withColumn("sweep_points", points)
    swept = swept.withColumn("sweep_scores", F.transform("sweep_points", score))
    actual = F.when(~F.isnan("actual"), F.col("actual"))
    risk = F.when(actual.isNotNull(), bounds_risk(actual, F.col("sweep_points"), F.col("sweep_scores"), score(actual), limit)).otherwise(False)
    return swept.withColumn("at_risk", risk).drop("sweep_points", "sweep_scores")


def bounds_risk(actual: Column, points: Column, scores: Column, actual_score: Column, limit: float = LIMIT) -> Column:
    """At risk: the true value has the peak confidence, and all peak values lie within limit of it (negative values never)."""
    peak = F.array_max(scores)
    at = F.filter(F.zip_with(points, scores, lambda x, s: F.when(s >= peak, x)), lambda x: x.isNotNull())
    low, high = at[0], F.element_at(at, -1)
    return F.coalesce((peak > 0) & (actual_score == peak) & (low >= (1 - limit) * actual) & (high <= (1 + limit) * actual), F.lit(False))


def quantitative_attack(records: DataFrame, model, index: int, n_points: int = GRID, limit: float = LIMIT) -> DataFrame:
    """(record_id, is_member, at_risk): the grid between the feature's smallest and largest value swept for every record."""
    value = F.get("features", F.lit(index))
    # a missing value has no bounds: it must not stretch the grid, and the sweep says nothing of it
    rows = records.filter("features is not null").withColumn("actual", F.when(~F.isnan(value), value)).filter("actual is not null")
    ends = rows.agg(F.min("actual").alias("low"), F.max("actual").alias("high"))
    rows = models.score(model, rows).withColumn("label", F.col("prediction")).withColumn("actual_score", F.get("probs", F.col("label"))).drop("probs", "prediction")
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("points", linspace(F.col("low"), F.col("high"), n_points))
    swept = rows.select("*", F.posexplode("points").alias("at", "point")).withColumn("features", substituted(F.col("features"), [index], F.array("point")))
    scored = models.score(model, swept).withColumn("s", F.get("probs", F.col("label")))
    back = scored.groupBy("record_id", "is_member").agg(
        F.sort_array(F.collect_list(F.struct("at", "point", "s"))).alias("sweep"), F.max("actual").alias("actual"), F.max("actual_score").alias("actual_score")
    )
    points, scores = F.transform("sweep", lambda x: x["point"]), F.transform("sweep", lambda x: x["s"])
    return back.select("record_id", "is_member", bounds_risk(F.col("actual"), points, scores, F.col("actual_score"), limit).alias("at_risk"))


def last_value_attack(records: DataFrame, grown: DataFrame, keys: list[str], depth: int, threshold: float = 0.0) -> DataFrame:
    """infer_categorical of the last feature of every key, by the key's own tree and over the key's own values."""
    last = F.element_at("features", -1)
    known = records.filter(last.isNotNull() & ~F.isnan(last)).withColumn("actual", last)
    values = known.groupBy(*keys, "actual").agg(F.count(F.lit(1)).alias("n"))
    crowded = values.groupBy(*keys).count().filter(F.col("count") > MAX_VALUES).first()
    if crowded:
        raise ValueError(f"more than {MAX_VALUES} values: treat the feature as quantitative")
    values = values.groupBy(*keys).agg(F.sort_array(F.collect_list("actual")).alias("values"))
    base = trees.placed(trees.planted(known, grown, keys), depth).withColumn("label", F.col("prediction")).drop("leaf", "probs", "prediction")
    swept = base.join(small_side(values), keys).withColumn("candidate", F.explode("values")).drop("values")
    swept = swept.withColumn("features", F.concat(F.slice("features", 1, F.size("features") - 1), F.array("candidate")))
    return infer_categorical(trees.placed(swept, depth), threshold, keys)


def first_value_bounds(records: DataFrame, grown: DataFrame, keys: list[str], depth: int, index: int = 0, n_points: int = GRID, limit: float = LIMIT) -> DataFrame:
    """quantitative_attack of every key by the key's own tree; a grid is swept within its row. Records whose value is missing are not at risk."""
    value = F.get("features", F.lit(index))
    rows = records.withColumn("actual", F.when(~F.isnan(value), value))
    ends = rows.groupBy(*keys).agg(F.min("actual").alias("low"), F.max("actual").alias("high"))
    rows = trees.placed(trees.planted(rows, grown, keys), depth).withColumn("actual_score", F.get("probs", F.col("prediction"))).join(small_side(ends), keys)
    rows = rows.withColumns({"points": linspace(F.col("low"), F.col("high"), n_points), "x": trees.filled("features")})
    at = lambda p: trees.walk(F.transform("x", lambda v, i: F.when(i == index, p).otherwise(v)), F.col("splits"), depth)
    rows = rows.withColumn("scores", F.transform("points", lambda p: F.get(F.try_element_at("node_probs", at(p)), F.col("prediction"))))
    return rows.select(*keys, "record_id", "is_member", bounds_risk(F.col("actual"), F.col("points"), F.col("scores"), F.col("actual_score"), limit).alias("at_risk"))


def bounds_fraction(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of records at risk per split."""
    return found.groupBy(*(keys or []), "is_member").agg(F.avg(F.col("at_risk").cast("double")).alias("risk_fraction"))
