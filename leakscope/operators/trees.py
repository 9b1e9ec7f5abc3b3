"""Decision trees and forests of many targets at once, grown level by level from counts.

A key (a target, or a target and a shadow model) has a tree of its own. Each level counts
classes by key, node, feature and bin in one aggregate combined before its shuffle, so neither
the number of keys nor the size of one key's rows matters to a single task. Gini gain, at
most MAX_BINS bins a feature, midpoints between values where a feature has few.

Defined results: missing values are 0; rows without features or label grow no tree; keys without
rows have none, and rows of such keys are left out when placed; of equal gains the smaller
feature and the smaller threshold count; leaves of one parent that predict the same class become
one, as in pyspark.ml; probabilities end at the largest class of the key's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions.exprs import argmax
from leakscope.operators.sampling import hash_unit
from leakscope.session import broadcast_if_small, cut_lineage

#: Bins of a feature, as the trees of pyspark.ml have by default.
MAX_BINS = 32
#: Gains below this are rounding.
LEAST_GAIN = 1e-9


def filled(features: Column | str) -> Column:
    """Features with missing values as 0."""
    return F.transform(features, lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)))


def walk(x: Column, splits: Column, depth: int) -> Column:
    """The node that filled features reach: the root is 1, the children of n are 2n and 2n + 1."""
    if not depth:
        return F.lit(1)

    def step(node: Column, _: Column) -> Column:
        split = F.try_element_at(splits, node)
        right = F.coalesce(F.get(x, split["f"]), F.lit(0.0)) > split["t"]
        return F.when(split.isNotNull(), 2 * node + right.cast("int")).otherwise(node)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def thresholds(rows: DataFrame, keys: list[str], max_bins: int = MAX_BINS) -> DataFrame:
    """(keys, cuts): by feature the midpoints of its values, or quantiles if there are max_bins values or more."""
    values = rows.select(*keys, F.posexplode("x").alias("f", "v"))
    place = F.row_number().over(Window.partitionBy(*keys, "f").orderBy("v"))
    few = values.distinct().withColumn("place", place).filter(F.col("place") <= max_bins).groupBy(*keys, "f").agg(F.sort_array(F.collect_list("v")).alias("few"))
    steps = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    many = values.groupBy(*keys, "f").agg(F.percentile_approx("v", steps, 10_000).alias("many"))
    between = F.zip_with(F.slice("few", 1, F.size("few") - 1), F.slice("few", 2, F.size("few")), lambda a, b: (a + b) / 2)
    cut = F.when(F.size("few") < max_bins, F.filter(between, lambda c: c.isNotNull())).otherwise(F.array_distinct("many"))
    return few.join(many, [*keys, "f"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", cut.alias("cut")))).alias("cuts"))


def grow(rows: DataFrame, keys: list[str], max_depth: int, min_instances: int = 1, weight: Column | None = None, subset: bool = False, max_bins: int = MAX_BINS) -> DataFrame:
    """(keys, splits, probs): a tree of each key, as maps from a node to its split and to its class probabilities.

    With subset, a node considers the root of the number of features, drawn by hash.
    """
    weight = F.lit(1) if weight is None else weight
    rows = rows.dropna(subset=[*keys, "features", "y"]).select(*keys, F.col("y").cast("int").alias("y"), weight.cast("double").alias("w"), filled("features").alias("x")).filter("w > 0")
    cuts = cut_lineage(thresholds(rows, keys, max_bins))
    base = rows.join(broadcast_if_small(cuts), keys)
    base = cut_lineage(base.withColumn("bins", F.transform("x", lambda v, f: F.size(F.filter(F.try_element_at("cuts", f), lambda c: c < v)))).drop("cuts"))
    classes = range((base.agg(F.max("y")).first()[0] or 0) + 1)
    sums = [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)).alias(f"n{c}") for c in classes]
    counted = lambda name: F.array(*[F.col(f"{name}{c}") for c in classes])
    root = base.groupBy(*keys).agg(F.max("y").alias("last_class"), *sums).select(*keys, "last_class", F.create_map(F.lit(1), counted("n")).alias("counts"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<f:int,t:double>>"))
    trees = cut_lineage(root.join(cuts, keys).withColumn("splits", none))

    for depth in range(max_depth):
        at = base.join(broadcast_if_small(trees.select(*keys, "splits")), keys).withColumn("node", walk(F.col("x"), F.col("splits"), depth)).filter(F.col("node") >= 2**depth)
        pairs = F.transform("bins", lambda b, f: F.struct(f.alias("f"), b.alias("b")))
        if subset:
            drawn = F.array_sort(F.transform(pairs, lambda p: F.struct(F.xxhash64(*keys, "node", p["f"]).alias("h"), p.alias("p"))))
            pairs = F.transform(F.slice(drawn, 1, F.ceil(F.sqrt(F.size("bins"))).cast("int")), lambda d: d["p"])
        hist = at.select(*keys, "node", "y", "w", F.explode(pairs).alias("p")).groupBy(*keys, "node", F.col("p.f").alias("f"), F.col("p.b").alias("b")).agg(*sums)
        whole = Window.partitionBy(*keys, "node", "f")
        upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sides = hist.select(*keys, "node", "f", "b", *[F.sum(f"n{c}").over(upto).alias(f"l{c}") for c in classes], *[F.sum(f"n{c}").over(whole).alias(f"t{c}") for c in classes])
        sides = sides.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in classes})
        total = lambda name: sum((F.col(f"{name}{c}") for c in classes), F.lit(0.0))
        squares = lambda name: sum((F.col(f"{name}{c}") * F.col(f"{name}{c}") for c in classes), F.lit(0.0)) / total(name)
        sides = sides.filter((total("l") >= min_instances) & (total("r") >= min_instances) & (total("l") > 0) & (total("r") > 0))
        sides = sides.withColumn("gain", F.round(squares("l") + squares("r") - squares("t"), 9)).filter(F.col("gain") > LEAST_GAIN)
        best = sides.groupBy(*keys, "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), counted("l").alias("l"), counted("r").alias("r"))).alias("s"))
        found = best.groupBy(*keys).agg(F.collect_list(F.struct("node", (-F.col("s.f")).alias("f"), (-F.col("s.b")).alias("b"), "s.l", "s.r")).alias("found"))
        split = F.transform("found", lambda s: F.struct(s["node"], F.struct(s["f"].alias("f"), F.get(F.try_element_at("cuts", s["f"]), s["b"]).alias("t"))))
        left, right = F.transform("found", lambda s: F.struct(2 * s["node"], s["l"])), F.transform("found", lambda s: F.struct(2 * s["node"] + 1, s["r"]))
        grown = lambda old, *new: F.when(F.col("found").isNull(), F.col(old)).otherwise(F.map_concat(old, *[F.map_from_entries(n) for n in new]))
        trees = trees.join(found, keys, "left").withColumns({"splits": grown("splits", split), "counts": grown("counts", left, right)}).drop("found")
        trees = cut_lineage(trees)

    def shares(_: Column, n: Column) -> Column:
        size = F.aggregate(n, F.lit(0.0), lambda s, v: s + v)
        return F.transform(F.slice(n, 1, F.col("last_class") + 1), lambda v: v / size)

    def pruned(depth: int) -> Column:
        def kept(node: Column, _: Column) -> Column:
            ends = [F.try_element_at("splits", child).isNull() for child in (2 * node, 2 * node + 1)]
            same = argmax(F.try_element_at("counts", 2 * node)) == argmax(F.try_element_at("counts", 2 * node + 1))
            return ~((node >= 2**depth) & (node < 2 ** (depth + 1)) & ends[0] & ends[1] & same)

        return F.map_filter("splits", kept)

    for depth in reversed(range(max_depth)):
        trees = trees.withColumn("splits", pruned(depth))
    return cut_lineage(trees.select(*keys, "splits", F.transform_values("counts", shares).alias("probs")))


def planted(rows: DataFrame, trees: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the splits and node_probs of their key's tree."""
    return rows.join(broadcast_if_small(trees.withColumnRenamed("probs", "node_probs")), keys)


def placed(rows: DataFrame, depth: int) -> DataFrame:
    """Planted rows with leaf, probs and prediction."""
    out = rows.withColumn("leaf", walk(filled("features"), F.col("splits"), depth)).withColumn("probs", F.try_element_at("node_probs", F.col("leaf")))
    return out.withColumn("prediction", argmax(F.col("probs")))


def leaves(rows: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """rows with leaf, probs and prediction of a tree grown on the key's members."""
    return placed(planted(rows, grow(rows.filter("is_member = 1"), keys, max_depth), keys), max_depth).drop("splits", "node_probs")


def copies(record: Column, tree: Column) -> Column:
    """How often a record is drawn for a tree: Poisson with mean 1, by hash."""
    u, bounds = hash_unit(record, tree), [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    return sum(((u >= b).cast("int") for b in bounds), F.lit(0))


def forest_leaves(rows: DataFrame, keys: list[str], n_trees: int, max_depth: int) -> DataFrame:
    """rows with leaf, the array of leaves of a forest grown on the key's members."""
    drawn = rows.filter("is_member = 1").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    trees = grow(drawn, [*keys, "tree"], max_depth, weight=copies(F.col("record_id"), F.col("tree")), subset=True)
    forest = trees.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("tree", "splits"))).alias("forest"))
    x = filled("features")
    reached = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.coalesce(walk(x, F.try_element_at("forest", t), max_depth), F.lit(1)))
    return rows.join(broadcast_if_small(forest), keys).withColumn("leaf", reached).drop("forest")
