"""Hyper-parameter rules and tamper checks as joins over a rules table.

rules: model_type, rule_id, parent_id (of an and/or group, else null), operator
(min, max, equals, is_type, and, or), keyword, value (text). params: model_id,
model_type, keyword, value (text), value_type. Groups hold leaf rules.

Defined results: a parameter that is absent or of the wrong kind for min and max is
disclosive; an unknown operator is reported and not disclosive; an or-group is
disclosive only if all its rules are; an and-group if any is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shipped rule base (model type, rule, group, operator, keyword, value).
SHIPPED = [
    ("DecisionTreeClassifier", 1, None, "and", None, None),
    ("DecisionTreeClassifier", 2, 1, "is_type", "min_samples_leaf", "int"),
    ("DecisionTreeClassifier", 3, 1, "min", "min_samples_leaf", "5"),
    ("RandomForestClassifier", 1, None, "and", None, None),
    ("RandomForestClassifier", 2, 1, "equals", "bootstrap", "true"),
    ("RandomForestClassifier", 3, 1, "min", "min_samples_leaf", "5"),
    ("SVC", 1, None, "and", None, None),
    ("SVC", 2, 1, "min", "dhat", "1000"),
    ("SVC", 3, 1, "min", "C", "1"),
    ("SVC", 4, 1, "min", "eps", "10"),
    ("SVC", 5, 1, "min", "gamma", "0.1"),
]
#: The recommendation as a report prints it.
RELEASE, REFUSE = "Proceed to release", "Do not allow release"
_SCHEMA = "model_type string, rule_id int, parent_id int, operator string, keyword string, value string"


def shipped_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHIPPED, _SCHEMA)


def _breaks(operator: Column, current: Column, wanted: Column, kind: Column) -> Column:
    number, bound = current.try_cast("double"), wanted.try_cast("double")
    return (
        F.when(operator == "min", number.isNull() | (number < bound))
        .when(operator == "max", number.isNull() | (number > bound))
        .when(operator == "equals", ~current.eqNullSafe(wanted))
        .when(operator == "is_type", ~kind.eqNullSafe(wanted))
        .otherwise(F.lit(False))
    )


def check_leaves(params: DataFrame, rules: DataFrame) -> DataFrame:
    """Every leaf rule of every model: current value, and whether it is disclosive."""
    models = params.select("model_id", "model_type").distinct()
    leaf = rules.filter(~F.col("operator").isin("and", "or"))
    wanted = models.join(leaf.withColumnRenamed("value", "rule_value"), "model_type")
    found = wanted.join(params.select("model_id", "keyword", "value", "value_type"), ["model_id", "keyword"], "left")
    broken = _breaks(F.col("operator"), F.col("value"), F.col("rule_value"), F.col("value_type"))
    message = F.when(
        F.col("operator").isin("min", "max", "equals", "is_type"),
        F.when(broken, F.format_string("- %s is %s, which breaks %s %s", "keyword", F.coalesce("value", F.lit("nothing")), "operator", "rule_value")),
    ).otherwise(F.format_string("- the rule's operator %s is not known", "operator"))
    return found.select("model_id", "model_type", "rule_id", "parent_id", "operator", "keyword", "value", "rule_value", broken.alias("disclosive"), message.alias("message"))


def check(params: DataFrame, rules: DataFrame) -> DataFrame:
    """(model_id, disclosive, messages): the preliminary check of every model that has rules."""
    leaves = check_leaves(params, rules)
    groups = rules.filter(F.col("operator").isin("and", "or")).select("model_type", F.col("rule_id").alias("parent_id"), F.col("operator").alias("group_operator"))
    joined = leaves.join(groups, ["model_type", "parent_id"], "left").withColumn("unit", F.coalesce(F.col("parent_id"), -F.col("rule_id")))
    units = joined.groupBy("model_id", "unit").agg(
        F.when(F.max("group_operator") == "or", F.bool_and("disclosive")).otherwise(F.bool_or("disclosive")).alias("broken"),
        F.sort_array(F.collect_list("message")).alias("lines"),
    )
    broken = F.bool_or("broken")
    return units.groupBy("model_id").agg(broken.alias("disclosive"), F.array_join(F.sort_array(F.flatten(F.collect_list(F.when(F.col("broken"), F.col("lines")).otherwise(F.array().cast("array<string>"))))), "\n").alias("messages"))


def apply_constraints(params: DataFrame, rules: DataFrame) -> DataFrame:
    """params with the values the top-level and and-group rules ask for where they break them; whole numbers and decimals are cast to the type asked for."""
    leaves = check_leaves(params, rules)
    groups = rules.filter("operator = 'or'").select("model_type", F.col("rule_id").alias("parent_id"))
    binding = leaves.join(groups, ["model_type", "parent_id"], "left_anti").filter("disclosive and operator in ('min', 'max', 'equals')")
    fixed = binding.groupBy("model_id", "keyword").agg(F.max_by("rule_value", "rule_id").alias("fixed_value"))
    typed = leaves.join(groups, ["model_type", "parent_id"], "left_anti").filter("operator = 'is_type' and rule_value in ('int', 'float')").groupBy("model_id", "keyword").agg(F.max("rule_value").alias("wanted_type"))
    both = params.join(fixed, ["model_id", "keyword"], "left").join(typed, ["model_id", "keyword"], "left")
    value = F.coalesce("fixed_value", "value")
    wanted = F.when(F.col("value_type").isin("int", "float") & (F.col("wanted_type") != F.col("value_type")), F.col("wanted_type"))
    whole, decimal = value.try_cast("double").cast("bigint").cast("string"), value.try_cast("double").cast("string")
    cast = F.when(wanted == "int", whole).when(wanted == "float", decimal).otherwise(value)
    return both.select("model_id", "model_type", "keyword", cast.alias("value"), F.coalesce(wanted, F.col("value_type")).alias("value_type"))


def differences(current: DataFrame, saved: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """(model_id, path, current_value, saved_value) of parameters or tree nodes that differ from the saved copy."""
    skip = ignored or []
    ours = current.filter(~F.col("path").isin(*skip)) if skip else current
    theirs = saved.filter(~F.col("path").isin(*skip)) if skip else saved
    both = ours.select("model_id", "path", F.col("value").alias("current_value")).join(theirs.select("model_id", "path", F.col("value").alias("saved_value")), ["model_id", "path"], "full_outer")
    return both.filter(~F.col("current_value").eqNullSafe(F.col("saved_value")))


def list_differences(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(model_id, position, current_value, saved_value) of list values; a length difference shows as nulls."""
    flat = lambda df: df.select("model_id", F.posexplode("values").alias("position", "value")).select("model_id", F.col("position").cast("string").alias("path"), F.col("value").cast("string").alias("value"))
    return differences(flat(current), flat(saved)).withColumnRenamed("path", "position")


def tree_differences(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(model_id, n_nodes, n_differing, equal) of trees as node tables (model_id, node_id, and the values of a node)."""
    values = [c for c in current.columns if c not in ("model_id", "node_id")]
    packed = lambda df, name: df.select("model_id", "node_id", F.struct(*values).alias(name))
    both = packed(current, "ours").join(packed(saved, "theirs"), ["model_id", "node_id"], "full_outer")
    out = both.groupBy("model_id").agg(F.count("ours").alias("n_nodes"), F.count_if(~F.col("ours").eqNullSafe(F.col("theirs"))).alias("n_differing"))
    return out.withColumn("equal", F.col("n_differing") == 0)


def forest_differences(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(model_id, n_trees, n_saved_trees, n_differing_trees, equal) of forests as node tables with tree_id besides."""
    keyed = lambda df: df.withColumn("model_id", F.struct("model_id", "tree_id")).drop("tree_id")
    trees = tree_differences(keyed(current), keyed(saved)).select("model_id.*", "n_nodes", "equal")
    size = lambda df, name: df.groupBy("model_id").agg(F.countDistinct("tree_id").alias(name))
    out = trees.groupBy("model_id").agg(F.count_if(~F.col("equal")).alias("n_differing_trees"))
    out = out.join(size(current, "n_trees"), "model_id", "left").join(size(saved, "n_saved_trees"), "model_id", "left").fillna(0)
    return out.withColumn("equal", F.col("n_differing_trees") == 0)


def nested_differences(current: DataFrame, saved: DataFrame, values: str = "values") -> DataFrame:
    """(model_id, path, current_value, saved_value) of maps from names to values, as private SVMs keep their parts."""
    flat = lambda df: df.select("model_id", F.explode(values).alias("path", "value")).withColumn("value", F.col("value").cast("string"))
    return differences(flat(current), flat(saved))


def release(checked: DataFrame, changed: DataFrame, saved: DataFrame) -> DataFrame:
    """(model_id, recommendation, reason): models that break a rule, changed after fitting, or have no saved copy are not released."""
    tampered = changed.select("model_id").distinct().withColumn("tampered", F.lit(True))
    kept = saved.select("model_id").distinct().withColumn("kept", F.lit(True))
    both = checked.join(tampered, "model_id", "left").join(kept, "model_id", "left")
    reason = F.when(F.col("kept").isNull(), "no saved copy").when(F.coalesce("tampered", F.lit(False)), "parameters changed after fitting").when(F.col("disclosive"), F.col("messages")).otherwise("parameters are within the rules")
    ok = F.col("kept").isNotNull() & ~F.coalesce("tampered", F.lit(False)) & ~F.col("disclosive")
    return both.select("model_id", F.when(ok, RELEASE).otherwise(REFUSE).alias("recommendation"), reason.alias("reason"))
