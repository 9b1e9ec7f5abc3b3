"""Structural checks of a model: degrees of freedom, hyper-parameters, generalisation gap, loss distributions.

Defined results: a gap needs both splits, else it is null; the distance of loss
distributions is null without rows of either split; parameters that are null take
the defaults of their model type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.stats import kolmogorov_p
from leakscope.operators import equivalence, metrics
from leakscope.session import cut_lineage

DOF_THRESHOLD, ALPHA = 10, 0.05

#: Hyper-parameter regions of the riskiest fifth, one condition per region.
RISKY = {
    "DecisionTreeClassifier": [
        "max_depth > 7.5 AND min_samples_leaf <= 7.5 AND min_samples_split <= 15",
        "splitter = 'best' AND max_depth > 7.5 AND min_samples_leaf <= 7.5 AND min_samples_split > 15",
        "splitter = 'best' AND max_depth > 7.5 AND min_samples_leaf > 7.5 AND min_samples_leaf <= 15 AND max_features IS NULL",
        "splitter = 'best' AND max_depth > 3.5 AND max_depth <= 7.5 AND max_features IS NULL AND min_samples_leaf <= 7.5",
        "splitter = 'random' AND max_depth > 7.5 AND min_samples_leaf <= 7.5 AND max_features IS NULL",
    ],
    "RandomForestClassifier": [
        "max_depth > 3.5 AND n_estimators > 35 AND max_features IS NOT NULL",
        "max_depth > 3.5 AND n_estimators > 35 AND min_samples_split <= 15 AND max_features IS NULL AND bootstrap",
        "max_depth > 7.5 AND n_estimators > 15 AND n_estimators <= 35 AND min_samples_leaf <= 15 AND NOT bootstrap",
    ],
    "XGBClassifier": [
        "max_depth > 3.5 AND n_estimators > 3.5 AND n_estimators <= 12.5 AND min_child_weight <= 1.5",
        "max_depth > 3.5 AND n_estimators > 12.5 AND min_child_weight <= 3",
        "max_depth > 3.5 AND n_estimators > 62.5 AND min_child_weight > 3 AND min_child_weight <= 6",
    ],
}
#: What an unset (null or 0) parameter stands for.
UNSET = {
    "DecisionTreeClassifier": {"max_depth": 500},
    "RandomForestClassifier": {"max_depth": 500},
    "XGBClassifier": {"max_depth": 6, "n_estimators": 100, "min_child_weight": 1},
}


def unnecessary_risk(params: DataFrame, model_type: str) -> DataFrame:
    """params with a boolean unnecessary_risk; model types without regions are never at risk."""
    if model_type not in RISKY:
        return params.withColumn("unnecessary_risk", F.lit(False))
    filled = params
    for name, value in UNSET[model_type].items():
        filled = filled.withColumn(name, F.when(F.coalesce(F.col(name), F.lit(0)) == 0, F.lit(float(value))).otherwise(F.col(name).cast("double")))
    risky = F.expr(" OR ".join(f"({region})" for region in RISKY[model_type]))
    keep = [c for c in params.columns if c not in UNSET[model_type]]
    judged = filled.withColumn("unnecessary_risk", F.coalesce(risky, F.lit(False)))
    return judged.select(*keep, *UNSET[model_type], "unnecessary_risk")


def tree_parameters(n_nodes: Column, n_classes: Column) -> Column:
    """Learned parameters of a binary tree: two per inner node, classes less one per leaf."""
    leaves = (n_nodes + 1) / 2
    return (2 * (n_nodes - leaves) + leaves * (n_classes - 1)).cast("bigint")


def ensemble_parameters(trees: DataFrame, keys: list[str], extra_per_tree: int = 0) -> DataFrame:
    """Sum over trees (keys, n_nodes, n_classes); boosted trees count one more each."""
    return trees.groupBy(*keys).agg(F.sum(tree_parameters(F.col("n_nodes"), F.col("n_classes")) + extra_per_tree).alias("n_params"))


def layer_parameters(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Weights and biases of a network from its layers (keys, n_in, n_out)."""
    return layers.groupBy(*keys).agg(F.sum(F.col("n_in") * F.col("n_out") + F.col("n_out")).alias("n_params"))


def dof_risk(records: DataFrame, n_params: Column, threshold: int = DOF_THRESHOLD) -> DataFrame:
    """One row: residual degrees of freedom, and whether they are fewer than the threshold."""
    residual = F.count(F.lit(1)) - n_params
    return records.agg(residual.alias("residual_dof"), (residual < threshold).alias("dof_risk"))


def generalisation_gap(df: DataFrame, correct: Column, keys: list[str] | None = None) -> DataFrame:
    """train_acc, test_acc and gap (error on test less error on training) from is_member."""
    share = lambda m: F.avg(F.when(F.col("is_member") == m, correct.cast("double")))
    out = df.groupBy(*(keys or [])).agg(share(1).alias("train_acc"), share(0).alias("test_acc"))
    return out.withColumn("generalisation_gap", (1 - F.col("test_acc")) - (1 - F.col("train_acc")))


def ks_statistic(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Largest distance between the distributions of a value in the two splits; counted by distinct value."""
    keys = list(keys or [])
    counts = df.dropna(subset=[value, "is_member"]).groupBy(*keys, value).agg(F.sum("is_member").alias("p"), F.sum(1 - F.col("is_member")).alias("n"))
    # running counts come from the largest value down; the distance is the same from either end
    both = metrics.running_counts(cut_lineage(counts), keys, score=value)
    share = lambda c, of: F.col(c) / F.when(F.col(of) > 0, F.col(of))
    gap = F.abs(share("cum_p", "total_p") - share("cum_n", "total_n"))
    return both.groupBy(*keys).agg(F.max(gap).alias("ks_stat"), F.max("total_p").alias("n_train"), F.max("total_n").alias("n_test"))


def ks_test(df: DataFrame, value: str, keys: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """ks_statistic with its asymptotic p-value, and whether that is below alpha."""
    out = ks_statistic(df, value, keys).withColumn("ks_p", kolmogorov_p(F.col("ks_stat"), F.col("n_train").cast("double"), F.col("n_test").cast("double")))
    return out.withColumn("ks_risk", F.col("ks_p") < alpha)


def structural_report(records: DataFrame, key: str, n_params: int, correct: Column, threshold: int = equivalence.THRESHOLD, params: DataFrame | None = None, model_type: str = "", loss: str | None = None) -> DataFrame:
    """One row of all structural results of one model; records carry is_member, probs, the class key and, if named, the loss.

    params: one row of hyper-parameters, judged by the risky regions of model_type.
    """
    train = records.filter("is_member = 1")
    out = equivalence.global_risks(equivalence.classes(train, key), threshold)
    parts = [dof_risk(train, F.lit(n_params)), generalisation_gap(records, correct)]
    if loss:
        parts.append(ks_test(records, loss, []).select("ks_stat", "ks_p", "ks_risk"))
    if params is not None:
        parts.append(unnecessary_risk(params.limit(1), model_type).select("unnecessary_risk"))
    for part in parts:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out
