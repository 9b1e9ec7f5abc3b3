"""Classifiers that watch over their own release: parameters by rules, a copy kept at fitting, checks for later changes.

A safe model takes only the parameters its kind lists, is checked against the rules
when made, and keeps what it was fitted with: parameters, and its nodes or weights as
a table. Before release the present state is compared with that copy; with data at
hand the attacks are run, too.

Defined results: parameters that are not listed are an error; a model that was not
fitted, or whose parameters or nodes differ from the copy, is not released; suffixes
other than those named are not written.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators import equivalence, models, rules
from leakscope.session import cut_lineage, scratch
from leakscope.sources import report_sink

#: The parameters of each kind under the names of the rules, with their defaults and what they are called here.
PARAMETERS = {
    "DecisionTreeClassifier": {"max_depth": (5, "maxDepth"), "min_samples_leaf": (5, "minInstancesPerNode"), "criterion": ("gini", "impurity"), "random_state": (0, "seed")},
    "RandomForestClassifier": {"n_estimators": (100, "numTrees"), "max_depth": (5, "maxDepth"), "min_samples_leaf": (5, "minInstancesPerNode"), "bootstrap": (True, "bootstrap"), "random_state": (0, "seed")},
    "SVC": {"C": (1.0, "c"), "eps": (10.0, "eps"), "dhat": (1000, "dhat"), "gamma": (0.1, "gamma"), "random_state": (0, "seed")},
}
SUFFIXES = (".model",)
_PARAM = "model_id int, model_type string, keyword string, value string, value_type string"


def node_table(model: Model, spark: SparkSession) -> DataFrame:
    """(tree_id, node_id, feature, cuts, left, right, prediction, n_rows) of a fitted tree or forest, from the files of its writer."""
    path = f"{scratch(spark)}/model"
    models.inner_model(model).write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select(F.col("treeID").alias("tree_id"), "nodeData.*") if "treeID" in rows.columns else rows.withColumn("tree_id", F.lit(0))
    return rows.select(
        "tree_id", F.col("id").alias("node_id"), F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cuts"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction", F.col("rawCount").alias("n_rows")
    )


def written(value) -> tuple[str, str]:
    """A parameter as the text and type the rules compare."""
    if isinstance(value, bool):
        return str(value).lower(), "bool"
    return str(value), type(value).__name__


class SafeModel:
    """A classifier of one of the kinds of PARAMETERS."""

    def __init__(self, spark: SparkSession, kind: str, **params):
        if kind not in PARAMETERS:
            raise ValueError(f"no safe model of kind {kind}; known: {', '.join(PARAMETERS)}")
        odd = set(params) - set(PARAMETERS[kind])
        if odd:
            raise ValueError(f"{kind} takes no {', '.join(sorted(odd))}")
        self.spark, self.kind = spark, kind
        self.params = {k: params.get(k, default) for k, (default, _) in PARAMETERS[kind].items()}
        self.model = self.saved_params = self.saved_nodes = self.k_anonymity = None
        self.disclosive, self.messages = self.preliminary_check()

    # ------------------------------------------------------------ checks

    def parameter_table(self, params: dict | None = None) -> DataFrame:
        rows = [(0, self.kind, k, *written(v)) for k, v in (params or self.params).items()]
        return self.spark.createDataFrame(rows, _PARAM)

    def preliminary_check(self, apply_constraints: bool = False) -> tuple[bool, str]:
        """Whether the parameters break a rule, and the messages; with apply_constraints they are set to what the rules ask for."""
        base = rules.shipped_rules(self.spark)
        found = rules.check(self.parameter_table(), base).first()
        if apply_constraints:
            kept = {r.keyword: r.value for r in rules.apply_constraints(self.parameter_table(), base).collect()}
            for k, v in self.params.items():
                text = kept.get(k, written(v)[0])
                if text != written(v)[0]:
                    self.params[k] = text == "true" if isinstance(v, bool) else type(v)(float(text)) if isinstance(v, (int, float)) else text
        return (bool(found.disclosive), found.messages) if found else (False, "")

    def posthoc_check(self) -> tuple[bool, list[str]]:
        """Whether the model differs from the copy kept at fitting, and how."""
        if self.saved_params is None:
            return True, ["the model was not fitted"]
        now, before = (self.parameter_table(p).select("model_id", F.col("keyword").alias("path"), "value") for p in (self.params, self.saved_params))
        out = [f"{r.path}: {r.saved_value} at fitting, {r.current_value} now" for r in rules.differences(now, before).orderBy("path").collect()]  # a handful of parameters
        if self.saved_nodes is not None:
            state = rules.forest_differences(self._nodes().withColumn("model_id", F.lit(0)), self.saved_nodes.withColumn("model_id", F.lit(0))).first()
            if not state.equal:
                out.append(f"{state.n_differing_trees} of {state.n_saved_trees} trees differ")
        elif self.kind == "SVC" and (self.model.weights, self.model.intercept) != self.saved_weights:
            out.append("the weights differ")
        return bool(out), out

    # ------------------------------------------------------------ fitting

    def _nodes(self) -> DataFrame:
        return node_table(self.model, self.spark)

    def fit(self, df: DataFrame) -> SafeModel:
        """Fit on rows of features and y; keeps the copy, and the smallest equivalence class of trees and forests."""
        own = {name: self.params[k] for k, (_, name) in PARAMETERS[self.kind].items()}
        if self.kind == "SVC":
            self.model = models.PrivateSVM(**own).fit(df)
            self.saved_weights = (list(self.model.weights), self.model.intercept)
        else:
            self.model = models.fit(df, self.kind, leafCol="leaf", **own)
            placed = models.score(self.model, df.dropna(subset=["features"]))
            leaf = placed.withColumn("leaf", models.leaf_array(placed))
            self.k_anonymity = equivalence.smallest_leaf(leaf, "leaf").first().k_anonymity
            self.saved_nodes = cut_lineage(self._nodes())
        self.saved_params = dict(self.params)
        self.disclosive, self.messages = self.preliminary_check()
        return self

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.score(df) if self.kind == "SVC" else models.score(self.model, df).drop("leaf")

    # ------------------------------------------------------------ release

    def save(self, path: str) -> str:
        """Write the model if the suffix is known; the message says what was done."""
        if PurePosixPath(path).suffix not in SUFFIXES:
            return f"not saved: suffix {PurePosixPath(path).suffix or 'missing'} is none of {', '.join(SUFFIXES)}"
        if self.model is None:
            return "not saved: the model was not fitted"
        if self.kind == "SVC":
            state = json.dumps({"weights": self.model.weights, "intercept": self.model.intercept, "slope": self.model.slope, "offset": self.model.offset, **self.params})
            self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        else:
            models.save(self.model, path)
        return f"saved as {path}"

    def request_release(self, path: str, records: DataFrame | None = None, attacks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict:
        """Save the model with its report (path + "-report"): checks, recommendation, and the numbers of rows of the attacks
        run on records; their rows, each with its run, are appended to the report table path + "-attacks"."""
        message = self.save(path)
        self.disclosive, self.messages = self.preliminary_check()
        changed, how = self.posthoc_check()
        reasons = [*how, *([self.messages] if self.disclosive else [])]
        out = {
            "model": self.kind, "params": self.params, "saved": message, "k_anonymity": self.k_anonymity,
            "recommendation": rules.REFUSE if reasons else rules.RELEASE, "reason": "\n".join(reasons) or "parameters are within the rules",
        }
        if records is not None and not changed:
            scored = self.score(records)
            out["attacks"] = {}
            for name, run in (attacks or {}).items():
                rows = cut_lineage(report_sink.report_rows(run(scored), name, path, "run"))
                report_sink.append_report(rows, f"{path}-attacks")
                out["attacks"][name] = rows.count()
        self.spark.createDataFrame([(json.dumps(out, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-report")
        return out
