"""Models behind the audit: a small protocol over pyspark.ml, shadow models, leaves, and a private linear SVM.

Features are ARRAY<DOUBLE> columns and become vectors only here. Models are referred
to by name from a registry; nothing is imported by path or unpickled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from leakscope.functions.exprs import argmax, class_prob, logit, loss

#: Estimators by name, with the columns they read.
REGISTRY: dict[str, Callable[..., Estimator]] = {
    "DecisionTreeClassifier": DecisionTreeClassifier,
    "RandomForestClassifier": RandomForestClassifier,
    "GBTClassifier": GBTClassifier,
    "LogisticRegression": LogisticRegression,
    "MultilayerPerceptronClassifier": MultilayerPerceptronClassifier,
    "NaiveBayes": NaiveBayes,
    "LinearSVC": LinearSVC,
}
#: The attack model's default parameters.
ATTACK_FOREST = {"numTrees": 100, "maxDepth": 5, "minInstancesPerNode": 10}


#: The fitted model of each estimator, for reading it again.
FITTED = {n: getattr(classification, (n.removesuffix("Classifier") + "Classification" if n.endswith("Classifier") else n) + "Model") for n in REGISTRY}


def save(model: Model, path: str) -> None:
    """Write a fitted model, or a pipeline of one, with its writer."""
    model.write().overwrite().save(path)


def load(name: str, path: str) -> Model:
    """A model written by save; name is that of its estimator, or Pipeline."""
    if name != "Pipeline" and name not in FITTED:
        raise ValueError(f"unknown model {name}; known: Pipeline, {', '.join(sorted(FITTED))}")
    return (PipelineModel if name == "Pipeline" else FITTED[name]).load(path)


def estimator(name: str, **params) -> Estimator:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](featuresCol="vec", labelCol="label", **params)


def vectorised(df: DataFrame, features: str = "features", y: str = "y") -> DataFrame:
    """df with vec and label; missing values become 0."""
    filled = F.transform(features, lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)))
    return df.withColumns({"vec": array_to_vector(filled), "label": F.col(y).cast("double")})


def fit(df: DataFrame, name: str, features: str = "features", y: str = "y", **params) -> Model:
    """A fitted model; rows without features or label are not used."""
    rows = df.dropna(subset=[features, y])
    return estimator(name, **params).fit(vectorised(rows, features, y).select("vec", "label"))


def score(model: Model, df: DataFrame, features: str = "features", y: str = "y") -> DataFrame:
    """df with probs and prediction of the model."""
    out = model.transform(vectorised(df, features, y))
    probs = vector_to_array("probability") if "probability" in out.columns else F.array(1 / (1 + F.exp(vector_to_array("rawPrediction")[1])), 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))
    out = out.withColumn("model_probs", probs)
    keep = [c for c in df.columns if c not in ("probs", "prediction", "leaf")]
    leaf = [F.col("leaf")] if "leaf" in out.columns else []
    return out.select(*keep, F.col("model_probs").alias("probs"), F.col("prediction").cast("int").alias("prediction"), *leaf)


def losses(df: DataFrame) -> DataFrame:
    """df with the loss of the true class and whether the prediction is right."""
    return df.withColumns({"loss": loss(F.col("probs"), F.col("y")), "correct": argmax(F.col("probs")) == F.col("y")})


def inner_model(model: Model) -> Model:
    """The classifier of a pipeline: its last stage."""
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))


def remap_classes(df: DataFrame, classes: list) -> DataFrame:
    """y as the position of its class; rows of classes the model has not seen are removed."""
    known = F.array(*[F.lit(c) for c in classes])
    return df.withColumn("y", (F.array_position(known, F.col("y")) - 1).cast("int")).filter("y >= 0")


def parameter_count(model: Model) -> int:
    """Learned parameters of a fitted model; 0 for kinds that are not counted."""
    model = inner_model(model)
    trees = getattr(model, "trees", None) or ([model] if hasattr(model, "numNodes") else [])
    if trees:
        n_classes = getattr(model, "numClasses", 2)
        count = lambda nodes: 2 * ((nodes - 1) // 2) + (nodes + 1) // 2 * (n_classes - 1)
        return sum(count(t.numNodes) for t in trees)
    if hasattr(model, "weights"):
        return int(model.weights.size)
    if hasattr(model, "coefficientMatrix"):
        return int(model.coefficientMatrix.numRows * model.coefficientMatrix.numCols + model.interceptVector.size)
    if hasattr(model, "coefficients"):
        return int(model.coefficients.size) + 1
    return 0


def leaves(df: DataFrame, name: str = "DecisionTreeClassifier", **params) -> DataFrame:
    """df with probs, prediction and leaf (a number of a tree, an array of a forest) of a model fitted on its members."""
    model = fit(df.filter("is_member = 1"), name, leafCol="leaf", **params)
    out = score(model, df)
    return out.withColumn("leaf", leaf_array(out))


def leaf_array(placed: DataFrame) -> Column:
    """The leaf of a tree as it is, the leaves of a forest as an array."""
    return vector_to_array("leaf") if dict(placed.dtypes)["leaf"] == "vector" else F.col("leaf")


def shadow_confidences(records: DataFrame, membership: DataFrame, name: str, parallelism: int = 4, store: str | None = None, **params) -> DataFrame:
    """(model_idx, record_id, in_train, conf): every record scored by every shadow model; conf is the logit of its class.

    Each model is fitted on its own members. store: a folder that keeps the confidences of every
    model; models on file there are not fitted again.
    """
    from leakscope.operators.shadow import stored
    from leakscope.session import scratch

    spark = records.sparkSession
    path = f"{store or scratch(spark)}/{name}"
    n_models = (membership.agg(F.max("model_idx")).first()[0] or 0) + 1

    def one(model_idx: int) -> None:
        sides = membership.filter(F.col("model_idx") == model_idx).select("record_id", "in_train")
        both = records.join(sides, "record_id")
        fitted = fit(both.filter("in_train"), name, **params)
        # a class the shadow model has not seen has probability 0
        conf = logit(F.coalesce(class_prob(F.col("probs"), F.col("y")), F.lit(0.0)))
        scored = score(fitted, both).select("record_id", "in_train", conf.alias("conf"))
        scored.write.mode("overwrite").parquet(f"{path}-parts/{model_idx}")

    def compute(missing: list[int]) -> DataFrame:
        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(one, missing))
        rows = spark.read.parquet(*[f"{path}-parts/{i}" for i in missing])
        place = F.regexp_extract(F.col("_metadata.file_path"), r"-parts/(\d+)/", 1).cast("int")
        return rows.withColumn("model_idx", place)

    return stored(spark, path, n_models, compute).select("model_idx", "record_id", "in_train", "conf")


def fourier_features(df: DataFrame, size: int, gamma: float, seed: int = 0, features: str = "features", rho: list[list[float]] | None = None) -> DataFrame:
    """df with vec_rff: random Fourier features size^-1/2 [cos, sin] of size directions (rho, else drawn on the driver); missing values are 0.

    A batch of rows is one matrix product, so the plan does not grow with size and width.
    """
    if rho is None:
        width = df.select(F.max(F.size(features))).first()[0] or 0
        matrix = np.random.default_rng(seed).normal(0, math.sqrt(2 * gamma), (size, width))
    else:
        matrix = np.asarray(rho)
    scale = 1 / math.sqrt(size)

    @pandas_udf("array<double>")
    def mapped(rows: pd.Series) -> pd.Series:
        x = np.zeros((len(rows), matrix.shape[1]))
        for i, values in enumerate(rows):
            if values is not None:
                x[i, : len(values)] = values
        angles = np.nan_to_num(x, nan=0.0) @ matrix.T
        return pd.Series(list(scale * np.hstack([np.cos(angles), np.sin(angles)])))

    return df.withColumn("vec_rff", mapped(F.transform(features, lambda v: v.cast("double"))))


class PrivateSVM:
    """A linear SVM over random Fourier features with Laplace noise on its weights, and a logistic map to probabilities."""

    def __init__(self, c: float = 1.0, eps: float = 10.0, dhat: int = 20, gamma: float = 0.1, seed: int = 0):
        self.c, self.eps, self.dhat, self.gamma, self.seed = c, eps, dhat, gamma, seed

    @property
    def noise_scale(self) -> float:
        """2^2.5 C sqrt(dhat) / eps; no noise for eps 0."""
        return 2**2.5 * self.c * math.sqrt(self.dhat) / self.eps if self.eps > 0 else 0.0

    def fit(self, df: DataFrame) -> PrivateSVM:
        rows = vectorised(fourier_features(df, self.dhat, self.gamma, self.seed).withColumn("features", F.col("vec_rff")))
        n = rows.count()
        svm = LinearSVC(featuresCol="vec", labelCol="label", regParam=1 / max(1.0, self.c * n), standardization=False).fit(rows.select("vec", "label"))
        noise = np.random.default_rng(self.seed + 1).laplace(0, self.noise_scale / max(n, 1), 2 * self.dhat) if self.noise_scale else np.zeros(2 * self.dhat)
        self.weights, self.intercept = (svm.coefficients.toArray() + noise).tolist(), svm.intercept
        margin = self._margin(rows)
        platt = LogisticRegression(featuresCol="m", labelCol="label").fit(margin.select(array_to_vector(F.array("margin")).alias("m"), "label"))
        self.slope, self.offset = float(platt.coefficients[0]), float(platt.intercept)
        return self

    def _margin(self, rows: DataFrame) -> DataFrame:
        weighted = F.zip_with("vec_rff", F.array(*map(F.lit, self.weights)), lambda a, b: a * b)
        return rows.withColumn("margin", F.aggregate(weighted, F.lit(float(self.intercept)), lambda s, x: s + x))

    def score(self, df: DataFrame) -> DataFrame:
        rows = self._margin(fourier_features(df, self.dhat, self.gamma, self.seed))
        p = 1 / (1 + F.exp(-(self.slope * F.col("margin") + self.offset)))
        return rows.withColumn("probs", F.array(1 - p, p)).withColumn("prediction", (p > 0.5).cast("int")).select(*[c for c in df.columns if c not in ("probs", "prediction")], "probs", "prediction")


def hinge_weights(x, sign, c: float, n_steps: int = 500, rho: float = 1.0, tolerance: float = 1e-6):
    """Weights and intercept (last) that minimise |w|^2 / 2 + c sum max(0, 1 - sign (x w + b)), by alternating directions."""
    a = sign[:, None] * np.hstack([x, np.ones((len(x), 1))])
    held = np.diag([1.0] * x.shape[1] + [1e-9])
    solve = np.linalg.inv(held + rho * a.T @ a)
    z = u = np.zeros(len(a))
    for _ in range(n_steps):
        w = rho * solve @ (a.T @ (z - u))
        m = a @ w
        v, before = m + u, z
        z = np.where(v > 1, v, np.minimum(1.0, v + c / rho))
        u = v - z
        if max(np.abs(m - z).max(), np.abs(z - before).max()) < tolerance:
            break
    return w


def platt(margin, y, n_steps: int = 50):
    """Slope and offset of the logistic map from margins to labels, by Newton steps held to a finite slope."""
    a, b = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(n_steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), a.T @ (y - p) - 1e-6 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


#: Rows of a key up to which its private SVM is fitted in one task.
GROUP_ROWS = 200_000


def private_svms(df: DataFrame, keys: list[str], c: float = 1.0, eps: float = 10.0, dhat: int = 20, gamma: float = 0.1, seed: int = 0, most_rows: int = GROUP_ROWS) -> DataFrame:
    """(keys, record_id, probs, prediction): PrivateSVM of every key. The rows of a key of up to most_rows rows are fitted
    in one task, of larger keys by the distributed PrivateSVM, one key after another; both minimise the same sum.

    Defined results: missing values are 0. The model is for labels 0 and 1: records of keys
    with another label, or with one label only, have null probs and prediction.
    """
    scale = PrivateSVM(c, eps, dhat, gamma, seed).noise_scale

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record_id", ignore_index=True)
        out, y = rows[[*keys, "record_id"]].copy(), rows["y"].to_numpy()
        out["probs"], out["prediction"] = None, pd.array([None] * len(rows), dtype="Int32")
        if set(y) != {0, 1}:
            return out
        width = max(map(len, rows["features"]))
        x = np.zeros((len(rows), width))
        for i, values in enumerate(rows["features"]):
            x[i, : len(values)] = values
        x = np.nan_to_num(x, nan=0.0)
        angles = x @ np.random.default_rng(seed).normal(0, math.sqrt(2 * gamma), (dhat, width)).T
        x = np.hstack([np.cos(angles), np.sin(angles)]) / math.sqrt(dhat)
        w = hinge_weights(x, 2.0 * y - 1, c)
        own = [int(k) if isinstance(k, np.integer) else sum(str(k).encode()) for k in rows.loc[0, keys]]
        if scale:
            w[:-1] += np.random.default_rng([seed + 1, *[k % 2**63 for k in own]]).laplace(0, scale / len(rows), 2 * dhat)
        margin = x @ w[:-1] + w[-1]
        slope, offset = platt(margin, y)
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -700, 700)))
        out["probs"], out["prediction"] = list(map(list, np.column_stack([1 - p, p]))), pd.array((p > 0.5).astype(int), dtype="Int32")
        return out

    kinds = dict(df.dtypes)
    missing = F.transform("features", lambda v: F.coalesce(v, F.lit(0.0)))
    rows = df.dropna(subset=[*keys, "features", "y"]).select(*keys, "record_id", "y", missing.alias("features"))
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"record_id {kinds['record_id']}", "probs array<double>", "prediction int"])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("y")).alias("labels"))  # labels: classes of one model
    large = sizes.filter(F.col("n") > most_rows).collect()  # at most the number of rows over most_rows
    out = None
    for key in large:
        mine = rows
        for k in keys:
            mine = mine.filter(F.col(k).eqNullSafe(F.lit(key[k])))
        scored = PrivateSVM(c, eps, dhat, gamma, seed).fit(mine).score(mine) if key.labels == [0, 1] else mine.withColumns({"probs": F.lit(None).cast("array<double>"), "prediction": F.lit(None).cast("int")})
        part = scored.select(*keys, "record_id", "probs", "prediction")
        out = part if out is None else out.unionByName(part)
    rest = rows if not large else rows.join(df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in large], sizes.select(*keys).schema), keys, "left_anti")
    small = rest.groupBy(*keys).applyInPandas(one, schema)
    return small if out is None else small.unionByName(out)
