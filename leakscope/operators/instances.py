"""Stored training instances: which rows a model keeps are training records.

A stored row names the training row it believes it is (a hint). Hints are checked by
an equi-join; only rows whose hint fails are searched, by a band join on the
feature of most values: both sides are put in bands of a relative width, a stored row looks into its
own and the neighbouring bands, and the rows are then compared position by position.

Defined results: rows with null features match nothing; lengths must agree; of several
matching training records the smallest record_id counts; each stored row matches once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import ATOL, RTOL, row_close

#: Model types that keep training rows.
STORING = ("SVC", "NuSVC", "SVR", "NuSVR", "OneClassSVM", "KNeighborsClassifier", "KNeighborsRegressor")
N_EXAMPLES = 10
#: Model types that add noise to what they keep, so that storing rows is no leak by itself.
PRIVATE = ("DPSVC",)
#: What may be done about stored rows, by the kind of model.
MITIGATIONS = {"svm": "use a private SVM, or a model that keeps no support vectors", "neighbours": "a nearest-neighbour model keeps all its training rows: use another kind of model"}


def stores_instances(model_type: str) -> bool:
    return model_type in STORING


def match(stored: DataFrame, train: DataFrame, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """(stored_id, record_id) of stored rows (stored_id, hint, features) and train rows (record_id, features)."""
    ours = stored.filter("features is not null and size(features) > 0").select("stored_id", "hint", F.col("features").alias("stored_features"))
    theirs = train.filter("features is not null and size(features) > 0").select("record_id", F.col("features").alias("train_features"))
    close = row_close(F.col("stored_features"), F.col("train_features"), atol, rtol)
    hinted = ours.join(theirs, ours["hint"] == theirs["record_id"]).filter(close).select("stored_id", "record_id")
    open_rows = ours.join(hinted, "stored_id", "left_anti")
    # the feature with most values tells rows apart best
    width = theirs.agg(F.max(F.size("train_features"))).first()[0] or 0
    distinct = theirs.agg(*[F.approx_count_distinct(F.get("train_features", F.lit(i))).alias(f"d{i}") for i in range(width)]).first() if width else ()
    place = F.lit(max(range(width), key=lambda i: distinct[i], default=0))
    first = F.coalesce(F.get("train_features", place), F.lit(0.0))
    # the tolerance grows with the value; bands of the signed logarithm are wide against it, and linear near zero
    fold = lambda x: F.signum(x) * F.log1p(F.abs(x) / 1e-3)
    band = lambda x: F.floor(fold(x) * 1e4)
    banded = theirs.withColumn("band", band(first))
    near = band(F.coalesce(F.get("stored_features", place), F.lit(0.0)))
    looked = open_rows.withColumn("band", F.explode(F.array(near - 1, near, near + 1)))
    found = looked.join(banded, "band").filter(close).groupBy("stored_id").agg(F.min("record_id").alias("record_id"))
    return hinted.unionByName(found)


def kinds(models: DataFrame, model_type: str = "model_type") -> DataFrame:
    """models with stores_instances, private_noise and mitigation, by their type. Private SVMs count as SVMs, too."""
    kind = F.col(model_type)
    stores, private = kind.isin(*STORING, *PRIVATE), kind.isin(*PRIVATE)
    advice = F.when(kind.startswith("KNeighbors"), MITIGATIONS["neighbours"]).when(stores & ~private, MITIGATIONS["svm"])
    return models.withColumns({"stores_instances": stores, "private_noise": private, "mitigation": advice})


def report(stored: DataFrame, train: DataFrame, matched: DataFrame, model_type: str) -> DataFrame:
    """One row: the fractions, whether training rows leak through the model, and what may be done."""
    found = kinds(fractions(stored, matched, train).withColumn("model_type", F.lit(model_type)))
    return found.withColumn("leaks", F.col("stores_instances") & ~F.col("private_noise") & (F.col("n_matched") > 0))


def fractions(stored: DataFrame, matched: DataFrame, train: DataFrame) -> DataFrame:
    """One row: stored rows, training rows, matched training records, and the two fractions."""
    a = stored.agg(F.count(F.lit(1)).alias("n_stored"))
    b = train.agg(F.count(F.lit(1)).alias("n_train"))
    c = matched.agg(F.countDistinct("record_id").alias("n_matched"))
    whole = a.crossJoin(b).crossJoin(c)
    part = lambda x, of: F.col(x) / F.when(F.col(of) > 0, F.col(of))
    return whole.withColumns({"storage_fraction": part("n_stored", "n_train"), "match_fraction": part("n_matched", "n_stored")})


def individual_risk(train: DataFrame, matched: DataFrame) -> DataFrame:
    """(record_id, individual_risk): 1 for training records that a stored row matches."""
    hit = matched.select("record_id").distinct().withColumn("hit", F.lit(1))
    return train.select("record_id").join(hit, "record_id", "left").select("record_id", F.coalesce("hit", F.lit(0)).alias("individual_risk"))


def examples(matched: DataFrame, n: int = N_EXAMPLES) -> DataFrame:
    """The first matches, for display."""
    return matched.orderBy("stored_id", "record_id").limit(n)
