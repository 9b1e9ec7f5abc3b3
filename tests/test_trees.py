"""Models of every target: trees grown together against pyspark.ml's one by one, and the private SVM."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.operators import attribute, equivalence, models, resampled, shadow, trees
from leakscope.plans import audit, frames
from leakscope.session import table

KEYS = ["target_id"]


@pytest.fixture(scope="module")
def records(spark):
    """Three classes and few values in target 1; two classes, another width and missing values in target 2."""
    rows = [(i, 1, int(i % 4 > 0), (i * 7 + i // 5) % 3, [float(i % 11), float((i * i) % 7), float(i % 3)]) for i in range(120)]
    rows += [(1000 + i, 2, int(i % 3 > 0), int(i % 13 > 5), [float(i % 13), None if i % 10 == 0 else math.nan if i % 10 == 1 else float(i % 5)]) for i in range(90)]
    return spark.createDataFrame(rows, "record_id int, target_id int, is_member int, y int, features array<double>").cache()


def test_every_target_and_class_is_learnable(spark, sf_dir):
    whole = table(spark, sf_dir, "records").filter("features is not null and y is not null")
    got = frames.learnable(spark, sf_dir)
    assert got.count() == whole.select("record_id").distinct().count()
    assert got.select("target_id", "y").distinct().count() == whole.select("target_id", "y").distinct().count()


def test_trees_are_those_of_pyspark_ml(records):
    ours = {r.record_id: r for r in trees.leaves(records, KEYS, 4).collect()}
    assert len(ours) == 210
    for target in (1, 2):
        own = records.filter(F.col("target_id") == target)
        theirs = models.leaves(own, "DecisionTreeClassifier", maxDepth=4).collect()
        assert len({r.leaf for r in theirs}) > 1
        for r in theirs:
            assert ours[r.record_id].probs == pytest.approx(r.probs)
        assert len({(r.leaf, ours[r.record_id].leaf) for r in theirs}) == len({r.leaf for r in theirs})


def test_forests_and_shadow_models_of_every_target(records):
    placed = trees.forest_leaves(records, KEYS, 5, 3)
    smallest = equivalence.smallest_leaf(placed, "leaf", KEYS).collect()
    assert {r.target_id for r in smallest} == {1, 2} and all(len(r.leaf) == 5 for r in placed.collect())
    conf = shadow.tree_confidences(records, KEYS, 2, 4).groupBy("target_id", "model_idx").agg(F.count_if("in_train").alias("n_in"), F.count("conf").alias("n")).collect()
    assert {(r.target_id, r.model_idx, r.n_in, r.n) for r in conf} == {(1, 0, 90, 120), (1, 1, 90, 120), (2, 0, 60, 90), (2, 1, 60, 90)}


def test_shadow_trees_in_tasks_are_those_from_counts(records, spark):
    """Many values and few, blocks of models, texts as keys and ids; a key of two widths and one with a label missing are counted."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x = [float(draw.normal()), float(draw.integers(-30, 30)) / 8, float(draw.integers(3)), 1.0]
        rows.append((2000 + i, 3, int(i % 5 > 0), int(x[0] + x[1] > 0) + int(x[2] > 1), x))
    rows += [(3000 + i, 4, int(i % 2), i % 3 % 2, [float(i % 5), float(i % 7)][: 1 + i % 2]) for i in range(40)]
    rows += [(4000 + i, 5, int(i % 2), None if i == 7 else i % 2, [float(i % 11)]) for i in range(40)]
    rows += [(5000 + i, 6, 0, 1, [1.0]) for i in range(5)]  # no members, no models
    some = records.unionByName(spark.createDataFrame(rows, records.schema)).withColumns({"record_id": F.col("record_id").cast("string"), "side": F.lit("a")}).cache()
    keys = [*KEYS, "side"]
    given = lambda **limits: {(r.target_id, r.side, r.model_idx, r.record_id): (r.in_train, r.conf) for r in shadow.tree_confidences(some, keys, 6, 4, **limits).collect()}
    ours = given(task_values=900)
    assert len(ours) == 6 * (120 + 90 + 150 + 40 + 40)
    assert ours == given(most_values=0)


def test_shadow_models_write_down_no_row_for_each_model(records, monkeypatch):
    cut, write = [], shadow.cut_lineage
    monkeypatch.setattr(shadow, "cut_lineage", lambda df: cut.append(write(df)) or cut[-1])
    assert shadow.tree_confidences(records, KEYS, 20, 4).count() == 20 * 210
    assert max(df.count() for df in cut) <= 210


def test_cuts_of_sorted_values():
    high = np.nextafter(1.5, 2)
    above = np.nextafter(high, 2)  # the midpoint of these two is rounded up
    for values in ([0.0, high, above, above], [-np.inf, -np.inf, np.inf, np.inf], [-1e308, 1.7e308, 1.75e308, 1.75e308], [2.0, 2.0, 2.0, 2.0]):
        with np.errstate(all="ignore"):
            distinct = np.unique(values)
            cuts = (distinct[1:] + distinct[:-1]) / 2
        below = [sum(c < v for c in cuts) for v in values]  # the bin of trees.grow
        upper = resampled._upper_cuts(np.array([values]))[0]
        assert np.concatenate([[0], np.cumsum(upper[1:] != upper[:-1])]).tolist() == np.unique(below, return_inverse=True)[1].tolist()
    many = np.sort(np.random.default_rng(2).normal(size=100))
    ranks = many[[math.ceil(i * 100 / 32) - 1 for i in range(1, 32)]]
    assert resampled._upper_cuts(many[None])[0].tolist() == [min([c for c in ranks if c >= v], default=math.inf) for v in many]


def test_attributes_of_every_target_as_one_by_one(spark):
    """Large nodes and few values: no two splits have the same gain, no feature is cut at quantiles, and both libraries choose alike."""
    draw = np.random.default_rng(5)
    rows = []
    for target, n_classes in ((1, 3), (2, 2)):
        for i in range(400):
            x = [float(draw.integers(-9, 10)) / 10, float(draw.integers(4))]
            rows.append((target * 1000 + i, target, int(i % 4 > 0), int(x[1] + x[0] + draw.normal() * 0.5 > 1.5) + int(n_classes > 2 and x[1] == 2), x))
    records = spark.createDataFrame(rows, "record_id int, target_id int, is_member int, y int, features array<double>").cache()
    grown, last = trees.grow(records.filter("is_member = 1"), KEYS, 2), F.element_at("features", -1)
    ours = {r.record_id: (r.inferred, r.correct) for r in attribute.last_value_attack(records, grown, KEYS, 2).collect()}
    risky = {r.record_id: r.at_risk for r in attribute.first_value_bounds(records, grown, KEYS, 2).collect()}
    assert len(ours) == len(risky) == 800 and any(i for i, _ in ours.values())
    for target in (1, 2):
        own = records.filter(F.col("target_id") == target)
        model = models.fit(own.filter("is_member = 1"), "DecisionTreeClassifier", maxDepth=2)
        own = models.score(model, own).withColumn("y", F.col("prediction")).drop("probs", "prediction")  # these two score by y, the attack asks for the model's label
        theirs = attribute.categorical_attack(own, model, [1], attribute.feature_values(own, last), last).collect()
        assert {r.record_id: (r.inferred, r.correct) for r in theirs}.items() <= ours.items()
        assert {r.record_id: r.at_risk for r in attribute.quantitative_attack(own, model, 0).collect()}.items() <= risky.items()


def test_private_svms(records, spark):
    got = models.private_svms(records, KEYS, dhat=10).collect()
    split = models.private_svms(records, KEYS, dhat=10, eps=0, most_rows=80).collect()  # both targets are large now
    alone = {r.record_id: r.prediction for r in models.private_svms(records, KEYS, dhat=10, eps=0).collect()}
    assert len(split) == 210 and all((r.probs is None) == (r.target_id == 1) for r in split)
    assert sum(alone[r.record_id] == r.prediction for r in split) >= 200
    assert len(got) == 210 and all((r.probs is None) == (r.target_id == 1) for r in got)  # three classes have no private SVM
    x = np.random.default_rng(1).normal(size=(200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + np.random.default_rng(2).normal(size=200) > 0).astype(int)
    w = models.hinge_weights(x, 2.0 * y - 1, 1.0, n_steps=5_000)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "y int, features array<double>")
    svm = models.fit(df, "LinearSVC", regParam=1 / 200, standardization=False, maxIter=500, tol=1e-9)
    goal = lambda v, b: 0.5 * v @ v + np.maximum(0, 1 - (2 * y - 1) * (x @ v + b)).sum()
    assert goal(w[:-1], w[-1]) <= goal(svm.coefficients.toArray(), svm.intercept) + 1e-3


def test_registered_repetitions_are_the_references(monkeypatch):
    asked = {}
    monkeypatch.setattr(audit.frames, "emb_probs", lambda *_: None)
    monkeypatch.setattr(audit, "_learnable", lambda *_: None)
    monkeypatch.setattr(audit, "cut_lineage", lambda df: df)
    monkeypatch.setattr(audit.worstcase, "report", lambda _, **given: asked.update(given))
    monkeypatch.setattr(audit.shadow, "tree_confidences", lambda _, __, **given: asked.update(given))
    audit.worstcase_rf(None, "")
    audit.shadow_train(None, "")
    assert "params" not in asked and (asked["n_reps"], asked["n_dummy_reps"], asked["n_models"]) == (10, 10, 100)
