"""Safe models and their release, stores of models, all attacks from the command line, and the sinks beside them."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope import cli
from leakscope.operators import meta, models, safe, sampling, shadow, worstcase
from leakscope.sources import bundle, report_json, report_sink


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        y = int(rng.random() < 0.5)
        x = [rng.gauss(y, 0.7), float(rng.randint(0, 3)), rng.gauss(0, 1)]
        p = min(0.99, max(0.01, 0.5 + (0.4 if y else -0.4) * rng.random()))
        rows.append((i, int(i < 100), y, x, [1 - p, p]))
    return spark.createDataFrame(rows, "record_id int, is_member int, y int, features array<double>, probs array<double>").cache()


def test_a_safe_tree_is_released_and_a_changed_one_is_not(spark, records, tmp_path):
    tree = safe.SafeModel(spark, "DecisionTreeClassifier", max_depth=3, min_samples_leaf=6)
    assert not tree.disclosive and tree.posthoc_check() == (True, ["the model was not fitted"])
    tree.fit(records.filter("is_member = 1"))
    assert tree.k_anonymity >= 6 and tree.posthoc_check() == (False, [])
    out = tree.request_release(str(tmp_path / "tree.model"), records, {"worstcase": lambda r: cli.run_worstcase(r, n_reps=1, params={"numTrees": 2, "maxDepth": 2})})
    assert out["recommendation"] == "Proceed to release" and out["attacks"] == {"worstcase": 2}
    assert {r.run for r in report_sink.read_reports(spark, str(tmp_path / "tree.model-attacks"), ["worstcase"]).collect()} == {"attack_0", "dummy_0"}
    again = models.load("DecisionTreeClassifier", str(tmp_path / "tree.model"))
    assert again.numNodes == tree.model.numNodes
    assert json.loads(spark.read.text(str(tmp_path / "tree.model-report")).first()[0])["model"] == "DecisionTreeClassifier"
    tree.params["min_samples_leaf"] = 2
    changed, how = tree.posthoc_check()
    assert changed and how == ["min_samples_leaf: 6 at fitting, 2 now"]
    assert tree.request_release(str(tmp_path / "tree.model"))["recommendation"] == "Do not allow release"
    assert tree.preliminary_check(apply_constraints=True)[0] and tree.params["min_samples_leaf"] == 5
    assert tree.save("x.pkl").startswith("not saved")
    with pytest.raises(ValueError, match="takes no"):
        safe.SafeModel(spark, "DecisionTreeClassifier", depth=3)


def test_another_forest_or_svm_under_the_same_name_is_seen(spark, records):
    members = records.filter("is_member = 1")
    forest = safe.SafeModel(spark, "RandomForestClassifier", n_estimators=3, max_depth=2).fit(members)
    assert forest.posthoc_check() == (False, [])
    other = safe.SafeModel(spark, "RandomForestClassifier", n_estimators=3, max_depth=2, random_state=9).fit(members)
    forest.model = other.model
    assert forest.posthoc_check()[1][0].endswith("of 3 trees differ")
    svm = safe.SafeModel(spark, "SVC", dhat=5).fit(members)
    assert svm.disclosive and "dhat" in svm.messages and svm.posthoc_check() == (False, [])
    svm.model.intercept += 1
    assert svm.posthoc_check() == (True, ["the weights differ"])


def test_shadow_models_are_taken_up_again(spark, records, tmp_path, monkeypatch):
    membership = sampling.shadow_membership(records, 3, 100)
    first = models.shadow_confidences(records, membership, "DecisionTreeClassifier", store=str(tmp_path), maxDepth=2)
    rows = {tuple(r) for r in first.collect()}
    assert {r[0] for r in rows} == {0, 1, 2} and len(rows) == 3 * 160

    def none(*_, **__):
        raise AssertionError("a stored model was fitted again")

    fit = models.fit
    monkeypatch.setattr(models, "fit", none)
    assert {tuple(r) for r in models.shadow_confidences(records, membership, "DecisionTreeClassifier", store=str(tmp_path), maxDepth=2).collect()} == rows
    monkeypatch.setattr(models, "fit", fit)
    more = models.shadow_confidences(records, sampling.shadow_membership(records, 4, 100), "DecisionTreeClassifier", store=str(tmp_path), maxDepth=2)
    assert {r.model_idx for r in more.select("model_idx").distinct().collect()} == {0, 1, 2, 3}
    keyed = records.withColumn("target_id", F.lit(1))
    asked = []

    def compute(missing):
        asked.append(missing)
        return shadow.tree_confidences(keyed, ["target_id"], 4, 2, only=missing)

    own = str(tmp_path / "own")
    two = {tuple(r) for r in shadow.stored(spark, own, 2, compute).select("model_idx", "record_id", "conf").collect()}
    four = {tuple(r) for r in shadow.stored(spark, own, 4, compute).select("model_idx", "record_id", "conf").collect()}
    assert asked == [[0, 1], [2, 3]] and two < four
    broken = tmp_path / "own" / "broken"  # a write that did not end
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"cut off")
    assert shadow.stored(spark, own, 4, compute).count() == len(four) and len(asked) == 2
    assert four == {tuple(r) for r in shadow.tree_confidences(keyed, ["target_id"], 4, 2).select("model_idx", "record_id", "conf").collect()}


SMALL = {
    "worstcase": {"n_reps": 2, "params": {"numTrees": 2, "maxDepth": 2}},
    "lira": {"model": "DecisionTreeClassifier", "n_shadow_models": 3, "maxDepth": 2, "mode": "online-carlini"},
    "qmia": {"alpha": 0.1},
    "structural": {},
    "attribute": {"maxDepth": 2},
    "instance_based": {},
    "meta": {"lira_params": {"model": "DecisionTreeClassifier", "n_shadow_models": 2, "maxDepth": 2}},
}


def test_every_attack_runs_from_a_configuration(spark, records, tmp_path):
    assert set(cli.ATTACKS) == set(SMALL) == {a["name"] for a in cli.default_config()["attacks"]}
    target, out = str(tmp_path / "t"), str(tmp_path / "out")
    tree = models.fit(records.filter("is_member = 1"), "DecisionTreeClassifier", maxDepth=2)
    bundle.save_target(records, target, {"name": "t"}, model=tree, model_name="DecisionTreeClassifier")
    assert bundle.load_model(target, bundle.load_target(spark, target)[1]).numNodes == tree.numNodes
    logs = cli.run(spark, target, {"attacks": [{"name": n, "params": p} for n, p in SMALL.items()]}, out)
    got = {}
    for r in report_sink.read_reports(spark, out).collect():
        got.setdefault(r.attack_name, []).append((r.run, json.loads(r.instance)))
    assert len(logs) == 7 and set(got) == set(SMALL)
    assert {r for r, _ in got["worstcase"]} == {"attack_0", "attack_1", "dummy_0"}
    assert "calibrated" in got["qmia"][0][1] and "ks_p" in got["structural"][0][1] and got["instance_based"][0][1]["leaks"]
    assert {r for r, _ in got["attribute"]} == {f"f{i}_{s}" for i in range(3) for s in ("train", "test")}
    assert got["meta"][0][1]["n_records"] == 160 and 0 <= got["lira"][0][1]["auc"] <= 1


def test_a_configuration_is_asked_for():
    answers = iter(["n"] + ["y", '{"alpha": 0.1}'] + ["n"] * 9)
    names = sorted(cli.ATTACKS)
    asked = cli.asked_config(lambda q: next(answers))
    assert asked == {"attacks": [{"name": names[1], "params": {"alpha": 0.1}}]}


def test_one_hot_features_are_one_attribute(spark, records):
    rows = records.withColumn("features", F.concat(F.slice("features", 1, 1), F.when(F.col("record_id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))))
    features = {"0": {"name": "x", "indices": [0], "encoding": "float"}, "1": {"name": "kind", "indices": [1, 2], "encoding": "onehot"}}
    out = {r.run: r for r in cli.run_attribute(rows, features=features, maxDepth=2).collect()}
    assert set(out) == {"x_train", "x_test", "kind_train", "kind_test"} and out["kind_train"].n_unique == 2 and out["x_test"].risk_fraction is not None


def test_meta_modes(spark):
    cached = spark.createDataFrame([(1, "lira", 1, 1, 0.5)], "target_id int, attack string, record_id int, is_member int, score double")
    wanted = spark.createDataFrame([(1, "lira"), (1, "qmia"), (2, "lira")], "target_id int, attack string")
    run = lambda runs: runs.withColumns({"record_id": F.lit(9), "is_member": F.lit(0), "score": F.lit(0.1)})
    of = lambda mode: {(r.target_id, r.attack, r.record_id) for r in meta.gathered(wanted, cached, run, mode).collect()}
    assert of("use_existing_only") == {(1, "lira", 1)} and of("fill_missing") == {(1, "lira", 1), (1, "qmia", 9), (2, "lira", 9)}
    assert of("run_all") == {(1, "lira", 9), (1, "qmia", 9), (2, "lira", 9)}
    with pytest.raises(ValueError, match="unknown mode"):
        meta.gathered(wanted, cached, run, "other")
    with pytest.raises(ValueError, match="needs a way"):
        meta.gathered(wanted, cached)


def test_searches(records):
    grid = worstcase.tuning_grid(maxDepth=[1, 2], numTrees=[2])
    assert grid == [{"maxDepth": 1, "numTrees": 2}, {"maxDepth": 2, "numTrees": 2}]
    few = worstcase.random_grid(3, **worstcase.GRIDS["RandomForestClassifier"])
    assert len(few) == 3 and few == worstcase.random_grid(3, **worstcase.GRIDS["RandomForestClassifier"]) and len(worstcase.random_grid(99, a=[1, 2])) == 2
    gap = worstcase.tuned(records, grid, metric=lambda: F.col("tpr") - F.col("fpr"), n_reps=1)
    assert worstcase.tuned(records, grid, n_reps=1) in grid and gap in grid and worstcase.tuned(records, []) == {}


def test_nan_does_not_stretch_the_grid(spark):
    from leakscope.operators import attribute

    rows = [(i, int(i % 2), int(i in (20, 21)), [float(i), 1.0]) for i in range(1, 41)]
    odd = [(100, 1, 1, [float("nan"), 1.0]), (101, 0, 1, [None, 1.0])]
    schema = "record_id int, is_member int, y int, features array<double>"
    tree = models.fit(spark.createDataFrame(rows, schema), "DecisionTreeClassifier", maxDepth=3)
    plain = sorted(map(tuple, attribute.quantitative_attack(spark.createDataFrame(rows, schema), tree, 0).collect()))
    assert sorted(map(tuple, attribute.quantitative_attack(spark.createDataFrame(rows + odd, schema), tree, 0).collect())) == plain and any(r[2] for r in plain)


def test_arrays_pdf_and_moved_files(spark, tmp_path):
    arrays = {"x": np.arange(6.0).reshape(3, 2), "y": np.array([1, 0, 1])}
    df = bundle.from_arrays(spark, arrays)
    back = bundle.to_arrays(df.orderBy("row_no"), ["x", "y"])
    assert (back["x"] == arrays["x"]).all() and (back["y"] == arrays["y"]).all()
    with pytest.raises(ValueError, match="differ in length"):
        bundle.from_arrays(spark, {"x": np.zeros(2), "y": np.zeros(3)})
    with pytest.raises(ValueError, match="more than 2 rows"):
        bundle.to_arrays(df, ["y"], max_rows=2)
    report_sink.pdf_report("a (line) \\ é 한\n" * 130, str(tmp_path / "r.pdf"))
    pdf = (tmp_path / "r.pdf").read_bytes()
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf.startswith(b"%PDF-1.4") and pdf[start:].startswith(b"xref") and pdf.count(b"/Type /Page ") == 3 and b"(a \\(line\\) \\\\" in pdf
    for name in ("a.json", "b.model", "c.txt"):
        (tmp_path / name).write_text("x")
    assert report_sink.release_files(str(tmp_path), str(tmp_path / "release")) == ["a.json", "c.txt", "r.pdf"] and (tmp_path / "b.model").exists()


def test_report_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    section = {"log_id": "l", "metadata": {"attack_name": "lira"}, "attack_experiment_logger": {"attack_instance_logger": [{"individual": {"member_prob": [0.5, "x"], "member": [1, 0]}}]}}
    (tmp_path / "sub" / "report.json").write_text(json.dumps(section, indent=2))
    (tmp_path / "other.txt").write_text("no")
    rows = report_json.entry_scores(report_json.scan_folder(spark, str(tmp_path))).orderBy("entry_no").collect()
    assert [(r.log_id, r.attack_name, r.entry_no, r.member, r.member_prob) for r in rows] == [("l", "lira", 0, 1.0, 0.5), ("l", "lira", 1, 0.0, None)]
