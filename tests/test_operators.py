"""The other audit operators on small cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.functions import exprs, stats
from leakscope.operators import attribute, equivalence, instances, lira, meta, models, qmia, rules, sampling, significance, structural, worstcase
from leakscope.sources import bundle, report_sink


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_expressions(spark):
    p, y = F.col("p"), F.col("y")
    assert one(spark, exprs.hinge(p, y), p=[0.8, 0.2], y=0) == pytest.approx(2 * math.log(4))
    assert one(spark, exprs.hinge(p, y), p=[0.3, 0.7], y=1) == pytest.approx(2 * math.log(7 / 3))
    assert one(spark, exprs.hinge(p, y), p=[0.2, 0.5, 0.3], y=1) == pytest.approx(-math.log(0.3 / 0.7))
    assert one(spark, exprs.hinge(p, y), p=[1.0], y=0) is None
    assert one(spark, exprs.logit(p), p=1.0) == pytest.approx(36.7368, abs=1e-3)
    assert one(spark, exprs.logit(p), p=0.0) == pytest.approx(-36.8414, abs=1e-3)
    assert one(spark, exprs.safe_div(p, y), p=8, y=1) == 8 and one(spark, exprs.safe_div(p, y, 99), p=8, y=0) == 99
    assert one(spark, exprs.argmax(p), p=[0.5, 0.5]) == 0
    assert one(spark, exprs.unique_max(p), p=[0.3, 0.5, 0.2]) and not one(spark, exprs.unique_max(p, 0.6), p=[0.3, 0.5, 0.2])
    assert not one(spark, exprs.unique_max(p), p=[0.5, 0.5])
    assert one(spark, exprs.clip01(p), p=math.nan) == 1 and one(spark, exprs.clip01(p), p=-3.0) == 0
    assert one(spark, exprs.sorted_probs(p, F.lit(True)), p=[0.2, 0.8]) == [0.8, 0.2, 1.0]
    grid = one(spark, exprs.linspace(p, y, 5), p=0.0, y=1.0)
    assert grid == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    assert one(spark, exprs.row_close(p, y), p=[1.0, 2.0], y=[1.0 + 1e-6, 2.0]) and not one(spark, exprs.row_close(p, y), p=[1.0], y=[1.0, 2.0])


def test_normal_tails_and_normality(spark):
    assert one(spark, stats.normal_cdf(F.col("p")), p=1.959963985) == pytest.approx(0.975, abs=1e-9)
    for z in (-7.5, -3.0, -0.3, 0.0, 0.2, 1.0, 5.5, 9.0):
        assert one(spark, stats.normal_cdf(F.col("p")), p=z) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-14)
    assert one(spark, stats.neg_log(stats.upper_ps(F.col("p"))[0]), p=40.0) == pytest.approx(115.13)
    rng = np.random.default_rng(1)
    assert stats.shapiro_p(rng.normal(size=50)) > 0.05 and stats.shapiro_p(rng.exponential(size=50)) < 0.01
    assert math.isnan(stats.shapiro_p(np.ones(20))) and math.isnan(stats.shapiro_p(rng.normal(size=7)))


def test_equivalence_classes(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None)], "record_id int, probs array<double>")
    risks = {r.record_id: r for r in equivalence.record_risks(df, "probs").collect()}
    assert set(risks) == {1, 2, 3} and risks[1].k_anonymity == 2 and risks[1].class_disclosure and risks[3].smallgroup_risk
    whole = equivalence.global_risks(equivalence.classes(df, "probs")).first()
    assert whole.min_k == 1 and whole.k_anonymity_risk and whole.n_classes == 2
    assert equivalence.global_risks(equivalence.classes(df.limit(0), "probs")).first().min_k is None
    xor = spark.createDataFrame([(i, int(i % 4)) for i in range(256)], "record_id int, leaf int")
    assert equivalence.smallest_leaf(xor, "leaf").first().k_anonymity == 64


def test_structure(spark):
    df = spark.createDataFrame([(1, True)] * 32 + [(0, True)] * 27 + [(0, False)] * 5, "is_member int, ok boolean")
    assert structural.generalisation_gap(df, F.col("ok")).first().generalisation_gap == pytest.approx(0.15625)
    assert structural.dof_risk(df, F.lit(60)).first().dof_risk
    params = spark.createDataFrame([(0, None, 2, 2, "best"), (5, None, 2, 20, "best"), (3, None, 2, 2, "best")], "max_depth int, max_features string, min_samples_leaf int, min_samples_split int, splitter string")
    assert [r.unnecessary_risk for r in structural.unnecessary_risk(params, "DecisionTreeClassifier").collect()] == [True, True, False]
    same = spark.createDataFrame([(m, float(i)) for i in range(50) for m in (0, 1)], "is_member int, v double")
    test = structural.ks_test(same, "v").first()
    assert test.ks_stat == 0 and not test.ks_risk


def test_lira(spark):
    shadow = spark.createDataFrame([(0, 1, True, 1.0), (1, 1, True, 3.0), (2, 1, False, 0.0), (3, 1, False, 2.0), (0, 2, True, math.nan)], "model_idx int, record_id int, in_train boolean, conf double")
    got = {r.record_id: r for r in lira.shadow_stats(shadow).collect()}
    assert (got[1].in_mean, got[1].in_std, got[1].out_mean, got[1].out_std) == (2, 1, 1, 1) and got[2].in_std == 0
    targets = spark.createDataFrame([(1, 1, 2.0)], "record_id int, is_member int, target_logit double")
    assert lira.scores(targets, lira.shadow_stats(shadow), "offline").first().s1 == pytest.approx(0.8413447, abs=1e-6)
    online = lira.scores(targets, lira.shadow_stats(shadow), "online-carlini").first()
    assert online.s1 == pytest.approx(0.5) and online.s0 == pytest.approx(-0.5)
    many = spark.createDataFrame([(m, r, False, float(m % 2) * r) for m in range(20) for r in (0, 1)], shadow.schema)
    assert lira.share_non_normal(lira.normality(many)).first().n_normal == 1  # two values are far from normal; no spread has no p-value
    with pytest.raises(ValueError, match="unknown mode"):
        lira.scores(targets, lira.shadow_stats(shadow), "other")


def test_qmia(spark):
    rows = [(i, int(i % 2), i / 10, 0.5 if i < 3 else 20.0) for i in range(40)]
    df = qmia.margins(spark.createDataFrame(rows, "record_id int, is_member int, score double, threshold double"))
    out = qmia.calibration(df, alpha=0.05).first()
    assert out.observed_fpr == pytest.approx(0) and out.calibrated
    assert not qmia.degenerate(df).first().degenerate and qmia.degenerate(df.withColumn("threshold", F.lit(1.0))).first().degenerate


def test_instances(spark):
    corners = [(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None)]
    train = spark.createDataFrame(corners, "record_id int, features array<double>")
    stored = spark.createDataFrame([(10, 0, [0.0, 0.0]), (11, 0, [1.0, 1.0 + 1e-9]), (12, 0, [5.0, 5.0]), (13, None, [1.0, 0.0])], "stored_id int, hint int, features array<double>")
    matched = instances.match(stored, train)
    assert {(r.stored_id, r.record_id) for r in matched.collect()} == {(10, 0), (11, 3), (13, 2)}
    assert instances.fractions(stored, matched, train).first().match_fraction == 0.75
    assert instances.stores_instances("SVC") and not instances.stores_instances("RandomForestClassifier")


def test_meta(spark):
    scores = spark.createDataFrame([(1, "lira", 1, 0.6), (1, "lira", 1, 0.8), (2, "lira", 0, 0.4), (1, "qmia", 1, 7.0), (2, "qmia", 0, math.nan)], "record_id int, attack string, is_member int, score double")
    structs = spark.createDataFrame([(1, 2, False, False), (1, 4, False, False)], "record_id int, k_anonymity int, class_disclosure boolean, smallgroup_risk boolean")
    wide = {r.record_id: r for r in meta.matrix(meta.repetitions(scores), ["lira", "qmia"], meta.structural_repetitions(structs)).collect()}
    assert wide[1].lira_mean == pytest.approx(0.7) and wide[1].struct_k == 3 and wide[1].n_vulnerable == 3 and wide[1].vulnerable_to_all
    assert wide[2].qmia_mean == 1 and wide[2].struct_k is None and wide[2].n_vulnerable == 1


def test_significance(spark):
    rows = [("a", p, 0.7) for p in (0.001, 0.02, 0.03, 0.5)] + [("b", None, 0.5)]
    df = spark.createDataFrame(rows, "experiment string, p_higher_auc double, auc double")
    got = {r.experiment: r for r in significance.corrected(df, ["experiment"]).collect()}
    assert (got["a"].n_significant, got["a"].n_step_up, got["a"].n_bh, got["a"].n_bonferroni) == (3, 3, 3, 1) and got["b"].n_total == 0
    buckets = {(r.experiment, r.bucket) for r in significance.recommendation(df).collect()}
    assert ("a", "support_rejection") in buckets and ("b", "support_release") in buckets
    assert one(spark, significance.significance_text(F.col("p")), p=0.05) == "Significant at p=0.05"
    assert one(spark, significance.significance_text(F.col("p"), strict=True), p=0.05).startswith("Not")


def test_rules(spark):
    params = spark.createDataFrame(
        [(1, "RandomForestClassifier", "bootstrap", "true", "bool"), (1, "RandomForestClassifier", "min_samples_leaf", "5", "int"), (2, "RandomForestClassifier", "bootstrap", "false", "bool"), (2, "RandomForestClassifier", "min_samples_leaf", "x", "str")],
        "model_id int, model_type string, keyword string, value string, value_type string",
    )
    base = rules.shipped_rules(spark)
    got = {r.model_id: r for r in rules.check(params, base).collect()}
    assert not got[1].disclosive and got[2].disclosive and "bootstrap" in got[2].messages
    either = spark.createDataFrame([("M", 1, None, "or", None, None), ("M", 2, 1, "min", "a", "3"), ("M", 3, 1, "max", "b", "3"), ("M", 4, None, "odd", "a", "1")], rules._SCHEMA)
    some = spark.createDataFrame([(7, "M", "a", "1", "int"), (7, "M", "b", "2", "int"), (8, "M", "a", "1", "int"), (8, "M", "b", "9", "int")], params.schema)
    assert {r.model_id: r.disclosive for r in rules.check(some, either).collect()} == {7: False, 8: True}
    fixed = {(r.model_id, r.keyword): r.value for r in rules.apply_constraints(params, base).collect()}
    assert fixed[2, "bootstrap"] == "true" and fixed[2, "min_samples_leaf"] == "5"
    now = params.select("model_id", F.col("keyword").alias("path"), "value")
    assert rules.differences(now, now).count() == 0
    verdict = {r.model_id: r.recommendation for r in rules.release(rules.check(params, base), rules.differences(now, now), now).collect()}
    assert verdict[1].startswith("Proceed") and verdict[2].startswith("Do not")


def test_sampling(spark):
    df = spark.range(1_000).withColumn("m", (F.col("id") % 4 == 0).cast("int"))
    assert sampling.hash_sample(df, ["m"], F.lit(33), "id").groupBy("m").count().collect() == sampling.hash_sample(df, ["m"], F.lit(33), "id").groupBy("m").count().collect()
    assert {r["count"] for r in sampling.hash_sample(df, ["m"], F.lit(33), "id").groupBy("m").count().collect()} == {33}
    member = sampling.shadow_membership(df.withColumnRenamed("id", "record_id"), 3, 250)
    assert {(r.model_idx, r.n) for r in member.groupBy("model_idx").agg(F.count_if("in_train").alias("n")).collect()} == {(0, 250), (1, 250), (2, 250)}
    split = sampling.stratified_split(df, ["m"], 0.2, "id")
    assert {(r.m, r.n) for r in split.groupBy("m").agg(F.count_if("in_test").alias("n")).collect()} == {(0, 150), (1, 50)}
    assert sampling.split_seeds(3, 4) == [3, 9, 16, 25] and sampling.split_seeds([1, 1, 2], 3) == [1, 2, 4] and sampling.split_seeds([5, 6, 7], 2) == [5, 6]
    assert sampling.hash_sample(df.limit(0), ["m"], F.lit(3), "id").count() == 0


def test_models_and_attacks(spark):
    rows = [(i, int(i < 120), int((i * 7) % 10 > 4), [((i * 7) % 10) / 10.0, float(i % 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id int, is_member int, y int, features array<double>")
    tree = models.fit(df.filter("is_member = 1"), "DecisionTreeClassifier", maxDepth=3)
    steps = models.pipeline(models.estimator("DecisionTreeClassifier", maxDepth=3)).fit(models.vectorised(df.filter("is_member = 1")))
    assert models.inner_model(steps).numNodes == tree.numNodes and models.inner_model(tree) is tree
    scored = models.losses(models.score(tree, df))
    assert scored.agg(F.avg(F.col("correct").cast("double"))).first()[0] == 1
    assert models.parameter_count(tree) == 2 * (tree.numNodes // 2) + (tree.numNodes + 1) // 2
    placed = models.leaves(df, "RandomForestClassifier", maxDepth=2, numTrees=3)
    assert equivalence.smallest_leaf(placed, "leaf").first().k_anonymity >= 1
    runs = worstcase.attack(models.score(tree, df).withColumn("y", F.lit(0)), n_reps=1, params={"numTrees": 2, "maxDepth": 2})
    assert runs.count() == math.ceil(120 * 0.2) + math.ceil(80 * 0.2)
    risk = attribute.risk_totals(attribute.categorical_attack(df, tree, [1], [0.0, 1.0, 2.0], F.get("features", F.lit(1)))).collect()
    assert sum(r.n_records for r in risk) == 200 and all(r.n_inferred == 0 for r in risk)  # the model does not use that feature
    assert attribute.bounds_fraction(attribute.quantitative_attack(df, tree, 0, n_points=10)).count() == 2
    with pytest.raises(ValueError, match="unknown model"):
        models.estimator("Nothing")


def test_bundle_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, [0.1], [0.9, 0.1]), (2, 0, 1, [0.2], [math.nan, 0.6])], "record_id int, is_member int, y int, features array<double>, probs array<double>")
    bundle.save_target(df, str(tmp_path / "t"), {"name": "t"})
    back, manifest = bundle.load_target(spark, str(tmp_path / "t"))
    assert back.count() == 2 and manifest["name"] == "t"
    bundle.save_target(df, str(tmp_path / "d"), {"name": "d"}, dataset="mine")
    again, _ = bundle.load_target(spark, str(tmp_path / "d"), {"mine": lambda s: df})
    assert set(again.columns) == set(df.columns) and again.count() == 2
    with pytest.raises(ValueError, match="no reader"):
        bundle.load_target(spark, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="unsupported"):
        bundle.read_array(spark, "x.pkl")
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    assert [r["values"] for r in bundle.read_array(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()] == [[1, 2], [3, 4]]
    assert report_sink.sanitised(df).filter("record_id = 2").first().probs == [None, 0.6]
    rows = report_sink.report_rows(df.select("record_id", F.lit(math.inf).alias("x"), F.lit(0.5).alias("auc")), "LiRA", "log-1", "record_id", {"v": 1})
    report_sink.append_report(rows, str(tmp_path / "r"))
    report_sink.append_report(rows, str(tmp_path / "r"))
    kept = report_sink.read_reports(spark, str(tmp_path / "r"), ["LiRA"])
    assert kept.count() == 4 and '"auc":0.5' in kept.first().instance and "x" not in kept.first().instance
    report_sink.write_csv(df.select("record_id"), str(tmp_path / "c"))
    assert "record_id" in report_sink.text_report(df, "Title", ["record_id", "y"])


def test_cli(spark, tmp_path):
    from leakscope import cli

    rows = [(i, int(i < 60), int(i % 2), [float(i % 5), float(i % 2)], [0.3, 0.7] if i % 2 else [0.6, 0.4]) for i in range(100)]
    bundle.save_target(spark.createDataFrame(rows, "record_id int, is_member int, y int, features array<double>, probs array<double>"), str(tmp_path / "t"), {"name": "t"})
    logs = cli.run(spark, str(tmp_path / "t"), {"attacks": [{"name": "structural", "params": {}}]}, str(tmp_path / "out"))
    assert report_sink.read_reports(spark, str(tmp_path / "out")).first().log_id == logs[0]
    with pytest.raises(ValueError, match="unknown attack"):
        cli.run(spark, str(tmp_path / "t"), {"attacks": [{"name": "none"}]}, str(tmp_path / "out"))
