"""The metric engine on small cases with known results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from leakscope.operators import metrics

#: label, non-member score, member score
SIX = [(0, 0.9, 0.1), (0, 0.4, 0.6), (0, 0.8, 0.2), (1, 0.55, 0.45), (1, 0.1, 0.9), (1, 0.01, 0.99)]


def frame(spark, rows, key="a"):
    return spark.createDataFrame([(key, i, y, s0, s1) for i, (y, s0, s1) in enumerate(rows)], "run string, record_id bigint, is_member int, s0 double, s1 double")


@pytest.fixture(scope="module")
def six(spark):
    return metrics.metrics(frame(spark, SIX), ["run"]).first()


def test_rates(six):
    for name in ("tpr", "tnr", "ppv", "npv", "acc", "f1score"):
        assert six[name] == pytest.approx(2 / 3, abs=1e-7)
    for name in ("fpr", "far", "fnr", "advantage"):
        assert six[name] == pytest.approx(1 / 3, abs=1e-7)
    assert six.auc == pytest.approx(8 / 9, abs=1e-8)
    assert (six.n_pos, six.n_neg) == (3, 3)


def test_tpr_at_rates(spark):
    running = metrics.running_counts(metrics.score_counts(frame(spark, SIX), ["run"]), ["run"])
    out = metrics.tpr_at_fpr(running, ["run"], (0, 0.1, 10, 40, 100)).first()
    assert [out[metrics.tpr_name(p)] for p in (0, 0.1, 10)] == pytest.approx([2 / 3] * 3)
    assert [out[metrics.tpr_name(p)] for p in (40, 100)] == pytest.approx([1, 1])


def test_outermost(spark):
    df = frame(spark, SIX)
    running = metrics.running_counts(metrics.score_counts(df, ["run"]), ["run"])
    out = metrics.outermost(df, running, ["run"], {"a": 0.1, "b": 0.5}).first()
    assert (out.fmaxa, out.fmina, out.fdifa) == (1, 0, 1)
    assert (out.fmaxb, out.fminb, out.fdifb) == pytest.approx((2 / 3, 1 / 3, 1 / 3))


def test_constant_scores(spark):
    out = metrics.metrics(frame(spark, [(1, 1.0, 0.0)] + [(0, 1.0, 0.0)] * 3), ["run"]).first()
    assert (out.acc, out.auc, out.tpr) == (0.75, 0.5, 0)
    assert out.p_higher_auc == pytest.approx(0.5)


def test_underflow_is_a_constant(spark):
    n, members = 5_000, 25
    rows = [(int(i < members), 1 - s, s) for i in range(n) for s in [1.0 if i < members else 0.0]]
    assert metrics.metrics(frame(spark, rows), ["run"]).first().pdif001 == pytest.approx(115.13)
    upside_down = [(y, s1, s0) for y, s0, s1 in rows]
    assert metrics.metrics(frame(spark, upside_down), ["run"]).first().pdif001 == pytest.approx(0, abs=1e-3)


def test_roc_drops_collinear_points(spark):
    running = metrics.running_counts(metrics.score_counts(frame(spark, SIX), ["run"]), ["run"])
    points = [(round(r.fpr, 6), round(r.tpr, 6)) for r in metrics.roc(running, ["run"]).orderBy(F.desc("threshold"), "fpr").collect()]
    assert points[0] == (0, 0) and points[-1] == (1, 1) and (0, 0.666667) in points
    assert len(points) < len(SIX) + 1


def test_two_levels_equal_one_window(spark):
    rows = [(i % 3 == 0, 0.0, ((i * 37) % 501) / 7) for i in range(2_000)]
    counts = metrics.score_counts(frame(spark, [(int(y), a, b) for y, a, b in rows]), ["run"])
    one = metrics.running_counts(counts, ["run"]).select("s1", "cum_p", "cum_n", "total_p", "total_n").orderBy("s1").collect()
    two = metrics.running_counts(counts, ["run"], one_window=10, ranges=16).select("s1", "cum_p", "cum_n", "total_p", "total_n").orderBy("s1").collect()
    assert one == two


def test_large_ties_equal_small_ones(spark, monkeypatch):
    df = frame(spark, [(int(i % 3 == 0), 0.0, float(i % 4 == 0)) for i in range(200)])
    running = metrics.running_counts(metrics.score_counts(df, ["run"]), ["run"])
    small = metrics.outermost(df, running, ["run"]).collect()
    monkeypatch.setattr(metrics, "ONE_WINDOW", 1)
    assert metrics.outermost(df, running, ["run"]).collect() == small


def test_all_runs_at_once_and_order(spark):
    both = frame(spark, SIX).unionByName(frame(spark, [(y, s1, s0) for y, s0, s1 in SIX], "b"))
    out = {r.run: r.auc for r in metrics.metrics(both.orderBy("s1"), ["run"], p_values=False).collect()}
    assert out["a"] == pytest.approx(8 / 9) and out["b"] == pytest.approx(1 - 8 / 9)


def test_nulls_nan_empty_and_one_class(spark):
    raw = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 2, 0, math.nan), ("a", 3, 0, None), ("a", 4, None, 0.4), (None, 5, 1, 0.3)], "run string, id bigint, m int, s double")
    df = metrics.scored(raw, ["run"], "id", F.col("m"), 1 - F.col("s"), F.col("s"))
    assert df.count() == 1
    out = metrics.metrics(df, ["run"]).first()
    assert out.auc is None and out.fpr is None and out.far == 0
    assert metrics.metrics(df.limit(0), ["run"]).count() == 0


def test_shapes_are_checked(spark):
    df = spark.createDataFrame([("a", 1, 1, [0.1, 0.2, 0.7])], "run string, id bigint, m int, p array<double>")
    with pytest.raises(Exception, match="multiclass"):
        metrics.from_score_array(df, ["run"], "id", F.col("m"), "p").collect()
    with pytest.raises(ValueError, match="y_pred"):
        metrics.from_score_array(df, ["run"], "id", F.col("m"), "m")


def test_mean_roc_ends_in_one(spark):
    running = metrics.running_counts(metrics.score_counts(frame(spark, SIX), ["run"]), ["run"])
    out = metrics.mean_roc(running, ["run"], [], points=11).orderBy("point").collect()
    assert [r.point for r in out] == list(range(11)) and out[-1].mean_tpr == 1 and out[0].mean_tpr == pytest.approx(2 / 3)
