"""Top items and ideal-point rankings."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest

from leakscope.llm import ranking, topn

DAY = datetime(2024, 1, 1)
SCHEMA = "score_id bigint, target_id bigint, record_id bigint, attack_name string, member_prob double, ingested_at timestamp, known_attack string"


def scores(spark, rows):
    return spark.createDataFrame([(i, t, r, a, p, DAY + timedelta(hours=h), "clash") for i, t, r, a, p, h in rows], SCHEMA)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("lira", "LiRA Attack"), ("LiRA Attack", "LiRA Attack"), ("qmia", "QMIA Attack")], "spelling string, attack_name string")


def test_top_scores(spark, names):
    rows = [(i, 1, 100 - i, " LIRA ", float(i // 2), 0) for i in range(20)]
    rows += [(30, 1, 1, "lira", 99.0, 0), (30, 1, 1, "lira", None, 1), (31, 1, 1, "lira", 99.0, 1), (31, 1, 1, "lira", -5.0, 0)]
    rows += [(40, 1, 5, "unknown", 100.0, 0), (41, 1, 5, None, 100.0, 0), (42, 1, 5, "lira", math.nan, 0), (None, 1, 5, "lira", 500.0, 0), (43, None, 5, "lira", 500.0, 0), (50, 2, 1, "qmia", 0.0, 0)]
    got = topn.top_scores(scores(spark, rows), names).select("target_id", "attack_name", "score_id", "item_rank").collect()
    first = [r.score_id for r in sorted(got, key=lambda r: r.item_rank) if r.target_id == 1]
    assert first == [31, 19, 18, 17, 16]  # ties by the smaller record_id, which falls with score_id
    assert [(r.target_id, r.attack_name, r.score_id) for r in got if r.target_id == 2] == [(2, "QMIA Attack", 50)]
    assert topn.top_scores(scores(spark, []), names).count() == 0


def test_plan_limits_groups_before_the_shuffle(spark, names):
    plan = topn.top_scores(scores(spark, [(1, 1, 1, "lira", 1.0, 0)]), names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def ranking_frame(spark, rows):
    return spark.createDataFrame(rows, "g int, id int, a double, b double, c int")


SCORES = [ranking.Score("a"), ranking.Score("b"), ranking.Score("c", smaller_first=True)]


def test_every_score_has_an_equal_say(spark):
    rows = [(1, i, float(i), -400.0 - i / 1000, 50) for i in range(20)] + [(1, 99, 1e9, -400.5, 100), (1, 77, 18.0, -400.0, 1)]
    order = [r.id for r in ranking.ranked(ranking_frame(spark, rows), "g", "id", SCORES).orderBy("place").collect()]
    assert order[0] == 77 and order.index(99) > 0
    scaled = [(g, i, a * 1e6 + 5, b, c) for g, i, a, b, c in rows]
    assert [r.id for r in ranking.ranked(ranking_frame(spark, scaled), "g", "id", SCORES).orderBy("place").collect()] == order


def test_ties_constants_nulls_and_small_groups(spark):
    rows = [(1, 2, 1.0, 1.0, 1), (1, 1, 1.0, 1.0, 1), (2, 5, None, 1.0, 1), (3, 8, 1.0, 5.0, 2), (3, 9, 1.0, 4.0, 2)]
    got = [(r.g, r.id, r.place) for r in ranking.ranked(ranking_frame(spark, rows), "g", "id", SCORES).orderBy("g", "place").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (3, 8, 1), (3, 9, 2)]
    assert ranking.ranked(ranking_frame(spark, []), "g", "id", SCORES).count() == 0


def test_exposed_records(spark, names):
    rows = [(10 * r + k, 1, r, a, float(r), 0) for r in range(1, 9) for k, a in ((1, "lira"), (2, "qmia"))] + [(999, 2, 1, "lira", 1.0, 0)]
    structs = spark.createDataFrame([(1, r, 10 - r, r > 6, DAY) for r in range(1, 9)] + [(1, 8, 2, True, DAY)], "target_id bigint, record_id bigint, k_anonymity int, smallgroup_risk boolean, ingested_at timestamp")
    wanted = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (None, 1)], "target_id bigint, top_n int")
    got = [(r.target_id, r.record_id) for r in ranking.exposed_records(scores(spark, rows), names, structs, wanted).orderBy("place").collect()]
    assert got == [(1, 8), (1, 7), (1, 6)]


def test_the_order_of_a_large_group_outlasts_the_cuts(spark):
    """More records than the limit lie beyond every cut; those farthest beyond have the largest identifiers."""
    rows = spark.range(100_000).selectExpr("1 AS g", "cast(id AS int) AS id", "cast(id AS double) AS a", "id / 7D AS b", "cast(100000 - id AS int) AS c")
    got = ranking.ranked(rows.selectExpr("*", "3 AS top_n"), "g", "id", SCORES, limit="top_n").orderBy("place").collect()
    assert [r.id for r in got] == [99_999, 99_998, 99_997] and got[0].closeness == 1
