"""Cross-split overlaps against a comparison of all pairs, and their defined cases."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from leakscope.llm import overlap

DAY = datetime(2024, 1, 1)
SCHEMA = "record_id bigint, target_id bigint, split string, source string, features array<double>, ingested_at timestamp, bucket string, cell string, size int"


def records(spark, rows):
    """rows: (record_id, target_id, split, features); columns that clash with the operator's own names are added."""
    return spark.createDataFrame([(i, t, s, "src", f, DAY, "x", "y", 1) for i, t, s, f in rows], SCHEMA)


def missing(v):
    return v is None or math.isnan(v)


def brute(rows):
    out = set()
    for i, t, s, f in rows:
        for j, u, z, g in rows:
            if s == "train" and z != "train" and t == u and f and g and len(f) == len(g):
                bad = sum(not ((missing(a) and missing(b)) or (not missing(a) and not missing(b) and abs(a - b) <= 0.02 + 1e-9)) for a, b in zip(f, g, strict=True))
                if 8 * bad <= len(f):
                    out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows):
    return {tuple(r) for r in overlap.found_pairs(records(spark, rows)).collect()}


def noisy(rng, f, changes):
    g = [v if v is None or rng.random() < 0.3 else round(v + rng.choice([-0.02, -0.01, 0.02, 0.0]), 5) for v in f]
    for k in rng.sample(range(len(f)), changes):
        g[k] = rng.choice([None, 7.77, math.nan])
    return g


def test_against_all_pairs(spark):
    rng, rows, n = random.Random(5), [], 0
    for target in range(4):
        width = rng.choice([7, 8, 16, 24])
        base = [[rng.choice([None, math.nan, 0.0, 1.0, round(rng.gauss(0, 1), 5)]) if rng.random() < 0.3 else round(rng.gauss(0, 1), 5) for _ in range(width)] for _ in range(40)]
        for f in base:
            rows.append((n := n + 1, target, "train", f))
            for _ in range(rng.choice([0, 1, 2])):
                rows.append((n := n + 1, target, rng.choice(["test", "test_late", "train"]), noisy(rng, f, rng.randint(0, width // 8 + 1))))
    want = brute(rows)
    assert len(want) > 40 and found(spark, rows) == want


def test_flags_and_constant_features(spark):
    rng = random.Random(3)
    rows = [(i, 1, "train" if i % 2 else "test", [float(rng.random() < 0.5) for _ in range(10)]) for i in range(60)]
    rows += [(100 + i, 2, "train" if i % 2 else "test", [1.0] * 9) for i in range(12)]
    assert found(spark, rows) == brute(rows)


@pytest.fixture
def small_runs(monkeypatch):
    """The walk runs in other processes, so the limit is handed over with it."""
    monkeypatch.setattr(overlap, "RUN_PAIRS", 50)
    monkeypatch.setattr(overlap, "BLOCK", 7)


def shared_half(n=150):
    rng = random.Random(4)
    # half of each record is shared by all: its window is one large run
    return [(i, 1, "train" if i % 3 else "test", [0.5] * 8 + [round(rng.choice([0.0, 3.0, 6.0]) + rng.random() / 50, 5) for _ in range(8)]) for i in range(n)]


def detailed(spark, rows):
    return sorted((r.train_record, r.evaluation_record, round(r.coverage, 9), r.n_disagree) for r in overlap.overlaps(records(spark, rows)).collect())


def test_large_runs_change_nothing(spark, monkeypatch, request):
    rng = random.Random(9)
    rows = shared_half() + [(1000 + i, 2, "train" if i % 2 else "test_late", [0.1266] * 14 + [round(rng.random() * 4, 3), 1.0]) for i in range(40)]
    plain = detailed(spark, rows)
    assert {(min(a, b), max(a, b)) for a, b, *_ in plain} == brute(rows) and all(c == 1 if not n else 0 < c < 1 for _, _, c, n in plain)
    request.getfixturevalue("small_runs")
    kinds = overlap.classes(overlap.members(records(spark, rows)))
    shared = overlap.shared_spans(overlap.suffixes(kinds, overlap.windows(kinds)))
    assert shared.filter("train_class is null").count() > 0 and shared.filter("evaluation_class is null").count() > 0
    assert detailed(spark, rows) == plain


def test_spans_of_all_partners_are_merged(spark):
    base = [float(i) for i in range(16)]
    one, two = base[:3] + [99.0] + base[4:], base[:12] + [99.0] + base[13:]
    rows = [(1, 1, "test", base), (2, 1, "train", one), (3, 1, "train", two), (4, 1, "train", two), (5, 1, "test_late", two), (6, 1, "test", [50.0] * 16)]
    whole = {r.record_id: (r.n_classes, r.coverage) for r in overlap.record_coverage(records(spark, rows)).collect()}
    pairs = {(r.train_record, r.evaluation_record): r.coverage for r in overlap.overlaps(records(spark, rows)).collect()}
    # the pairs differ in one place each, and in different stretches: together they cover everything
    assert whole[1] == (2, 1.0) and whole[5][0] == 2 and whole[5][1] == 1.0 and set(whole) == {1, 5}
    assert pairs[2, 1] < 1 and pairs[3, 1] < 1 and pairs[3, 5] == pairs[4, 5] == 1.0


def test_many_constant_features_at_a_border_do_not_explode(spark):
    rng = random.Random(6)
    rows = [(i, 1, "train" if i % 2 else "test", [0.1266] * 60 + [round(rng.gauss(0, 1), 3) for _ in range(12)]) for i in range(30)]
    rows += [(100, 1, "test", rows[1][3][:-1] + [9.0])]
    assert found(spark, rows) == brute(rows) and (1, 100) in brute(rows)


def test_the_prefix_length_decides_the_candidates(spark):
    rng = random.Random(7)
    rows = [(i, 1, "train" if i % 2 else "test", [round(rng.gauss(0, 1), 3) for _ in range(16)]) for i in range(300)]
    kinds = overlap.classes(overlap.members(records(spark, rows)))
    counts = [overlap.candidates(kinds, overlap.windows(kinds, n)).count() for n in (1, 2, 8)]
    assert counts[0] > counts[1] > counts[2]


def test_runs_go_on_across_batches(monkeypatch):
    rows = [(1, b"aab", 2, i, i % 2 == 0) for i in range(9)] + [(1, b"abb", 2, 20, True), (1, b"abc", 2, 21, False), (2, b"abc", 2, 22, False), (3, b"", 0, 30, True), (3, b"", 0, 31, False)]
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["run", "suffix", "length", "class_id", "is_train"])

    def walked(limit, size):
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        got = [t for b in overlap._walk(iter(batches), limit) for t in zip(*b.to_pydict().values(), strict=True)]
        return sorted((t[:2] + t[3:] for t in got), key=str), {t[2] for t in got}

    for limit in (100, 5):
        want = walked(limit, len(rows))
        for size in (1, 2, 3, 5, 13):
            assert walked(limit, size) == want
    pairs = walked(100, 4)[0]
    assert len(pairs) == 20 + 1 + 1 and (20, 21, 3, 2) in pairs and (30, 31, 0, 0) in pairs
    members, _ = walked(5, 4)
    assert len(members) == 9 + 1 + 1 and (0, None, 3, 2) in members and (None, 1, 3, 2) in members


def test_copies_repeats_and_defined_cases(spark):
    f = [0.1, -0.0, 2.0]
    rows = [(1, 1, "train", f), (2, 1, "test", [0.1, 0.0, 2.0]), (3, 1, "test_late", [0.12, 0.0, 2.0]), (4, 2, "test", f), (5, 1, "test", None), (6, 1, "test", []), (7, 1, "train", [])]
    rows += [(8, None, "test", f), (None, 1, "test", f), (9, 1, None, f), (10, 1, "other", f), (11, 1, "test", f + [1.0]), (12, 1, "train", f)]
    rows += [(13, 3, "train", [math.inf, 1.0, 2.0]), (14, 3, "test", [math.inf, 1.0, 2.0]), (15, 3, "test", [-math.inf, 1.0, 2.0])]
    assert found(spark, rows + rows) == {(1, 2), (1, 3), (2, 12), (3, 12), (13, 14)}
    assert found(spark, rows[:1]) == set() and found(spark, []) == set()


def test_latest_delivery_counts_and_report(spark):
    late = records(spark, [(1, 1, "train", [1.0, 2.0]), (2, 1, "test", [1.0, 2.0]), (3, 1, "test", [5.0, 5.0])])
    revised = spark.createDataFrame([(2, 1, "test", "src", [9.0, 9.0], DAY + timedelta(days=1), "x", "y", 1)], SCHEMA)
    assert overlap.found_pairs(late.unionByName(revised)).count() == 0
    report = overlap.overlap_report(late).collect()
    assert [(r.split, r.source, r.n_records, r.n_overlapping, r.n_pairs) for r in report] == [("test", "src", 2, 1, 1)]
