"""Report files of every layout: regular sections, flat tables, and drift against a reference schema."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from leakscope.operators import drift, nested
from leakscope.sources import report_json

ENTRY_COLUMNS = {"p": [0.1, 0.2, 0.3], "m": [1]}


def section(log="l1", name="LiRA Attack", individual=None, main=None, **metadata):
    logger = main if main is not None else {"attack_instance_logger": {"instance_3": {"AUC": 0.5, "individual": individual}}}
    return {"log_id": log, "log_time": "01/01/2024 00:00:00", "metadata": {"attack_name": name, **metadata}, "attack_experiment_logger": logger}


def files(spark, payloads):
    day = datetime(2024, 1, 1)
    rows = [(i, f"f{i}.json", 1, day, day, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "file_id bigint, file_name string, target_id bigint, written_at timestamp, received_at timestamp, payload string")


def entries_of(spark, payloads):
    return {tuple(r) for r in nested.report_entries(files(spark, payloads)).collect()}


def test_layouts(spark):
    keyed = json.dumps({"lira_k1": {**section("k1", individual=ENTRY_COLUMNS), "dummy_attack_experiments_logger": {"dummy_attack_metrics_experiment_2": {"attack_instance_logger": [{"individual": [{"p": 1}]}, {"instance": "instance_7", "individual": [{"p": 1}]}]}}}})
    text = json.dumps(section("t1", main=json.dumps({"attack_instance_logger": [{"individual": json.dumps({"p": [1, 2]})}]})))
    assert entries_of(spark, [keyed, "﻿" + text]) == {("k1", 0, 3, 0), ("k1", 0, 3, 1), ("k1", 0, 3, 2), ("k1", 3, 0, 0), ("k1", 3, 7, 0), ("t1", 0, 0, 0), ("t1", 0, 0, 1)}


def test_broken_and_empty_payloads(spark):
    good = json.dumps(section(individual=[{"p": float("nan")}]))
    assert "NaN" in good
    payloads = [None, "", "[]", "3", '"x"', good[:-5], json.dumps(section("e", individual={})), json.dumps(section("n", individual=None)), json.dumps(section("z", main=None) | {"attack_experiment_logger": None}), good, "[" * 100_000]
    assert entries_of(spark, payloads) == {("l1", 0, 3, 0)}
    assert nested.report_entries(files(spark, []).limit(0)).count() == 0
    assert nested.report_entries(files(spark, [None])).count() == 0


def test_half_signs_and_odd_texts_do_not_break_a_file(spark):
    odd = json.dumps(section("half", params=params(note="a\ud83d\u0000b", **{"k\udc00": 1}), individual=[{"p\ud800": "\udfff", "member_prob": 0.5}]))
    assert "\\ud83d" in odd
    payloads = [odd, odd.replace("half", "h\\ud83d")]
    assert {r[1:] for r in entries_of(spark, payloads)} == {(0, 3, 0)} and len(entries_of(spark, payloads)) == 2
    found = {(r.field_path, r.change_kind) for r in drift.changes(drifted(spark, payloads)).filter("log_id = 'half'").collect()}
    assert ("metadata.params.note", "added") in found and len(found) >= 3
    assert drift.consistent_table(drifted(spark, payloads)).count() == 2 and report_json.entry_scores(files(spark, payloads)).count() == 2


def test_files_received_twice(spark):
    twice = files(spark, [json.dumps(section(individual=ENTRY_COLUMNS))])
    assert nested.report_entries(twice.unionByName(twice)).count() == 3


def test_flatten_clashes_links_and_mixed_kinds(spark):
    docs = [{"a": {"x": 1, "X": 2}, "list": [{"v": 1, "deep": [1, 2]}, {"v": "s"}, None], "mix": {"k": 1}}, {"a": {"x": "t"}, "mix": 5, "list": []}, {"other": True}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, None), (10, "[1]")], "id int, document string")
    tables = nested.flatten(df, ["id"])
    assert set(tables) == {"", "list", "list.deep"}
    root = {r.id: r.asDict() for r in tables[""].collect()}
    assert set(root) >= {0, 1, 2} and root[0]["mix"] == '{"k":1}' and root[1]["mix"] == "5" and root[2]["other"] is True
    assert {root[0]["a_X"], root[0]["a_x_2"]} == {2, "1"}
    rows = tables["list"].orderBy("ordinal").collect()
    assert [(r.parent_key, r.ordinal, r.v) for r in rows] == [("0", 0, "1"), ("0", 1, "s"), ("0", 2, None)]
    assert [(r.parent_key, r.ordinal, r.value) for r in tables["list.deep"].orderBy("ordinal").collect()] == [(rows[0].row_key, 0, 1.0), (rows[0].row_key, 1, 2.0)]


def test_numbers_keep_their_digits(spark):
    docs = [{"id": 2**53 + 1, "mixed": 2**60, "huge": 10**25 + 1, "list": [2**62 + 1]}, {"id": -1, "mixed": 0.5, "huge": 2, "list": []}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k int, document string")
    tables = nested.flatten(df, ["k"])
    first = tables[""].filter("k = 0").first()
    assert first.id == 2**53 + 1 and first.huge == str(10**25 + 1) and isinstance(first.mixed, float)
    assert [r.value for r in tables["list"].collect()] == [2**62 + 1]


def test_objects_whose_keys_are_data_stay_text(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_KEYS", 20)
    docs = [{"a": {f"k{i}": {"deep": i}}, "b": {"c": i}, "list": [{"m": {f"x{i}": 1}}]} for i in range(40)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, document string")
    tables = nested.flatten(df, ["id"])
    row = tables[""].filter("id = 7").first()
    assert json.loads(row.a) == {"k7": {"deep": 7}} and row.b_c == 7 and set(tables) == {"", "list"}
    assert json.loads(tables["list"].filter("id = 3").first().m) == {"x3": 1}
    monkeypatch.setattr(nested, "MAX_PATHS", 50)  # the 125 paths are now looked through by a plan
    again = nested.flatten(df, ["id"])
    assert {k: t.columns for k, t in again.items()} == {k: t.columns for k, t in tables.items()} and again[""].filter("id = 7").first() == row


def test_regular_sections_lose_nothing():
    odd = {"attack_instance_logger": [{"individual": None, "instance_no": "mine", "entries": 5}], "seconds": 3, "experiment_no": "x"}
    whole = report_json.regular("a_1", {"experiments": 1, "other_logger": {"z": 2}, "metadata": {}, "attack_experiment_logger": odd})
    assert whole["own_experiments"] == 1 and whole["other_logger"] == {"z": 2} and whole["log_id"] == "1"
    run = whole["experiments"][0]
    assert run["seconds"] == 3 and run["own_experiment_no"] == "x" and run["instances"] == [{"own_instance_no": "mine", "own_entries": 5, "instance_no": 0, "entries": []}]
    assert report_json.regular("a_1", {"attack_experiment_logger": "no json"})["attack_experiment_logger"] == "no json"


def test_metadata_of_sections():
    assert report_json.attack_spelling("lira_x", {"metadata": None}) == "lira" and report_json.log_id("lira_x", {}) == "x"
    assert [k for k, _ in report_json.sections(json.dumps({"gain": float("inf"), "a_1": {"log_id": "1"}, "junk": {"z": 1}}))] == ["a_1"]


REFERENCE = [
    ("LiRA Attack", "metadata.attack_name", "string", True),
    ("LiRA Attack", "metadata.params.p_thresh", "number", True),
    ("LiRA Attack", "metadata.params.out_dir", "string", True),
    ("LiRA Attack", "metadata.params.flag", "boolean", True),
    ("LiRA Attack", "metadata.params.extra", "number", False),
    ("LiRA Attack", "individual.member_prob", "array<number>", True),
]


def drifted(spark, payloads):
    fields = spark.createDataFrame(REFERENCE, "attack_name string, field_path string, json_type string, is_required boolean")
    names = spark.createDataFrame([("lira", "LiRA Attack"), ("LiRA Attack", "LiRA Attack")], "spelling string, attack_name string")
    return drift.drift(files(spark, payloads), fields, names)


def params(**changed):
    base = {"p_thresh": 0.05, "out_dir": "out/run_1", "flag": True}
    return {k: v for k, v in (base | changed).items() if v != "gone"}


def test_long_texts_and_many_forms_are_judged_whole(spark):
    """Texts that differ after 80 characters, and hundreds of forms of a path, count as they are."""
    form = lambda i: "x" * 90 + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676)
    plain = [json.dumps(section(f"p{i}", params=params(out_dir=form(i % 300)), individual=None)) for i in range(600)]
    same = [json.dumps(section(f"s{i}", params=params(out_dir="gone", dest=form(i)), individual=None)) for i in range(3)]
    unlike = [json.dumps(section(f"u{i}", params=params(out_dir="gone", note="x" * 90 + "0" * i), individual=None)) for i in range(3)]
    got = {(r.log_id, r.field_path, r.change_kind) for r in drift.changes(drifted(spark, plain + same + unlike)).collect()}
    path = "metadata.params.out_dir"
    assert {(f"s{i}", path, "renamed") for i in range(3)} <= got and {(f"u{i}", path, "removed") for i in range(3)} <= got


def test_a_registry_keeps_versions_and_steps(spark):
    first = [json.dumps(section(f"p{i}", params=params(), individual=None)) for i in range(20)] + [json.dumps(section("r", params=params(p_thresh="gone", cut=0.05), individual=None))]
    found = drifted(spark, first)
    known = drift.registry(found)
    rows = {(r.attack_name, r.fingerprint): (r.version_no, r.steps) for r in known.collect()}
    # in the second batch the new name of before stands beside the listed one, so it would be an addition
    second = [json.dumps(section(f"q{i}", params=params(cut=0.5), individual=None)) for i in range(20)] + [json.dumps(section("r2", params=params(p_thresh="gone", cut=0.05), individual=None))]
    fields = spark.createDataFrame(REFERENCE, "attack_name string, field_path string, json_type string, is_required boolean")
    names = spark.createDataFrame([("LiRA Attack", "LiRA Attack")], "spelling string, attack_name string")
    again = drift.drift(files(spark, second), fields, names, known)
    now = {(r.attack_name, r.fingerprint): (r.version_no, r.steps) for r in drift.registry(again).collect()}
    assert all(now[k] == v for k, v in rows.items()) and len(now) == len(rows) + 1
    assert sorted(v for v, _ in now.values()) == list(range(1, len(now) + 1))
    of = lambda d, log: {(r.field_path, r.change_kind) for r in drift.changes(d).filter(f"log_id = '{log}'").collect()}
    assert of(again, "r2") == of(found, "r") and of(again, "q1") == {("metadata.params.cut", "added")}


def test_whole_numbers_stay_whole(spark):
    rows = [json.dumps(section(f"w{i}", params=params(extra=2**53 + 1 + i), individual={"member_prob": [1, 0.5]})) for i in range(3)]
    table = drift.consistent_table(drifted(spark, rows))
    assert {r.metadata_params_extra for r in table.collect()} == {2**53 + 1, 2**53 + 2, 2**53 + 3}
    assert table.filter("log_id = 'w0'").first().individual_member_prob == [1.0, 0.5]


def test_every_kind_of_change(spark):
    plain = [json.dumps(section(f"p{i}", params=params(out_dir=f"out/run_{i}"), individual={"member_prob": [0.1, None]})) for i in range(60)]
    added = [json.dumps(section(f"a{i}", params=params(seconds=float(i)), individual=None)) for i in range(5)]
    odd = [
        json.dumps(section("spelt", name=" LIRA ", params=params(p_thresh="gone", pThresh=0.05), individual=[{"MemberProb": 0.5}])),
        json.dumps(section("moved", params=params(flag="gone"), flag=False, individual=[{"member_prob": 0.5}])),
        json.dumps(section("other", params=params(out_dir="gone", dest="out/run_77"), individual=[])),
        json.dumps(section("typed", params=params(p_thresh="0.05", extra=[1]), individual={"member_prob": ["0.1"]})),
        json.dumps(section("object", params=params(p_thresh={"value": 1}))),
        json.dumps(section("null", params=params(p_thresh=None, new={"deep": {"er": 1}}))),
        json.dumps(section("both", params=params(flag="gone", seconds=1.0))),
        json.dumps(section("unknown", name="Other Attack", params={})),
    ]
    found = drifted(spark, [*plain, *added, *odd, None, plain[0][:50]])
    got = {(r.log_id, r.field_path, r.change_kind) for r in drift.changes(found).collect()}
    assert got == {
        *((f"a{i}", "metadata.params.seconds", "added") for i in range(5)),
        ("spelt", "metadata.params.p_thresh", "renamed"),
        ("spelt", "individual.member_prob", "renamed"),
        ("moved", "metadata.params.flag", "renamed"),
        ("other", "metadata.params.out_dir", "renamed"),
        ("typed", "metadata.params.p_thresh", "retyped"),
        ("typed", "metadata.params.extra", "retyped"),
        ("typed", "individual.member_prob", "retyped"),
        ("object", "metadata.params.p_thresh", "retyped"),
        ("null", "metadata.params.new.deep.er", "added"),
        ("both", "metadata.params.flag", "removed"),
        ("both", "metadata.params.seconds", "added"),
    }
    rows = {r.log_id: r for r in drift.consistent_table(found).collect()}
    assert rows["spelt"].metadata_params_p_thresh == 0.05 and rows["spelt"].individual_member_prob == [0.5]
    assert rows["moved"].metadata_params_flag is False and rows["other"].metadata_params_out_dir == "out/run_77"
    assert rows["typed"].metadata_params_p_thresh == 0.05 and rows["typed"].individual_member_prob == [0.1]
    assert rows["both"].metadata_params_flag is None and "unknown" not in rows


def test_drift_of_nothing(spark):
    found = drifted(spark, [None])
    assert drift.changes(found).count() == 0 and drift.consistent_table(found).count() == 0 and drift.version_report(found).count() == 0


@pytest.mark.parametrize(("a", "b", "alike"), [("x.AUC_sig", "x.auc_significance", True), ("x.p_thresh", "x.p_threshold", True), ("x.alpha", "x.gini", False)])
def test_names(a, b, alike):
    assert (drift.name_likeness(a, b) >= drift.ALIKE) == alike
