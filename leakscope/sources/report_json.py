"""Report files as regular sections, whatever the layout of their JSON.

A payload is one attack section or an object of several. Loggers and blocks may be
JSON text inside the JSON, keyed or listed; individual blocks hold entries or
columns. Here each becomes one regular form:

    {"log_id", ..., "metadata": {...}, "experiments": [{"experiment_no", "instances":
        [{"instance_no", ..., "entries": [{...}]}]}]}

Payloads that are null, cut off, not an object, or nested beyond the parser's
depth give no sections; a byte order mark is skipped; bare NaN and Infinity stay
numbers. A section without a log_id takes it from its key.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.session import latest_rows

_NUMBER = re.compile(r"(\d+)$")
_PARTS = ("metadata", "attack_experiment_logger", "dummy_attack_experiments_logger", "log_time", "status")


def plain(text: str | None) -> str | None:
    """A text that can be written as UTF-8: half signs, which JSON may escape, become their escapes."""
    return text if text is None else text.encode("utf-8", "backslashreplace").decode("utf-8")


def json_text(value) -> str:
    """JSON that can be written as UTF-8 and loses nothing."""
    text = json.dumps(value, ensure_ascii=False)
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return json.dumps(value)
    return text


def parsed(payload: str | None) -> dict | None:
    """The object of a payload, or nothing if it is not whole."""
    try:
        value = json.loads(payload.lstrip("﻿ \r\n\t")) if payload else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def unwrapped(value):
    """A value that may be JSON text of an object or list."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def sections(payload: str | None) -> Iterator[tuple[str | None, dict]]:
    """(key, section) of a payload; the key is null where the payload is itself the section."""
    whole = parsed(payload)
    if whole is None:
        return
    if "log_id" in whole or "metadata" in whole:
        yield None, whole
        return
    for key, value in whole.items():
        value = unwrapped(value)
        if isinstance(value, dict) and ("log_id" in value or any(p in value for p in _PARTS)):
            yield key, value


def log_id(key: str | None, section: dict) -> str | None:
    own = section.get("log_id")
    return plain(str(own) if own is not None else key.rpartition("_")[2] if key and "_" in key else key)


def attack_spelling(key: str | None, section: dict) -> str | None:
    """The attack as the metadata names it, else as the key does."""
    metadata = unwrapped(section.get("metadata"))
    named = metadata.get("attack_name") if isinstance(metadata, dict) else None
    return plain(named if isinstance(named, str) else key.rpartition("_")[0] if key and "_" in key else None)


def _number(name, place: int) -> int:
    if isinstance(name, int) and not isinstance(name, bool):
        return name
    found = _NUMBER.search(name) if isinstance(name, str) else None
    return int(found[1]) if found else place


def _listed(collection) -> Iterator[tuple[object, int, object]]:
    """(name, place, value) of a keyed or listed collection."""
    collection = unwrapped(collection)
    pairs = collection.items() if isinstance(collection, dict) else ((None, v) for v in collection) if isinstance(collection, list) else ()
    for place, (name, value) in enumerate(pairs):
        yield name, place, unwrapped(value)


def instances(logger) -> Iterator[tuple[int, dict]]:
    """(instance_no, instance): the N of instance_N as key or field, else the place."""
    logger = unwrapped(logger)
    if not isinstance(logger, dict):
        return
    for name, place, value in _listed(logger.get("attack_instance_logger")):
        if isinstance(value, dict):
            yield _number(name if name is not None else value.get("instance"), place), value


def experiments(section: dict) -> Iterator[tuple[int, object]]:
    """(experiment_no, logger): 0 for the attack itself, k + 1 for dummy experiment k."""
    own = unwrapped(section.get("attack_experiment_logger"))
    if isinstance(own, dict):
        yield 0, own
    for name, place, value in _listed(section.get("dummy_attack_experiments_logger")):
        if isinstance(value, dict):
            yield _number(name, place) + 1, value


def entries(block) -> list[dict]:
    """The entries of an individual block: its list, or its columns up to the longest of them."""
    block = unwrapped(block)
    if isinstance(block, list):
        return [e if isinstance(e, dict) else {} for e in map(unwrapped, block)]
    if not isinstance(block, dict):
        return []
    columns = {k: v if isinstance(v, list) else [v] for k, v in ((k, unwrapped(v)) for k, v in block.items()) if v is not None}
    size = max(map(len, columns.values()), default=0)
    return [{k: v[i] for k, v in columns.items() if i < len(v)} for i in range(size)]


def _with_own(fields: dict, made: dict) -> dict:
    """Fields beside those made here; a field of the same name goes on as own_<name>."""
    return {f"own_{k}" if k in made else k: v for k, v in fields.items()} | made


def regular(key: str | None, section: dict) -> dict:
    """The regular form of a section; whatever it holds besides goes along at its place."""
    metadata = unwrapped(section.get("metadata"))
    runs = []
    for number, logger in experiments(section):
        found = []
        for instance_no, instance in instances(logger):
            plain = {k: v for k, v in instance.items() if k != "individual"}
            found.append(_with_own(plain, {"instance_no": instance_no, "entries": entries(instance.get("individual"))}))
        runs.append(_with_own({k: v for k, v in logger.items() if k != "attack_instance_logger"}, {"experiment_no": number, "instances": found}))
    opened = {"metadata", "log_id", "dummy_attack_experiments_logger"}
    if isinstance(unwrapped(section.get("attack_experiment_logger")), dict) or section.get("attack_experiment_logger") is None:
        opened.add("attack_experiment_logger")
    made = {"log_id": log_id(key, section), "metadata": metadata if isinstance(metadata, dict) else None, "experiments": runs}
    return _with_own({k: v for k, v in section.items() if k not in opened}, made)


def latest_files(files: DataFrame) -> DataFrame:
    """(file_id, file_name, target_id, payload) of each file as received last."""
    return latest_rows(files.filter("file_id is not null"), "file_id", "received_at", ["received_at", "file_name", "target_id", "payload"]).drop("received_at")


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file_name, target_id, payload, written_at, received_at) of the report files below a folder, one row of each; target_id is null."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name, changed = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
    return rows.select(F.xxhash64(name).alias("file_id"), F.col("_metadata.file_name").alias("file_name"), F.lit(None).cast("bigint").alias("target_id"), F.col("value").alias("payload"), changed.alias("written_at"), changed.alias("received_at"))


_SCORE = "log_id string, target_id bigint, attack_name string, experiment_no int, instance_no bigint, entry_no int, member double, member_prob double, k_anonymity double, class_disclosure boolean, smallgroup_risk boolean"


def entry_scores(files: DataFrame) -> DataFrame:
    """(log_id, target_id, attack_name, experiment_no, instance_no, entry_no, member, member_prob, k_anonymity, class_disclosure, smallgroup_risk): what the individual
    entries of reports say of their records; fields that are absent or of another kind are null."""
    number = lambda v: float(v) if isinstance(v, (int, float)) and math.isfinite(v) else None
    flag = lambda v: v if isinstance(v, bool) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for target, payload in zip(frame.target_id, frame.payload, strict=True):
                for key, section in sections(payload):
                    for experiment_no, logger in experiments(section):
                        for instance_no, instance in instances(logger):
                            for n, e in enumerate(entries(instance.get("individual"))):
                                own = (number(e.get("member")), number(e.get("member_prob")), number(e.get("k_anonymity")), flag(e.get("class_disclosure")), flag(e.get("smallgroup_risk")))
                                rows.append((log_id(key, section), target, attack_spelling(key, section), experiment_no, instance_no, n, *own))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in _SCORE.split(", ")])
            out["target_id"] = out["target_id"].astype("Int64")
            yield out

    return latest_files(files).select("target_id", "payload").mapInPandas(run, _SCORE)


def regular_sections(files: DataFrame) -> DataFrame:
    """(file_id, file_name, target_id, section_no, log_id, attack_spelling, document): the regular JSON of every section of every file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, name, target, payload in zip(frame.file_id, frame.file_name, frame.target_id, frame.payload, strict=True):
                for n, (key, section) in enumerate(sections(payload)):
                    rows.append((file_id, name, target, n, log_id(key, section), attack_spelling(key, section), json_text(regular(key, section))))
            out = pd.DataFrame(rows, columns=["file_id", "file_name", "target_id", "section_no", "log_id", "attack_spelling", "document"])
            out["target_id"] = out["target_id"].astype("Int64")
            yield out

    schema = "file_id bigint, file_name string, target_id bigint, section_no int, log_id string, attack_spelling string, document string"
    return latest_files(files).mapInPandas(run, schema)
