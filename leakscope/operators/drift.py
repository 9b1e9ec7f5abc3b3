"""Schemas that drift between files: one consistent table, and every change.

Each section of a report file has a fingerprint: the paths of its metadata and
individual blocks with their JSON types. Sections of one fingerprint are a schema
version, numbered by when it was first seen. For every version (not every section)
the migration to the reference schema is worked out once, as a chain of explicit
steps: rename, default (null), cast, drop. Sections are then routed through the
chain of their version by a join, which gives both the list of changes and the
values under the reference's paths and types. A registry of versions may be handed
over from batch to batch: versions it knows keep their number and their steps, so a
later batch changes no earlier result.

A required path that is absent was renamed if its content stands under an unlisted
path of the same block and type. Spelling alone settles most: the same letters in
another case or with other signs, or the same name elsewhere in the block. For the
rest the corpus decides. Over all versions it is counted how often the unlisted
name stands where the listed one is absent; a new name that also occurs beside the
listed one is an addition, not its new name. Alike content (ranges and digits of
numbers, forms of texts) and alike names lower what is asked of the counts, which
must be unlikely by the rate at which the listed path is absent for no reason. All
of this evidence is counted over all sections and joined to the versions that need
it; none of it is gathered in one place.

Defined results: payloads that are null or not whole give no rows; a file received
again counts as received last; sections of an unknown attack are not judged;
nulls and empty arrays have no type; a path with a null is present; objects and
nulls where only listed paths lie below are not additions themselves; repeated
rows change nothing; an empty table gives empty results; numbers of a path that are
whole throughout, and within 64 bits, stay whole in the table, others become double.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage
from leakscope.sources.report_json import attack_spelling, entries, experiments, instances, json_text, latest_files, log_id, plain, sections, unwrapped

FREE = ("metadata.target_model_params",)
#: Share of a name's sections in which the listed path must be absent, and the chance that may explain it
#: otherwise: with plain content, with content of the same form; the least rate of absence assumed.
ALWAYS, CHANCE, CHANCE_ALIKE, LEAST_RATE = 0.8, 0.02, 0.15, 0.005
#: Names are alike from this share of common words; share of a range that numbers of the same form must span; share of a
#: path's texts with a form seen once from which texts of other forms tell nothing.
ALIKE, SPAN, UNIQUE = 0.5, 0.1, 0.5


# ---------------------------------------------------------------- the fields of a section


def json_kind(value) -> str:
    """The JSON type; empty for null and for arrays without a typed element."""
    if value is None:
        return ""
    for kind, types in (("boolean", bool), ("number", (int, float)), ("string", str), ("object", dict)):
        if isinstance(value, types):
            return kind
    inner = {json_kind(v) or "array" for v in value if v is not None}
    return f"array<{inner.pop()}>" if len(inner) == 1 else "array<mixed>" if inner else ""


def _leaves(value, path: str, listed: dict) -> Iterator[tuple[str, object]]:
    """Paths down to the innermost key; a listed path is not looked into."""
    if isinstance(value, dict) and value and path not in listed:
        for key, inner in value.items():
            yield from _leaves(inner, f"{path}.{key}", listed)
    elif value is None or value == {}:
        if not any(p.startswith(path + ".") for p in listed):
            yield path, value
    else:
        yield path, value


def section_values(section: dict, listed: dict) -> tuple[dict[str, object], int]:
    """Path -> value of the judged blocks; an individual field is the array of its values. Also the number of entries."""
    values: dict[str, object] = {}
    metadata = unwrapped(section.get("metadata"))
    for key, value in (metadata if isinstance(metadata, dict) else {}).items():
        if f"metadata.{key}" not in FREE:
            values.update(_leaves(value, f"metadata.{key}", listed))
    size = 0
    columns: dict[str, list] = defaultdict(list)
    for _, logger in experiments(section):
        for _, instance in instances(logger):
            rows = entries(instance.get("individual"))
            size += len(rows)
            for row in rows:
                for key, value in row.items():
                    if isinstance(value, dict) and f"individual.{key}" not in listed:
                        for path, leaf in _leaves(value, f"individual.{key}", listed):
                            columns[path].append(leaf)
                    else:
                        columns[f"individual.{key}"].append(value)
    return values | columns, size


def _form(text: str) -> int:
    """A number for a text in which every number is reduced to one digit."""
    return int.from_bytes(hashlib.blake2b(re.sub(r"\d+", "9", text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


def _finite(value) -> float | None:
    """A number that is no flag, as a finite float."""
    try:
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else None
    except OverflowError:
        return None


def _profile(value) -> tuple[float | None, float | None, int | None, bool | None, list[int]]:
    """Least and largest finite number, most decimals, whether all are whole, and forms of texts in a value."""
    flat = value if isinstance(value, list) else [value]
    texts = sorted({_form(v) for v in flat if isinstance(v, str)})
    kinds = [v for v in flat if isinstance(v, (int, float)) and not isinstance(v, bool)]
    numbers = [n for n in map(_finite, kinds) if n is not None]
    whole = all(isinstance(v, int) and -(2**63) <= v < 2**63 for v in kinds) if kinds else None
    if not numbers:
        return None, None, None, whole, texts
    decimals = max(len(repr(n).partition(".")[2]) if not n.is_integer() else 0 for n in numbers)
    return min(numbers), max(numbers), decimals, whole, texts


_FIELD_KINDS = {
    "path": pa.string(), "kind": pa.string(), "value": pa.string(), "low": pa.float64(), "high": pa.float64(), "decimals": pa.int32(), "whole": pa.bool_(), "forms": pa.list_(pa.int64()),
}
_FIELD = "struct<path:string,kind:string,value:string,low:double,high:double,decimals:int,whole:boolean,forms:array<bigint>>"
_SECTION = f"log_id string, attack_name string, log_time string, judged_entries boolean, fingerprint string, fields array<{_FIELD}>"


@dataclass
class Reference:
    """The reference schema of each attack: path -> (JSON type, required); and attacks by folded spelling."""

    listed: dict[str, dict[str, tuple[str, bool]]]
    spellings: dict[str, str]

    @classmethod
    def read(cls, fields: DataFrame, names: DataFrame) -> Reference:
        """Both tables are collected after their size is checked."""
        rows = fields.select("attack_name", "field_path", "json_type", "is_required").dropna(subset=["attack_name", "field_path"]).distinct().limit(BROADCAST_ROWS + 1).collect()
        spelled = names.select("spelling", "attack_name").dropna().distinct().limit(BROADCAST_ROWS + 1).collect()
        if max(len(rows), len(spelled)) > BROADCAST_ROWS:
            raise ValueError(f"a reference schema of more than {BROADCAST_ROWS} rows")
        listed: dict[str, dict[str, tuple[str, bool]]] = defaultdict(dict)
        for r in sorted(rows, key=str):
            listed[r.attack_name][r.field_path] = (r.json_type, bool(r.is_required))
        return cls(dict(listed), {r.spelling.strip().lower(): r.attack_name for r in sorted(spelled, key=str)})


def judged_sections(files: DataFrame, reference: Reference) -> DataFrame:
    """One row of every section of a known attack, with its fingerprint and fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fields, ends = [], [], [0]
            for payload in batch.column(0).to_pylist():
                for key, section in sections(payload):
                    spelling = attack_spelling(key, section)
                    attack = reference.spellings.get((spelling or "").strip().lower())
                    if attack not in reference.listed:
                        continue
                    values, size = section_values(section, reference.listed[attack])
                    own = [(plain(p), json_kind(v), json_text(v), *_profile(v)) for p, v in sorted(values.items())]
                    print_of = hashlib.md5(json.dumps([size > 0, [f[:2] for f in own]]).encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((log_id(key, section), attack, plain(str(section.get("log_time"))), size > 0, print_of))
                    fields += own
                    ends.append(len(fields))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            flat = list(zip(*fields, strict=True)) or [()] * len(_FIELD_KINDS)
            # the arrays of fields are built column by column: a dictionary of each field would cost more than reading it
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, _FIELD_KINDS.values(), strict=True)], names=list(_FIELD_KINDS))
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
            arrays = [*[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(arrays, names=["log_id", "attack_name", "log_time", "judged_entries", "fingerprint", "fields"])

    return latest_files(files).select("payload").mapInArrow(run, _SECTION)


# ---------------------------------------------------------------- versions and what the corpus says of names


def schema_versions(judged: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(attack_name, fingerprint, version_no, n_sections, judged_entries, paths, kinds): the versions of every attack as first seen, after those known."""
    grouped = judged.groupBy("attack_name", "fingerprint").agg(
        F.count(F.lit(1)).alias("n_sections"),
        F.min("log_time").alias("first_seen"),
        F.first("judged_entries").alias("judged_entries"),
        F.first(F.transform("fields", lambda f: f["path"])).alias("paths"),
        F.first(F.transform("fields", lambda f: f["kind"])).alias("kinds"),
    )
    order = Window.partitionBy("attack_name").orderBy("first_seen", "fingerprint")
    if known is None:
        return grouped.withColumn("version_no", F.row_number().over(order)).drop("first_seen")
    last = known.groupBy("attack_name").agg(F.max("version_no").alias("last_no"))
    joined = grouped.join(known.select("attack_name", "fingerprint", F.col("version_no").alias("known_no")), ["attack_name", "fingerprint"], "left").join(last, "attack_name", "left")
    own = F.row_number().over(Window.partitionBy("attack_name", F.col("known_no").isNull()).orderBy("first_seen", "fingerprint"))
    number = F.coalesce(F.col("known_no"), F.coalesce("last_no", F.lit(0)) + own)
    return joined.withColumn("version_no", number).drop("first_seen", "known_no", "last_no")


@dataclass
class Evidence:
    """What the corpus says of an unlisted path in place of a listed one."""

    gone: int = 0  # sections with the unlisted name without the listed one, and all sections with both possible
    whole: int = 0
    alone: int = 0  # sections without the listed path or anything in its place, and all
    judged: int = 0
    ours: tuple[float, float, int] | None = None  # least, largest, decimals of either path
    theirs: tuple[float, float, int] | None = None
    #: Forms of texts that both have; whether either has none; share of the listed path's texts with a form seen once.
    shared: int = 0
    formless: bool = True
    unique: float = 0.0

    @property
    def rate(self) -> float:
        return max(LEAST_RATE, self.alone / self.judged if self.judged else 0.0)


def _last(path: str) -> str:
    return path.rpartition(".")[2]


def _block(path: str) -> str:
    return path.partition(".")[0]


def _sorted_out(listed: dict, paths: list[str], kinds: list[str], judged_entries: bool):
    """(absent required paths, unlisted paths with kinds) of a version."""
    present = dict(zip(paths, kinds, strict=True))
    absent = [p for p, (_, required) in listed.items() if required and p not in present and (judged_entries or _block(p) != "individual")]
    return absent, {p: k for p, k in present.items() if p not in listed and (judged_entries or _block(p) != "individual")}


_RIVAL = "attack_name string, fingerprint string, n_sections bigint, listed string, unlisted string, listed_last string, unlisted_last string, kind string, absent boolean"


def rivals(versions: DataFrame, reference: Reference) -> DataFrame:
    """Each required path of a version with each unlisted path of its block and type (null if there is none)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for v in frame.itertuples():
                listed = reference.listed[v.attack_name]
                absent, unlisted = _sorted_out(listed, list(v.paths), list(v.kinds), v.judged_entries)
                for p, (kind, required) in listed.items():
                    if required and (v.judged_entries or _block(p) != "individual"):
                        found = [u for u, k in unlisted.items() if k == kind and _block(u) == _block(p)]
                        rows += [(v.attack_name, v.fingerprint, v.n_sections, p, u, _last(p), u and _last(u), kind, p in absent) for u in found or [None]]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _RIVAL.split(", ")])

    return versions.select("attack_name", "fingerprint", "n_sections", "judged_entries", "paths", "kinds").mapInPandas(run, _RIVAL)


def rename_scores(judged: DataFrame, versions: DataFrame, reference: Reference) -> DataFrame:
    """(attack_name, fingerprint, scored): for each version the array of (score, unlisted, listed) that are possible renames."""
    found = cut_lineage(rivals(versions, reference))
    version = ["attack_name", "fingerprint"]
    names = ["unlisted_last", "listed_last"]
    both = found.filter("unlisted is not null").groupBy(*version, *names).agg(F.max("absent").alias("absent"), F.max("n_sections").alias("n"))
    together = both.groupBy(*names).agg(F.sum(F.when(F.col("absent"), F.col("n")).otherwise(0)).alias("gone"), F.sum("n").alias("whole"))
    each = found.groupBy(*version, "listed").agg((F.max("absent") & F.max("unlisted").isNull()).alias("alone"), F.max("n_sections").alias("n"))
    absent = each.groupBy("listed").agg(F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("alone"), F.sum("n").alias("judged"))
    wanted = cut_lineage(found.filter("absent and unlisted is not null").select(*version, "listed", "unlisted", *names, "kind"))
    pairs = wanted.select("listed", "unlisted").distinct()
    named = pairs.select(F.explode(F.array("listed", "unlisted")).alias("path")).distinct()
    fields = judged.select(F.explode("fields").alias("f")).select("f.path", "f.low", "f.high", "f.decimals", "f.forms").join(broadcast_if_small(named), "path", "left_semi")
    fields = cut_lineage(fields.filter("low is not null or size(forms) > 0"))
    numbers = fields.groupBy("path").agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high"), F.max("decimals").alias("decimals")).alias("numbers")).filter("numbers.low is not null")
    forms = cut_lineage(fields.select("path", F.explode("forms").alias("form")).groupBy("path", "form").agg(F.count(F.lit(1)).alias("n")))
    once = forms.groupBy("path").agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("unique"))
    shared = pairs.join(forms.select(F.col("path").alias("listed"), "form"), "listed").join(forms.select(F.col("path").alias("unlisted"), "form"), ["unlisted", "form"])
    shared = shared.groupBy("listed", "unlisted").agg(F.count(F.lit(1)).alias("shared"))
    joined = wanted.join(together, names, "left").join(absent, "listed", "left").join(shared, ["listed", "unlisted"], "left")
    for side in ("listed", "unlisted"):
        joined = joined.join(numbers.select(F.col("path").alias(side), F.col("numbers").alias(f"{side}_numbers")), side, "left")
        joined = joined.join(once.select(F.col("path").alias(side), F.col("unique").alias(f"{side}_unique")), side, "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                ours, theirs = ((n["low"], n["high"], n["decimals"]) if n is not None else None for n in (r.unlisted_numbers, r.listed_numbers))
                formless = pd.isna(r.unlisted_unique) or pd.isna(r.listed_unique)
                number = lambda x: 0 if pd.isna(x) else int(x)
                evidence = Evidence(number(r.gone), number(r.whole), number(r.alone), number(r.judged), ours, theirs, number(r.shared), formless, 0.0 if formless else r.listed_unique)
                score = rename_score(r.unlisted, r.listed, r.kind, evidence)
                if score > 0:
                    rows.append((r.attack_name, r.fingerprint, score, r.unlisted, r.listed))
            yield pd.DataFrame(rows, columns=["attack_name", "fingerprint", "score", "unlisted", "listed"])

    scored = joined.mapInPandas(run, "attack_name string, fingerprint string, score double, unlisted string, listed string")
    return scored.groupBy(*version).agg(F.collect_list(F.struct("score", "unlisted", "listed")).alias("scored"))  # pairs of one section's paths


# ---------------------------------------------------------------- the migration of a version


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def bare_name(path: str) -> str:
    """The last name of a path by its letters and digits alone; s and z count as one."""
    return re.sub(r"[\W_]+", "", _last(path)).lower().replace("z", "s")


def name_likeness(a: str, b: str) -> float:
    """Share of words that two names have in common; a word and its beginning (three letters or more) count as one."""
    ours, theirs = _words(_last(a)), _words(_last(b))
    if not ours or not theirs:
        return 0.0
    alike = lambda x, y: x == y or (min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x))) or SequenceMatcher(None, x, y).ratio() > 0.85
    return sum(any(alike(x, y) for y in theirs) for x in ours) / max(len(ours), len(theirs))


def content_likeness(kind: str, evidence: Evidence) -> int:
    """0: of another form; 1: nothing against it; 2: of the same form."""
    if kind.endswith(("number", "number>")):
        ours, theirs = evidence.ours, evidence.theirs
        if not ours or not theirs:
            return 1
        span = max(theirs[1] - theirs[0], 1e-9)
        if ours[0] < theirs[0] - span / 2 or ours[1] > theirs[1] + span / 2 or (ours[2] == 0) != (theirs[2] == 0):
            return 0
        return 2 if ours[1] - ours[0] >= SPAN * span and ours[2] == theirs[2] else 1
    if kind.endswith(("string", "string>")):
        if evidence.formless:
            return 1
        return 2 if evidence.shared else 1 if evidence.unique >= UNIQUE else 0
    return 1


def rename_score(unlisted: str, listed: str, kind: str, evidence: Evidence) -> float:
    """How well an unlisted path stands for an absent one; 0: not at all."""
    near = 0.1 * (unlisted.rpartition(".")[0] == listed.rpartition(".")[0])
    if bare_name(unlisted) == bare_name(listed):
        return 10 + near
    names, content = name_likeness(unlisted, listed), content_likeness(kind, evidence)
    share = evidence.gone / evidence.whole if evidence.whole else 0.0
    if share < ALWAYS or (content == 0 and names < ALIKE):
        return 0.0
    if names < ALIKE and evidence.rate**evidence.gone > (CHANCE_ALIKE if content == 2 else CHANCE):
        return 0.0
    return share + 2 * names + 0.2 * content + 0.3 * (1 - evidence.rate) + near


@dataclass(frozen=True)
class Step:
    """One step of a migration: change_kind is retyped (cast), renamed, removed (default) or added (dropped)."""

    change_kind: str
    field_path: str
    from_path: str | None = None


def migration(listed: dict, paths: list[str], kinds: list[str], judged_entries: bool, scored: list[tuple[float, str, str]]) -> list[Step]:
    """The chain of steps from a version to the reference schema of its attack; scored: possible renames as (score, unlisted, listed)."""
    absent, unlisted = _sorted_out(listed, paths, kinds, judged_entries)
    present = dict(zip(paths, kinds, strict=True))
    taken: dict[str, str] = {}
    for _, u, p in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
        if u not in taken.values() and p not in taken:
            taken[p] = u
    steps = [Step("renamed", p, u) for p, u in sorted(taken.items())]
    steps += [Step("removed", p) for p in absent if p not in taken]
    steps += [Step("retyped", p, p) for p, (kind, _) in listed.items() if present.get(p) and present[p] != kind]
    return steps + [Step("added", u, u) for u in sorted(unlisted) if u not in taken.values()]


@dataclass
class Drift:
    """Sections with their fields, versions, and the steps of every version; all written once."""

    judged: DataFrame
    versions: DataFrame
    steps: DataFrame
    reference: Reference
    known: DataFrame | None = None


_STEPS = "attack_name string, fingerprint string, step_no int, change_kind string, field_path string, from_path string"
_STEP_FIELDS = ("step_no", "change_kind", "field_path", "from_path")


def drift(files: DataFrame, fields: DataFrame, names: DataFrame, known: DataFrame | None = None) -> Drift:
    """Fingerprint all sections and work out the migration of every version that is not known (see `registry`)."""
    reference = Reference.read(fields, names)
    judged = cut_lineage(judged_sections(files, reference))
    versions = cut_lineage(schema_versions(judged, known))
    version = ["attack_name", "fingerprint"]
    fresh = versions if known is None else versions.join(known.select(*version), version, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for v in frame.itertuples():
                scored = [(s["score"], s["unlisted"], s["listed"]) for s in v.scored] if v.scored is not None else []
                for n, s in enumerate(migration(reference.listed[v.attack_name], list(v.paths), list(v.kinds), v.judged_entries, scored)):
                    rows.append((v.attack_name, v.fingerprint, n, s.change_kind, s.field_path, s.from_path))
            yield pd.DataFrame(rows, columns=[*version, *_STEP_FIELDS])

    scored = fresh.join(rename_scores(judged, versions, reference), version, "left")
    steps = scored.select(*version, "judged_entries", "paths", "kinds", "scored").mapInPandas(run, _STEPS)
    if known is not None:
        here = versions.select(*version)
        steps = steps.unionByName(known.join(here, version, "left_semi").select(*version, F.explode("steps").alias("s")).select(*version, *[f"s.{c}" for c in _STEP_FIELDS]))
    return Drift(judged, versions, cut_lineage(steps), reference, known)


def registry(found: Drift) -> DataFrame:
    """(attack_name, fingerprint, version_no, steps): all versions seen so far, to be stored and handed to the next batch as known."""
    version = ["attack_name", "fingerprint"]
    listed = found.steps.groupBy(*version).agg(F.array_sort(F.collect_list(F.struct(*_STEP_FIELDS))).alias("steps"))
    kind = dict(listed.dtypes)["steps"]
    out = found.versions.select(*version, "version_no").join(listed, version, "left").withColumn("steps", F.coalesce("steps", F.array().cast(kind)))
    if found.known is None:
        return out
    return found.known.select(out.columns).unionByName(out.join(found.known.select(*version), version, "left_anti"))


# ---------------------------------------------------------------- results


def changes(found: Drift) -> DataFrame:
    """(log_id, field_path, change_kind): every change of every section."""
    routed = found.judged.select("log_id", "attack_name", "fingerprint").join(broadcast_if_small(found.steps), ["attack_name", "fingerprint"])
    return routed.select("log_id", "field_path", "change_kind").distinct()


def version_report(found: Drift) -> DataFrame:
    """(attack_name, version_no, n_sections, change_kind, field_path, from_path): the migration steps of every version that has any."""
    return found.versions.select("attack_name", "fingerprint", "version_no", "n_sections").join(found.steps, ["attack_name", "fingerprint"]).drop("fingerprint", "step_no")


def _cast(value: Column, kind: str, whole: bool = False) -> Column:
    """JSON text as the type of the reference; what cannot be cast becomes null."""
    text = F.regexp_replace(value, r'^"|"$', "")
    number = lambda c: c.try_cast("bigint" if whole else "double")
    flag = lambda c: F.when(F.lower(c).isin("true", "1", "1.0"), True).when(F.lower(c).isin("false", "0", "0.0"), False)
    if kind.startswith("array"):
        items = F.when(F.substring(value, 1, 1) == "[", F.from_json(value, "array<string>")).when(value != "null", F.array(text))
        return F.transform(items, number if "number" in kind else flag)
    return number(text) if kind == "number" else flag(text) if kind == "boolean" else F.when(value != "null", text)


def column_name(path: str) -> str:
    return path.replace(".", "_")


def consistent_table(found: Drift) -> DataFrame:
    """(attack_name, log_id, version_no, one column per path of the reference): all sections under the reference's paths and types.

    Renamed content stands under its listed path, removed fields are null, retyped
    values are cast where they can be. Paths of one name in several attacks are one column.
    """
    moved = found.steps.filter("change_kind = 'renamed'").select("attack_name", "fingerprint", F.col("from_path").alias("path"), F.col("field_path").alias("listed_path"))
    values = found.judged.select("attack_name", "log_id", "fingerprint", F.explode("fields").alias("f")).select("attack_name", "log_id", "fingerprint", "f.path", "f.value", "f.whole")
    values = values.join(broadcast_if_small(moved), ["attack_name", "fingerprint", "path"], "left").withColumn("path", F.coalesce("listed_path", "path"))
    kinds: dict[str, str] = {}
    for paths in found.reference.listed.values():
        for path, (kind, _) in paths.items():
            kinds[path] = kind if kinds.get(path, kind) == kind else "string"
    # what stands under a path as numbers or as text of numbers must be whole throughout to stay so
    whole = values.filter(F.col("path").isin(*[p for p, k in kinds.items() if "number" in k])).groupBy("path").agg(F.bool_and(F.coalesce("whole", F.col("value").isin("null", "[]"))).alias("whole"))
    stays = {r.path for r in whole.filter("whole").collect()}  # paths of the reference
    chosen = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(column_name(p)) for p in kinds]
    wide = values.groupBy("attack_name", "log_id", "fingerprint").agg(*chosen)
    version = found.versions.select("attack_name", "fingerprint", "version_no")
    wide = wide.join(broadcast_if_small(version), ["attack_name", "fingerprint"])
    return wide.select("attack_name", "log_id", "version_no", *[_cast(F.col(column_name(p)), k, p in stays).alias(column_name(p)) for p, k in kinds.items()])
