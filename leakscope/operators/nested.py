"""Deeply nested JSON documents as related flat tables.

The schema is inferred over all documents and merged: every path with the kinds of
values seen there, objects and arrays distinguished from the rest. From it the
recursion is planned on the driver: the root and every array level become one
table each. Objects inside a level are flattened into columns, arrays are exploded
into the child table of that level, whose rows carry the key of their parent, their
ordinal, and chosen fields of their ancestors. Parsing and exploding are built-in
functions over the merged schema.

Defined results: documents that are null or no JSON objects give no rows; fields
that are absent are null; whole numbers within 64 bits stay whole, a field that also
holds others is double, and text (all digits kept) if it holds larger whole numbers;
fields that hold both texts and other scalars become texts; an object of more than
MAX_KEYS keys (over all documents: its keys are data) stays JSON text; where a place holds objects or arrays in some documents and other kinds in
others, it becomes text (the JSON of what was there); null and empty arrays give
no child rows; null elements of arrays give child rows of nulls; names that clash
(also by case alone) get a numbered suffix. Keys of parents are those of the root
and the ordinals below, so rows that are repeated in the input keep to themselves
only if their root keys differ.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope.session import cut_lineage

#: Keys of one object, over all documents, beyond which they are data and the object stays text; paths of a merged schema
#: beyond which it is refused (no object is that wide then: it would be a table of that many columns).
MAX_KEYS, MAX_PATHS = 2_000, 20_000
_ITEM = "\x01"
_STEP = "\x02"


@dataclass
class Node:
    """One place of the merged schema."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Node] = field(default_factory=dict)
    item: Node | None = None

    def spark_type(self) -> T.DataType:
        kinds = self.kinds - {"null"}
        if kinds == {"object"} and self.fields:
            return T.StructType([T.StructField(k, v.spark_type()) for k, v in self.fields.items()])
        if kinds == {"array"} and self.item is not None:
            return T.ArrayType(self.item.spark_type())
        if kinds == {"integer"}:
            return T.LongType()
        if kinds in ({"number"}, {"number", "integer"}):
            return T.DoubleType()
        if kinds == {"boolean"}:
            return T.BooleanType()
        return T.StringType()


def _kind(value) -> str:
    if value is None:
        return "null"
    for kind, types in (("boolean", bool), ("integer", int), ("number", float), ("string", str), ("object", dict), ("array", list)):
        if isinstance(value, types):
            return "huge" if kind == "integer" and not -(2**63) <= value < 2**63 else kind
    return "string"


def _paths(value, path: str, out: set[tuple[str, str]]) -> None:
    kind = _kind(value)
    out.add((path, kind))
    if kind == "object":
        for k, v in value.items():
            _paths(v, path + _STEP + k, out)
    elif kind == "array":
        for v in value:
            _paths(v, path + _STEP + _ITEM, out)


def merged_schema(documents: DataFrame, column: str = "document") -> Node:
    """Infer the schema of all documents; distinct paths are merged in every task before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[str, str]] = set()
        for frame in frames:
            for text in frame.iloc[:, 0]:
                try:
                    value = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    _paths(value, "", known)
        yield pd.DataFrame(sorted({(path.encode("utf-8", "backslashreplace").decode("utf-8"), kind) for path, kind in known}), columns=["path", "kind"])

    paths = cut_lineage(documents.select(column).mapInPandas(run, "path string, kind string").distinct())
    found = paths.limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:  # too many to look through here: the wide objects are sought where the paths are
        above = F.regexp_extract("path", f"^(.*){_STEP}[^{_STEP}]*$", 1)
        siblings = paths.filter(~F.col("path").endswith(_STEP + _ITEM) & (F.length("path") > 0)).select("path", above.alias("above")).distinct()
        wide = siblings.groupBy("above").count().filter(F.col("count") > MAX_KEYS).select("above").limit(MAX_PATHS + 1)
        for r in wide.collect():  # at most one of MAX_KEYS paths
            paths = paths.filter(~F.col("path").startswith(r.above + _STEP))
        found = paths.limit(MAX_PATHS + 1).collect()
    else:
        keys = Counter(p.rpartition(_STEP)[0] for p in {r.path for r in found} if p and not p.endswith(_STEP + _ITEM))
        wide = tuple(above + _STEP for above, n in keys.items() if n > MAX_KEYS)
        found = [r for r in found if not r.path.startswith(wide)] if wide else found
    if len(found) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths: keys of these documents are data, make them arrays first")
    root = Node({"object"})
    for path, kind in sorted((r.path, r.kind) for r in found):
        node = root
        for step in path.split(_STEP)[1:]:
            if step == _ITEM:
                node.item = node.item or Node()
                node = node.item
            else:
                node = node.fields.setdefault(step, Node())
        node.kinds.add(kind)
    return root


def _unique(names: list[str], taken: set[str]) -> list[str]:
    """Names made different from each other and from those taken, case ignored."""
    out, used = [], {t.lower() for t in taken}
    for name in names:
        name, n = name or "_", 1
        free = name
        while free.lower() in used:
            n += 1
            free = f"{name}_{n}"
        used.add(free.lower())
        out.append(free)
    return out


def flatten(documents: DataFrame, keys: list[str], column: str = "document", schema: Node | None = None, carry: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The tables of all documents by the path of their array level; the root's name is "".

    keys: columns that identify a document. Every table has them, row_key, and, below
    the root, parent_key and ordinal (from 0). carry: fields of a level (by its path)
    that all levels below take along. Numbers of carry become bigint.
    """
    schema = schema or merged_schema(documents, column)
    tables: dict[str, DataFrame] = {}
    carry = carry or {}
    if not isinstance(schema.spark_type(), T.StructType):
        return {"": documents.select(*keys).limit(0)}
    root_key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    level = documents.select(*keys, root_key.alias("row_key"), F.from_json(column, schema.spark_type(), {"mode": "PERMISSIVE"}).alias("node"))
    level = level.filter("node is not null")

    def open_objects(df: DataFrame, kept: list[str], node: T.StructType) -> tuple[DataFrame, dict[tuple[str, ...], str]]:
        """Expand a struct column "node" by position into columns; inner structs too. Returns the columns by path."""
        pending, places = [("node", node, ())], {}
        while pending:
            name, struct, path = pending.pop(0)
            others = [c for c in df.columns if c != name]
            new = _unique(["_".join([*path, f.name]) for f in struct.fields], {*others, *kept})
            df = df.select(*others, f"{name}.*").toDF(*others, *new)
            for f, column_name in zip(struct.fields, new, strict=True):
                if isinstance(f.dataType, T.StructType):
                    pending.append((column_name, f.dataType, (*path, f.name)))
                else:
                    places[(*path, f.name)] = column_name
        return df, places

    def explode(df: DataFrame, kept: list[str], node: T.DataType, path: str) -> None:
        if isinstance(node, T.StructType):
            df, places = open_objects(df, kept, node)
        else:
            df, places = df.withColumnRenamed("node", "value"), {("value",): "value"}
        kinds = {f.name: f.dataType for f in df.schema.fields}
        arrays = {p: c for p, c in places.items() if isinstance(kinds[c], T.ArrayType)}
        tables[path] = df.drop(*arrays.values())
        taken = {wanted: places[(wanted,)] for wanted in carry.get(path, []) if (wanted,) in places}
        below = [k for k in kept if k not in ("parent_key", "ordinal", "row_key")]
        for place, name in arrays.items():
            carried = [F.col(c).cast("bigint").alias(w) if kinds[c] != T.LongType() else F.col(c).alias(w) for w, c in taken.items()]
            child = df.select(*below, *carried, F.col("row_key").alias("parent_key"), F.posexplode(F.col(name)).alias("ordinal", "node"))
            child = child.withColumn("row_key", F.concat_ws("/", "parent_key", F.lit(".".join(place)), F.col("ordinal").cast("string")))
            explode(child, [*below, *taken, "parent_key", "ordinal", "row_key"], kinds[name].elementType, ".".join([*filter(None, [path]), *place]))

    explode(level, [*keys, "row_key"], schema.spark_type(), "")
    return tables


def report_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of the report files: reports (metadata flattened in), experiments, instances, entries, and one per array inside them."""
    from leakscope.sources.report_json import regular_sections

    documents = cut_lineage(regular_sections(files))
    tables = flatten(documents, ["file_id", "section_no", "log_id"], carry={"experiments": ["experiment_no"], "experiments.instances": ["instance_no"]})
    names = {"": "reports", "experiments": "experiments", "experiments.instances": "instances", "experiments.instances.entries": "entries"}
    return {names.get(path, path): df for path, df in tables.items()}


ENTRY_KEYS = {"log_id": "string", "experiment_no": "bigint", "instance_no": "bigint", "entry_no": "bigint"}


def report_entries(files: DataFrame) -> DataFrame:
    """(log_id, experiment_no, instance_no, entry_no): one row of every individual entry."""
    rows = report_tables(files).get("entries")
    if rows is None or "experiment_no" not in rows.columns:
        return files.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in ENTRY_KEYS.items()))
    return rows.select(*[F.col("ordinal" if k == "entry_no" else k).cast(v).alias(k) for k, v in ENTRY_KEYS.items()])
