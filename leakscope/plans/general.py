"""Queries of the general operators on report files, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators import drift, nested
from leakscope.session import table

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- the SQL of problem 5: JSON taken apart step by step


def _unwrapped(v: str) -> str:
    """A value that may be JSON text; null for nulls and broken text."""
    return f"(CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v} ->> '$', '^\\s*[\\{{\\[]') THEN try_cast({v} ->> '$' AS JSON) WHEN json_type({v}) = 'NULL' THEN NULL ELSE {v} END)"
_DIGITS = "try_cast(nullif(regexp_extract({x}, '(\\d+)$', 1), '') AS BIGINT)"
P5_ROWS = f"""
WITH files AS (SELECT * FROM report_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1),
whole AS (SELECT file_id, try_cast(ltrim(payload, chr(65279) || ' ' || chr(10) || chr(13) || chr(9)) AS JSON) AS j FROM files),
parts AS (
  SELECT file_id, NULL AS key, 0 AS id, j AS s FROM whole WHERE json_type(j) = 'OBJECT' AND (json_exists(j, '$.log_id') OR json_exists(j, '$.metadata'))
  UNION ALL
  SELECT file_id, e.key, e.id, {_unwrapped('e.value')} AS s FROM whole, json_each(j) e WHERE json_type(j) = 'OBJECT' AND NOT (json_exists(j, '$.log_id') OR json_exists(j, '$.metadata'))),
sections AS (
  SELECT row_number() OVER () AS sid, coalesce(s ->> '$.log_id', CASE WHEN contains(key, '_') THEN regexp_extract(key, '([^_]*)$', 1) ELSE key END) AS log_id, {_unwrapped("s -> '$.attack_experiment_logger'")} AS main, {_unwrapped("s -> '$.dummy_attack_experiments_logger'")} AS dummies
  FROM parts WHERE json_type(s) = 'OBJECT' AND (key IS NULL OR json_exists(s, '$.log_id') OR json_exists(s, '$.metadata') OR json_exists(s, '$.attack_experiment_logger')
    OR json_exists(s, '$.dummy_attack_experiments_logger') OR json_exists(s, '$.log_time') OR json_exists(s, '$.status'))),
experiments AS (
  SELECT sid, log_id, 0 AS experiment_no, main AS l FROM sections
  UNION ALL
  SELECT sid, log_id, coalesce({_DIGITS.format(x='e.key')}, row_number() OVER (PARTITION BY sid ORDER BY e.id) - 1) + 1, {_unwrapped('e.value')} FROM sections, json_each(dummies) e WHERE json_type(dummies) IN ('OBJECT', 'ARRAY')),
loggers AS (SELECT row_number() OVER () AS xid, log_id, experiment_no, {_unwrapped("l -> '$.attack_instance_logger'")} AS runs FROM experiments WHERE json_type(l) = 'OBJECT'),
listed AS (
  SELECT xid, log_id, experiment_no, json_type(runs) AS kind, e.key, row_number() OVER (PARTITION BY xid ORDER BY e.id) - 1 AS place, {_unwrapped('e.value')} AS v FROM loggers, json_each(runs) e WHERE json_type(runs) IN ('OBJECT', 'ARRAY')),
instances AS (
  SELECT row_number() OVER () AS iid, log_id, experiment_no, coalesce(CASE WHEN kind = 'OBJECT' THEN {_DIGITS.format(x='key')} WHEN json_type(v -> '$.instance') IN ('UBIGINT', 'BIGINT', 'VARCHAR') THEN {_DIGITS.format(x="v ->> '$.instance'")} END, place) AS instance_no,
    {_unwrapped("v -> '$.individual'")} AS block FROM listed WHERE json_type(v) = 'OBJECT'),
fields AS (SELECT iid, {_unwrapped('f.value')} AS c FROM instances, json_each(block) f WHERE json_type(block) = 'OBJECT'),
sizes AS (
  SELECT iid, max(CASE WHEN json_type(c) = 'ARRAY' THEN json_array_length(c) WHEN c IS NULL THEN 0 ELSE 1 END) AS n FROM fields GROUP BY iid
  UNION ALL SELECT iid, json_array_length(block) FROM instances WHERE json_type(block) = 'ARRAY')
"""


# ---------------------------------------------------------------- the SQL of problem 4: every field with its JSON type

_KIND = "CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN '' ELSE 'number' END"
_FIELD_ROWS = P5_ROWS.rstrip().rstrip(',')
_FIELD_ROWS = _FIELD_ROWS.replace("NULL AS key", "CAST(NULL AS VARCHAR) AS key")
_FIELD_ROWS = _FIELD_ROWS.replace("AS log_id, ", "AS log_id, key, s, ", 1)
_FIELD_ROWS = _FIELD_ROWS.replace("loggers AS (SELECT row_number() OVER () AS xid, log_id,", "loggers AS (SELECT row_number() OVER () AS xid, sid, log_id,")
_FIELD_ROWS = _FIELD_ROWS.replace("SELECT xid, log_id, experiment_no, json_type(runs)", "SELECT xid, sid, log_id, experiment_no, json_type(runs)")
_FIELD_ROWS = _FIELD_ROWS.replace("SELECT row_number() OVER () AS iid, log_id,", "SELECT row_number() OVER () AS iid, sid, log_id,")
_FIELD_ROWS = _FIELD_ROWS.replace("WITH files", "WITH RECURSIVE files", 1)
P4_ROWS = _FIELD_ROWS + f""",
metas AS (SELECT sid, log_id, key, {_unwrapped("s -> '$.metadata'")} AS m FROM sections),
named AS (
  SELECT sid, log_id, CASE WHEN json_type(m) = 'OBJECT' THEN m END AS m, a.attack_name AS attack FROM metas
  JOIN attack_names a ON lower(trim(a.spelling)) = lower(trim(CASE WHEN json_type(m) = 'OBJECT' AND json_type(m -> '$.attack_name') = 'VARCHAR' THEN m ->> '$.attack_name' WHEN contains(key, '_') THEN regexp_extract(key, '^(.*)_[^_]*$', 1) END))
  WHERE a.attack_name IN (SELECT attack_name FROM report_fields)),
paths AS (SELECT DISTINCT attack_name AS attack, field_path AS p FROM report_fields),
elements AS (
  SELECT i.sid, i.iid, f.key, x.id AS eid, x.value AS v FROM instances i, json_each(block) f, json_each(CASE WHEN json_type({_unwrapped('f.value')}) = 'ARRAY' THEN {_unwrapped('f.value')} ELSE json_array({_unwrapped('f.value')}) END) x
    WHERE json_type(block) = 'OBJECT' AND {_unwrapped('f.value')} IS NOT NULL
  UNION ALL
  SELECT i.sid, i.iid, g.key, e.id * 100000 + g.id, g.value FROM instances i, json_each(block) e, json_each({_unwrapped('e.value')}) g WHERE json_type(block) = 'ARRAY' AND json_type({_unwrapped('e.value')}) = 'OBJECT'),
walked AS (
  SELECT n.sid, n.attack, false AS own, 'metadata.' || e.key AS p, e.value AS v FROM named n, json_each(n.m) e WHERE e.key <> 'target_model_params'
  UNION ALL
  SELECT n.sid, n.attack, true, 'individual.' || e.key, coalesce(e.v, 'null'::JSON) FROM named n JOIN elements e ON e.sid = n.sid
  UNION ALL
  SELECT w.sid, w.attack, w.own, w.p || '.' || e.key, e.value FROM walked w, json_each(w.v) e WHERE json_type(w.v) = 'OBJECT' AND NOT EXISTS (SELECT 1 FROM paths q WHERE q.attack = w.attack AND q.p = w.p)),
leaves AS (
  SELECT w.* FROM walked w WHERE NOT (json_type(v) = 'OBJECT' AND v::VARCHAR <> '{{}}' AND NOT EXISTS (SELECT 1 FROM paths q WHERE q.attack = w.attack AND q.p = w.p))
    AND NOT ((json_type(v) = 'NULL' OR v::VARCHAR = '{{}}') AND (NOT own OR contains(substr(p, 12), '.') OR (v::VARCHAR = '{{}}' AND NOT EXISTS (SELECT 1 FROM paths q WHERE q.attack = w.attack AND q.p = w.p)))
      AND EXISTS (SELECT 1 FROM paths q WHERE q.attack = w.attack AND starts_with(q.p, w.p || '.')))),
inner_kinds AS (
  SELECT sid, p, own, list_sort(list(DISTINCT k) FILTER (k <> '')) AS ks FROM (
    SELECT sid, p, own, {_KIND.format(v='v')} AS k FROM leaves WHERE own
    UNION ALL SELECT l.sid, l.p, own, {_KIND.format(v='e.value')} FROM leaves l, json_each(l.v) e WHERE NOT own AND json_type(l.v) = 'ARRAY') GROUP BY ALL),
kinds AS (
  SELECT l.sid, l.p, CASE WHEN own OR json_type(any_value(l.v)) = 'ARRAY' THEN CASE coalesce(len(any_value(i.ks)), 0) WHEN 0 THEN '' WHEN 1 THEN 'array<' || any_value(i.ks)[1] || '>' ELSE 'array<mixed>' END ELSE {_KIND.format(v='any_value(l.v)')} END AS kind
  FROM leaves l LEFT JOIN inner_kinds i USING (sid, p, own) GROUP BY l.sid, l.p, own)
"""
P4_FIELDS = "SELECT n.log_id, k.p AS field_path, k.kind AS json_type FROM kinds k JOIN named n ON n.sid = k.sid"
P4_GAPS = """,
judged AS (SELECT n.sid, n.log_id, n.attack, coalesce(sum(z.n), 0) > 0 AS entries FROM named n LEFT JOIN instances i ON i.sid = n.sid LEFT JOIN sizes z ON z.iid = i.iid GROUP BY ALL),
wanted AS (SELECT DISTINCT attack_name AS attack, field_path AS p, json_type AS t, is_required AS r FROM report_fields)
SELECT DISTINCT j.log_id, w.p AS field_path, 'retyped' AS gap FROM judged j JOIN wanted w ON w.attack = j.attack JOIN kinds k ON k.sid = j.sid AND k.p = w.p WHERE k.kind <> '' AND k.kind <> w.t
UNION SELECT j.log_id, w.p, 'absent' FROM judged j JOIN wanted w ON w.attack = j.attack WHERE w.r AND (j.entries OR NOT starts_with(w.p, 'individual.')) AND NOT EXISTS (SELECT 1 FROM kinds k WHERE k.sid = j.sid AND k.p = w.p)
UNION SELECT j.log_id, k.p, 'unlisted' FROM judged j JOIN kinds k ON k.sid = j.sid WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.attack = j.attack AND w.p = k.p)
"""


def _drift(spark: SparkSession, sf_dir: str) -> drift.Drift:
    return drift.drift(*[table(spark, sf_dir, t) for t in ("report_files", "report_fields", "attack_names")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(_drift(spark, sf_dir))


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judged field of every section with its JSON type, from which the fingerprints are made."""
    fields = _drift(spark, sf_dir).judged.select("log_id", F.explode("fields").alias("f"))
    return fields.select("log_id", F.col("f.path").alias("field_path"), F.col("f.kind").alias("json_type"))


def p4_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes without the decision which absent path an unlisted one stands for: a renamed path is absent, its new name unlisted."""
    found = _drift(spark, sf_dir)
    steps = found.judged.select("log_id", "attack_name", "fingerprint").join(found.steps, ["attack_name", "fingerprint"])
    kind = F.col("change_kind")
    gap = F.when(kind == "retyped", "retyped").when(kind == "added", "unlisted").otherwise("absent")
    own = steps.select("log_id", "field_path", gap.alias("gap"))
    return own.unionByName(steps.filter(kind == "renamed").select("log_id", F.col("from_path").alias("field_path"), F.lit("unlisted").alias("gap"))).distinct()


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.version_report(_drift(spark, sf_dir))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(_drift(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.report_entries(table(spark, sf_dir, "report_files"))


def p5_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.report_tables(table(spark, sf_dir, "report_files"))["reports"]


def p5_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.report_tables(table(spark, sf_dir, "report_files"))["instances"]


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances with their numbers of entries, found through the keys that link the tables."""
    tables = nested.report_tables(table(spark, sf_dir, "report_files"))
    entries = tables["entries"].groupBy(F.col("parent_key").alias("row_key")).agg(F.count(F.lit(1)).alias("n_entries"))
    both = tables["instances"].join(entries, "row_key", "left")
    return both.select("log_id", *[F.col(c).cast("bigint").alias(c) for c in ("experiment_no", "instance_no")], F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p4_found, p4_fields, p4_gaps, p4_versions, p4_table, p5_found, p5_sizes, p5_reports, p5_instances)}


def oracle_sql() -> dict[str, str]:
    keys = "SELECT log_id, CAST(experiment_no AS BIGINT) AS experiment_no, CAST(instance_no AS BIGINT) AS instance_no, "
    return {
        "p4_fields": P4_ROWS + P4_FIELDS,
        "p4_gaps": P4_ROWS + P4_GAPS,
        "p5_found": P5_ROWS + keys + "CAST(unnest(range(CAST(n AS BIGINT))) AS BIGINT) AS entry_no FROM instances JOIN sizes USING (iid)",
        "p5_sizes": P5_ROWS + keys + "CAST(coalesce(n, 0) AS BIGINT) AS n_entries FROM instances LEFT JOIN sizes USING (iid)",
    }
