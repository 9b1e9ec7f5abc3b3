"""Audit frames derived from the relational tables by arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import stats
from leakscope.functions.exprs import softmax
from leakscope.operators import metrics
from leakscope.session import latest_rows, table

#: The same frames as common table expressions.
SQL = {
    "audit_orders": """audit_orders AS (
  SELECT o_orderpriority AS priority, o_orderkey AS record_id, CAST(o_orderkey % 2 AS INTEGER) AS is_member,
    1 - round((o_totalprice % 1000) / 1000, 6) AS s0, round((o_totalprice % 1000) / 1000, 6) AS s1 FROM orders)""",
    "audit_events": """audit_events AS (
  SELECT event_type AS instance, event_id AS record_id, CAST(event_id % 3 = 0 AS INTEGER) AS is_member,
    1 - round(value / (value + 50), 6) AS s0, round(value / (value + 50), 6) AS s1 FROM events)""",
    "emb_probs": """emb_raw AS (
  SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
emb_exp AS (SELECT vec_id, label, list_transform(e, lambda x: exp(x - list_max(e))) AS ex FROM emb_raw),
emb_probs AS (
  SELECT vec_id AS record_id, CAST(vec_id % 2 AS INTEGER) AS is_member, label AS y, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM emb_exp)""",
    "leaf_lineitem": """leaf_lineitem AS (
  SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t, l_returnflag AS f FROM lineitem)""",
    "shadow_events": """shadow_events AS (
  SELECT user_id AS record_id, CAST(event_id % 20 AS INTEGER) AS model_idx, (event_id // 20) % 2 = 1 AS in_train, ln((value + 1) / 50) AS conf FROM events),
lira_targets AS (
  SELECT user_id AS record_id, CAST(user_id % 2 AS INTEGER) AS is_member, ln((max(value) + 1) / 50) AS target_logit FROM events GROUP BY user_id),
lira_stats AS (
  SELECT record_id, coalesce(avg(conf) FILTER (in_train), 0) AS in_mean, coalesce(stddev_pop(conf) FILTER (in_train), 0) AS in_std,
    coalesce(avg(conf) FILTER (NOT in_train), 0) AS out_mean, coalesce(stddev_pop(conf) FILTER (NOT in_train), 0) AS out_std
  FROM shadow_events GROUP BY record_id)""",
    "params": """params AS (
  SELECT p_partkey AS model_id, p_size % 13 AS max_depth, CASE WHEN p_partkey % 3 = 0 THEN 'sqrt' END AS max_features, p_size % 21 AS min_samples_leaf,
    p_size % 31 AS min_samples_split, CASE WHEN p_partkey % 2 = 0 THEN 'best' ELSE 'random' END AS splitter,
    CAST(p_partkey % 97 AS INTEGER) AS n_estimators, p_partkey % 5 < 3 AS bootstrap, p_size % 8 AS min_child_weight FROM part)""",
}


def normal_cdf_sql(z: str) -> str:
    """The normal distribution function as SQL, by the same approximations."""

    def horner(coefficients: list[float], x: str) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out.replace(f"{coefficients[0]!r} *", f"CAST({coefficients[0]!r} AS DOUBLE) *", 1)

    x = f"(-({z}) / {2**0.5!r})"
    y = f"abs({x})"
    inverse, grid = f"(1 / ({y} * {y}))", f"(floor({y} * 16) / 16)"
    decay = f"(exp(-{grid} * {grid}) * exp(-({y} - {grid}) * ({y} + {grid})))"
    middle = f"{decay} * {horner(stats.MIDDLE[0], y)} / {horner(stats.MIDDLE[1], y)}"
    tail = f"{decay} * ({stats.ROOT_PI!r} - {inverse} * {horner(stats.TAIL[0], inverse)} / {horner(stats.TAIL[1], inverse)}) / {y}"
    near = f"1 - {x} * {horner(stats.NEAR[0], f'({x} * {x})')} / {horner(stats.NEAR[1], f'({x} * {x})')}"
    outer = f"(CASE WHEN {y} <= {stats.MIDDLE_END} THEN {middle} ELSE {tail} END)"
    return f"(0.5 * CASE WHEN {y} <= {stats.NEAR_END} THEN {near} WHEN {x} < 0 THEN 2 - {outer} ELSE {outer} END)"


def audit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = F.round((F.col("o_totalprice") % 1000) / 1000, 6)
    return metrics.scored(table(spark, sf_dir, "orders").withColumn("priority", F.col("o_orderpriority")), ["priority"], "o_orderkey", F.col("o_orderkey") % 2, 1 - s1, s1)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = F.round(F.col("value") / (F.col("value") + 50), 6)
    return metrics.scored(table(spark, sf_dir, "events").withColumn("instance", F.col("event_type")), ["instance"], "event_id", F.col("event_id") % 3 == 0, 1 - s1, s1)


def emb_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, is_member, y, features, probs); probs are the softmax of the first ten dimensions."""
    rows = table(spark, sf_dir, "embeddings").withColumn("features", F.transform("embedding", lambda x: x.cast("double")))
    return rows.select(
        F.col("vec_id").alias("record_id"), (F.col("vec_id") % 2).cast("int").alias("is_member"), F.col("label").alias("y"), "features", softmax(F.slice("features", 1, 10)).alias("probs")
    )


def leaf_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.floor(F.col("l_quantity") / 10).alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("t"), F.col("l_returnflag").alias("f")
    )


def shadow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    in_train = F.floor(F.col("event_id") / 20) % 2 == 1
    return rows.select(F.col("user_id").alias("record_id"), (F.col("event_id") % 20).cast("int").alias("model_idx"), in_train.alias("in_train"), F.log((F.col("value") + 1) / 50).alias("conf"))


def lira_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record_id")).agg(F.max("value").alias("v"))
    return rows.select("record_id", (F.col("record_id") % 2).cast("int").alias("is_member"), F.log((F.col("v") + 1) / 50).alias("target_logit"))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("model_id"),
        (s % 13).alias("max_depth"),
        F.when(k % 3 == 0, "sqrt").alias("max_features"),
        (s % 21).alias("min_samples_leaf"),
        (s % 31).alias("min_samples_split"),
        F.when(k % 2 == 0, "best").otherwise("random").alias("splitter"),
        (k % 97).cast("int").alias("n_estimators"),
        (k % 5 < 3).alias("bootstrap"),
        (s % 8).alias("min_child_weight"),
    )


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, target_id, is_member, y, features) of the records of all targets to fit models on: the latest row of every record, missing values as they are."""
    rows = latest_rows(table(spark, sf_dir, "records").select("record_id", "target_id", "split", "y", "features", "ingested_at"), "record_id")
    rows = rows.filter("record_id is not null and target_id is not null and features is not null and y is not null")
    return rows.select("record_id", "target_id", (F.col("split") == "train").cast("int").alias("is_member"), "y", "features")
