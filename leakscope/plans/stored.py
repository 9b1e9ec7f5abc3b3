"""Queries of sources and sinks: what was written to a shared folder and read back, whole tables at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators import lira, meta, metrics, shadow, significance
from leakscope.plans import frames
from leakscope.plans.audit import _WIDE_SQL, CONFUSION_SQL, EVENTS, KEY, ORDERS, RATES_SQL, RUNNING_SQL, _learnable, _matrix, m_roc_curve, m_rates, query, rounded
from leakscope.plans.general import P5_ROWS, _unwrapped
from leakscope.plans.given import _RECORDS, _records
from leakscope.session import cut_lineage, scratch, table
from leakscope.sources import bundle, report_json, report_sink

TARGET = ["target_id"]


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("is_member", (F.col("split") == "train").cast("int"))
    return rows.select("record_id", "is_member", "y", "features", "probs", "raw")


_ROUND_TRIP = f"WITH {_RECORDS} SELECT record_id, CAST(split = 'train' AS INTEGER) AS is_member, y, CAST(len(features) AS INTEGER) AS width FROM rec"


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("record_id", "is_member", "y", F.when(F.col("features").isNotNull(), F.size("features")).alias("width"))


@query(_ROUND_TRIP)
def io_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target saved with its arrays and loaded again."""
    path = f"{scratch(spark)}/target"
    bundle.save_target(_members(spark, sf_dir), path, {"name": "all"})
    return _short(bundle.load_target(spark, path)[0])


@query(_ROUND_TRIP)
def io_target_of_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target of a registered dataset: only ids and membership are saved, the rest is read from the dataset."""
    path = f"{scratch(spark)}/target"
    rows = cut_lineage(_members(spark, sf_dir))
    bundle.save_target(rows, path, {"name": "all"}, dataset="records")
    return _short(bundle.load_target(spark, path, {"records": lambda _: rows})[0])


@query("SELECT p_partkey AS record_id, p_size AS size, p_retailprice AS price FROM part WHERE p_partkey IN (SELECT ps FROM (SELECT DISTINCT l_partkey AS ps FROM lineitem))")
def io_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return bundle.subset(rows, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record_id")))


@query("SELECT CAST(p_partkey AS DOUBLE) AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part")
def io_csv_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix written as CSV without a header and scanned as arrays."""
    path = f"{scratch(spark)}/array.csv"
    table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").write.csv(path, header=False)
    return bundle.read_array(spark, path).select(*[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("id", "size", "price"))])


@query("WITH" + CONFUSION_SQL.format(**ORDERS) + RATES_SQL.format(**ORDERS) + " UNION ALL SELECT * FROM (SELECT priority || ' again', " + ", ".join(["NULL::DOUBLE"] * 10) + " FROM confused)", ("audit_orders",))
def io_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two attacks appended to one table, JSON parsed back; what is not finite comes back as null."""
    path = f"{scratch(spark)}/reports"
    rates = cut_lineage(m_rates(spark, sf_dir))
    names = [c for c in rates.columns if c != "priority"]
    report_sink.append_report(report_sink.report_rows(rates, "first", "log-1", "priority", {"seed": 1}), path)
    odd = rates.select(F.concat("priority", F.lit(" again")).alias("priority"), *[F.lit(v).alias(c) for c, v in zip(names, [float("inf"), float("nan"), float("-inf")] * 4, strict=False)])
    report_sink.append_report(report_sink.report_rows(odd, "second", "log-2", "priority"), path)
    back = report_sink.read_reports(spark, path, ["first", "second"])
    parsed = back.select(F.col("run").alias("priority"), F.from_json("instance", ", ".join(f"{c} double" for c in names)).alias("m"))
    return parsed.select("priority", *[f"m.{c}" for c in names])


@query(
    "WITH"
    + RUNNING_SQL.format(**EVENTS)
    + """,
looked AS (SELECT *, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS place FROM running WINDOW w AS (PARTITION BY instance ORDER BY s1 DESC))
SELECT 'log-1' AS log_id, instance, round(CAST(cum_n AS DOUBLE) / total_n, 6) AS fpr, round(CAST(cum_p AS DOUBLE) / total_p, 6) AS tpr, round(s1, 6) AS threshold
FROM looked WHERE place = 1 OR np IS NULL OR np <> p OR nn <> n
UNION ALL SELECT DISTINCT 'log-1', instance, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM running""",
    ("audit_events",),
)
def io_side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays of a report in a table beside it."""
    path = f"{scratch(spark)}/roc"
    report_sink.write_side_table(m_roc_curve(spark, sf_dir), path, "log-1")
    return spark.read.parquet(path).select("log_id", "instance", "fpr", "tpr", "threshold")


@query(_WIDE_SQL + "SELECT record_id, is_member, n_vulnerable FROM counted")
def io_matrix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/matrix"
    report_sink.write_csv(_matrix(spark, sf_dir).select("record_id", "is_member", "n_vulnerable"), path)
    return spark.read.csv(path, header=True, schema="record_id bigint, is_member int, n_vulnerable int")


@query("SELECT p_partkey AS record_id, p_size AS size FROM part")
def io_loader_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as arrays on the driver (refused beyond their bound) and back."""
    arrays = bundle.to_arrays(table(spark, sf_dir, "part"), ["p_partkey", "p_size"], max_rows=20_000_000)
    return bundle.from_arrays(spark, arrays).select(F.col("p_partkey").alias("record_id"), F.col("p_size").cast("int").alias("size"))


# ---------------------------------------------------------------- what reports on file say


def _number(path: str) -> str:
    own = f"CASE json_type(block) WHEN 'ARRAY' THEN {_unwrapped('(block -> e)')} -> '{path}' WHEN 'OBJECT' THEN CASE WHEN json_type({_unwrapped(f"(block -> '{path}')")}) = 'ARRAY' THEN {_unwrapped(f"(block -> '{path}')")} -> e WHEN e = 0 THEN {_unwrapped(f"(block -> '{path}')")} END END"
    value = f"CASE WHEN json_type({own}) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(({own}) ->> '$' AS DOUBLE) END"
    return f"CASE WHEN isfinite({value}) THEN {value} END"


@query(
    P5_ROWS
    + ", places AS (SELECT log_id, experiment_no, instance_no, block, unnest(range(CAST(n AS BIGINT))) AS e FROM instances JOIN sizes USING (iid))"
    + f" SELECT log_id, CAST(experiment_no AS INTEGER) AS experiment_no, CAST(instance_no AS BIGINT) AS instance_no, CAST(e AS INTEGER) AS entry_no, {_number('member')} AS member, {_number('member_prob')} AS member_prob FROM places"
)
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the individual entries of all reports say of their records."""
    return report_json.entry_scores(table(spark, sf_dir, "report_files")).select("log_id", "experiment_no", "instance_no", "entry_no", "member", "member_prob")


@query()
def meta_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vulnerability of records as stored reports have it: entries are told apart by their target and place."""
    scores = cut_lineage(report_json.entry_scores(table(spark, sf_dir, "report_files")).filter("target_id is not null"))
    names = table(spark, sf_dir, "attack_names").select(F.lower(F.trim("spelling")).alias("folded"), F.lower(F.substring_index("attack_name", " ", 1)).alias("attack")).distinct()
    named = scores.withColumn("folded", F.lower(F.trim("attack_name"))).join(F.broadcast(names), "folded")  # 15 spellings
    record = F.concat_ws("/", "target_id", "entry_no").alias("record_id")
    reps = meta.repetitions(named.select(record, "attack", F.col("member").cast("int").alias("is_member"), F.col("member_prob").alias("score")))
    structs = scores.filter("k_anonymity is not null").select(record, "k_anonymity", "class_disclosure", "smallgroup_risk")
    return meta.matrix(reps, ["lira", "qmia", "worstcase"], meta.structural_repetitions(structs))


@query()
def shadow_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shadow models of every target, kept in a store, then four: only the two that are missing are fitted."""
    path, rows = f"{scratch(spark)}/shadow", cut_lineage(_learnable(spark, sf_dir))
    compute = lambda only: shadow.tree_confidences(rows, TARGET, 4, 4, only=only)
    shadow.stored(spark, path, 2, compute)
    return shadow.stored(spark, path, 4, compute)


# ---------------------------------------------------------------- plot data


@query(
    "SELECT record_id, is_member, round(target_logit, 6) AS target_logit, round(out_mean, 6) AS out_mean, round(out_std, 6) AS out_std, round(in_mean, 6) AS in_mean, round(in_std, 6) AS in_std FROM lira_targets JOIN lira_stats USING (record_id)",
    ("shadow_events",),
)
def plot_lira_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's logit beside what the shadow models gave, for scatter plots."""
    return rounded(lira.scores(frames.lira_targets(spark, sf_dir), lira.shadow_stats(frames.shadow_events(spark, sf_dir)), "offline").select("record_id", "is_member", "target_logit", "out_mean", "out_std", "in_mean", "in_std"))


@query("WITH" + CONFUSION_SQL.format(**ORDERS) + " SELECT count(*) AS n_runs, round(min((tp + tn) / (n_pos + n_neg)), 6) AS acc_min, round(max((tp + tn) / (n_pos + n_neg)), 6) AS acc_max FROM confused", ("audit_orders",))
def report_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a text report: it is written from a small frame, and says the same."""
    rates = cut_lineage(metrics.rates(metrics.confusion(frames.audit_orders(spark, sf_dir), KEY)).withColumn("all", F.lit(1)))
    text = report_sink.text_report(rates, "Rates", ["priority", "acc"])
    if len(text.split("\n")) != 3 + rates.count():
        raise ValueError("the text report lacks rows")
    out = significance.univariate(rates, ["all"], ["acc"]).join(rates.groupBy("all").agg(F.count(F.lit(1)).alias("n_runs")), "all")
    return rounded(out.select("n_runs", "acc_min", "acc_max"))
