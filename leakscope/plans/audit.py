"""Queries of the audit operators over whole tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import exprs
from leakscope.operators import attribute, equivalence, instances, lira, meta, metrics, models, qmia, rules, sampling, shadow, significance, structural, trees, worstcase
from leakscope.plans import frames
from leakscope.session import cut_lineage, latest_rows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ["priority"]
TARGET = ["target_id"]


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query, and its twin with the frames it uses put before it."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ctes = ",\n".join(frames.SQL[u] for u in uses)
            body = sql.strip()
            own = re.sub(r"^WITH\s+", "", body)
            ORACLES[run.__name__] = body if not ctes else f"WITH {ctes},\n{own}" if own != body else f"WITH {ctes}\n{body}"
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns to a number of digits, as the twins have them."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- metrics

CONFUSION_SQL = """
confused AS (
  SELECT {key}, CAST(count(*) FILTER (s1 > s0 AND is_member = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (s1 > s0 AND is_member = 0) AS BIGINT) AS fp,
    CAST(count(*) FILTER (NOT s1 > s0 AND is_member = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT s1 > s0 AND is_member = 1) AS BIGINT) AS fn,
    CAST(count(*) FILTER (is_member = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (is_member = 0) AS BIGINT) AS n_neg, var_pop(s1) AS v
  FROM {frame} GROUP BY {key})"""
RUNNING_SQL = """
counts AS (SELECT {key}, s1, sum(is_member) AS p, sum(1 - is_member) AS n FROM {frame} GROUP BY {key}, s1),
running AS (
  SELECT *, sum(p) OVER w AS cum_p, sum(n) OVER w AS cum_n, sum(p) OVER (PARTITION BY {key}) AS total_p, sum(n) OVER (PARTITION BY {key}) AS total_n
  FROM counts WINDOW w AS (PARTITION BY {key} ORDER BY s1 DESC))"""
ORDERS = {"key": "priority", "frame": "audit_orders"}
EVENTS = {"key": "instance", "frame": "audit_events"}


@query("WITH" + CONFUSION_SQL.format(**ORDERS) + " SELECT priority, tp, fp, tn, fn, n_pos, n_neg FROM confused", ("audit_orders",))
def m_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(frames.audit_orders(spark, sf_dir), KEY).drop("pred_prob_var")


@query("WITH" + CONFUSION_SQL.format(**ORDERS) + " SELECT priority, round(v, 6) AS pred_prob_var FROM confused", ("audit_orders",))
def m_pred_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(frames.audit_orders(spark, sf_dir), KEY).select("priority", "pred_prob_var"))


RATES_SQL = """
, ratios AS (
  SELECT {key}, round_even(tp / (tp + fn), 8) AS tpr, round_even(fp / (fp + tn), 8) AS fpr, CASE WHEN fp + tp > 0 THEN round_even(fp / (fp + tp), 8) ELSE 0 END AS far,
    round_even(tn / (tn + fp), 8) AS tnr, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 8) ELSE 0 END AS ppv, CASE WHEN tn + fn > 0 THEN round_even(tn / (tn + fn), 8) ELSE 0 END AS npv,
    round_even(fn / (tp + fn), 8) AS fnr, round_even((tp + tn) / (tp + fp + tn + fn), 8) AS acc FROM confused)
SELECT {key}, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(far, 6) AS far, round(tnr, 6) AS tnr, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round(fnr, 6) AS fnr,
  round(acc, 6) AS acc, round(CASE WHEN ppv + tpr > 0 THEN round_even(2 * ppv * tpr / (ppv + tpr), 8) ELSE 0 END, 6) AS f1score, round(abs(tpr - fpr), 6) AS advantage FROM ratios"""


@query("WITH" + CONFUSION_SQL.format(**ORDERS) + RATES_SQL.format(**ORDERS), ("audit_orders",))
def m_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.rates(metrics.confusion(frames.audit_orders(spark, sf_dir), KEY))
    return rounded(out.select("priority", "tpr", "fpr", "far", "tnr", "ppv", "npv", "fnr", "acc", "f1score", "advantage"))


def _running(df: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.running_counts(cut_lineage(metrics.score_counts(df, keys)), keys)


@query("WITH" + RUNNING_SQL.format(**ORDERS) + " SELECT priority, round(sum(n * (cum_p - p / 2)) / (max(total_p) * max(total_n)), 6) AS auc FROM running GROUP BY priority", ("audit_orders",))
def m_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_running(frames.audit_orders(spark, sf_dir), KEY), KEY))


@query(
    "WITH"
    + RUNNING_SQL.format(**EVENTS)
    + """,
looked AS (SELECT *, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS place FROM running WINDOW w AS (PARTITION BY instance ORDER BY s1 DESC))
SELECT instance, round(CAST(cum_n AS DOUBLE) / total_n, 6) AS fpr, round(CAST(cum_p AS DOUBLE) / total_p, 6) AS tpr, round(s1, 6) AS threshold
FROM looked WHERE place = 1 OR np IS NULL OR np <> p OR nn <> n
UNION ALL SELECT DISTINCT instance, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM running""",
    ("audit_events",),
)
def m_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc(_running(frames.audit_events(spark, sf_dir), ["instance"]), ["instance"]))


def _tpr_sql(percent: float) -> str:
    f = percent / 100
    low_f, low_t = f"max(fpr) FILTER (fpr <= {f!r})", f"max(tpr) FILTER (fpr <= {f!r})"
    high_f, high_t = f"min(fpr) FILTER (fpr > {f!r})", f"min(tpr) FILTER (fpr > {f!r})"
    return (
        f"round(CASE WHEN {low_f} IS NULL THEN 0 WHEN {high_f} IS NULL THEN {low_t} "
        f"ELSE {low_t} + ({f!r} - {low_f}) / ({high_f} - {low_f}) * ({high_t} - {low_t}) END, 6) AS \"{metrics.tpr_name(percent)}\""
    )


@query(
    "WITH"
    + RUNNING_SQL.format(**ORDERS)
    + ", vertices AS (SELECT priority, CAST(cum_n AS DOUBLE) / total_n AS fpr, CAST(cum_p AS DOUBLE) / total_p AS tpr FROM running) SELECT priority, "
    + ", ".join(map(_tpr_sql, metrics.FPR_PERCENT))
    + " FROM vertices GROUP BY priority",
    ("audit_orders",),
)
def m_tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.tpr_at_fpr(_running(frames.audit_orders(spark, sf_dir), KEY), KEY))


def _outer_sql() -> str:
    parts = []
    for name, x in metrics.SHARES.items():
        top, low = f"avg(is_member) FILTER (down <= ceil(whole * {x!r}))", f"avg(is_member) FILTER (up <= ceil(whole * {x!r}))"
        parts += [f"round({top}, 6) AS fmax{name}", f"round({low}, 6) AS fmin{name}", f"round({top} - {low}, 6) AS fdif{name}"]
    return ", ".join(parts)


@query(
    "WITH placed AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY s1 DESC, record_id DESC) AS down,"
    " row_number() OVER (PARTITION BY priority ORDER BY s1, record_id) AS up, count(*) OVER (PARTITION BY priority) AS whole FROM audit_orders) SELECT priority, " + _outer_sql() + " FROM placed GROUP BY priority",
    ("audit_orders",),
)
def m_fmax_fmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames.audit_orders(spark, sf_dir)
    return rounded(metrics.outermost(df, _running(df, KEY), KEY))


@query(
    "WITH"
    + CONFUSION_SQL.format(**ORDERS)
    + " SELECT priority, round(0.25 / (CAST(n_pos AS DOUBLE) * n_neg) + (n_pos - 1 + n_neg - 1) * (1 / 3 - 0.25) / (CAST(n_pos AS DOUBLE) * n_neg), 9) AS null_auc_var FROM confused",
    ("audit_orders",),
)
def m_auc_null_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.confusion(frames.audit_orders(spark, sf_dir), KEY)
    return counts.select("priority", F.round(metrics.null_auc_variance(F.lit(0.5), F.col("n_pos"), F.col("n_neg")), 9).alias("null_auc_var"))


@query(
    "WITH"
    + RUNNING_SQL.format(**EVENTS)
    + ","
    + CONFUSION_SQL.format(**EVENTS)
    + """
SELECT c.instance, c.tp, c.fp, c.tn, c.fn, round(a.auc, 6) AS auc, round((c.tp + c.tn) / (c.n_pos + c.n_neg), 6) AS acc
FROM confused c JOIN (SELECT instance, sum(n * (cum_p - p / 2)) / (max(total_p) * max(total_n)) AS auc FROM running GROUP BY instance) a ON a.instance = c.instance""",
    ("audit_events",),
)
def m_summary_by_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.metrics(frames.audit_events(spark, sf_dir), ["instance"], p_values=False)
    return rounded(out.select("instance", "tp", "fp", "tn", "fn", "auc", "acc"))


def _pdif_sql() -> str:
    out = []
    for name, x in metrics.SHARES.items():
        difference = f"(avg(is_member) FILTER (down <= ceil(whole * {x!r})) - avg(is_member) FILTER (up <= ceil(whole * {x!r})))"
        out.append(f"{difference} / sqrt(2 * avg(is_member) * (1 - avg(is_member)) / ceil(max(whole) * {x!r})) AS z{name}")
    return ", ".join(out)


_PDIF = "round(CASE WHEN 1 - {cdf} < 1e-50 THEN 115.13 ELSE -ln(1 - {cdf}) END, 4) AS pdif{name}"


@query(
    "WITH placed AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY s1 DESC, record_id DESC) AS down,"
    " row_number() OVER (PARTITION BY instance ORDER BY s1, record_id) AS up, count(*) OVER (PARTITION BY instance) AS whole FROM audit_events),"
    " z AS (SELECT instance, " + _pdif_sql() + " FROM placed GROUP BY instance) SELECT instance, "
    + ", ".join(_PDIF.format(cdf=frames.normal_cdf_sql(f"z{s}"), name=s) for s in metrics.SHARES)
    + " FROM z",
    ("audit_events",),
)
def m_pdif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metrics(frames.audit_events(spark, sf_dir), ["instance"]).select("instance", "pdif01", "pdif02", "pdif001"), 4)


def _summary_sql() -> str:
    """All metrics of one run in one row, from the pieces of the other twins."""
    rated = RATES_SQL.format(**ORDERS).rsplit("\nSELECT", 1)
    final = rated[1].replace("SELECT priority, ", "").split(" FROM ratios")[0].strip().removeprefix("priority,")
    cuts = ", ".join(map(_tpr_sql, metrics.FPR_PERCENT))
    tails = ", ".join(_PDIF.format(cdf=frames.normal_cdf_sql(f"z{s}"), name=s) for s in metrics.SHARES)
    outer = ", ".join(f"f{side}{s}" for s in metrics.SHARES for side in ("max", "min", "dif"))
    return (
        "WITH" + CONFUSION_SQL.format(**ORDERS) + rated[0] + f", named AS (SELECT priority, {final} FROM ratios)," + RUNNING_SQL.format(**ORDERS)
        + ", areas AS (SELECT priority, round_even(sum(n * (cum_p - p / 2)) / (max(total_p) * max(total_n)), 8) AS auc, CAST(max(total_p) AS DOUBLE) AS np, CAST(max(total_n) AS DOUBLE) AS nn FROM running GROUP BY priority),"
        + " zs AS (SELECT priority, auc, (auc - 0.5) / sqrt((0.25 + (np - 1 + nn - 1) * (1 / 3 - 0.25)) / (np * nn)) AS z FROM areas),"
        + f" vertices AS (SELECT priority, CAST(cum_n AS DOUBLE) / total_n AS fpr, CAST(cum_p AS DOUBLE) / total_p AS tpr FROM running), reads AS (SELECT priority, {cuts} FROM vertices GROUP BY priority),"
        + " placed AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY s1 DESC, record_id DESC) AS down, row_number() OVER (PARTITION BY priority ORDER BY s1, record_id) AS up, count(*) OVER (PARTITION BY priority) AS whole FROM audit_orders),"
        + f" outermost AS (SELECT priority, {_outer_sql()} FROM placed GROUP BY priority), differences AS (SELECT priority, {_pdif_sql()} FROM placed GROUP BY priority), pdifs AS (SELECT priority, {tails} FROM differences)"
        + " SELECT c.priority, c.tp, c.fp, c.tn, c.fn, c.n_pos, c.n_neg, round(c.v, 4) AS pred_prob_var, n.* EXCLUDE (priority), round(z.auc, 6) AS auc, r.* EXCLUDE (priority), "
        + outer + ", round(1 - " + frames.normal_cdf_sql("z.z") + ", 4) AS p_higher_auc, " + ", ".join(f"pdif{s}" for s in metrics.SHARES)
        + " FROM confused c JOIN named n USING (priority) JOIN zs z USING (priority) JOIN reads r USING (priority) JOIN outermost o USING (priority) JOIN pdifs d USING (priority)"
    )


@query(_summary_sql(), ("audit_orders",))
def m_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics, normal tails included."""
    out = metrics.metrics(frames.audit_orders(spark, sf_dir), KEY)
    coarse = ["pred_prob_var", "p_higher_auc", *[f"pdif{s}" for s in metrics.SHARES]]
    return out.select(*[F.round(c, 4 if c in coarse else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "WITH"
    + RUNNING_SQL.format(**EVENTS)
    + """,
areas AS (SELECT instance, round_even(sum(n * (cum_p - p / 2)) / (max(total_p) * max(total_n)), 8) AS auc, CAST(max(total_p) AS DOUBLE) AS np, CAST(max(total_n) AS DOUBLE) AS nn FROM running GROUP BY instance),
z AS (SELECT instance, auc, (auc - 0.5) / sqrt((0.25 + (np - 1 + nn - 1) * (1 / 3 - 0.25)) / (np * nn)) AS z FROM areas)
SELECT instance, round(auc, 6) AS auc, round(1 - """
    + frames.normal_cdf_sql("z")
    + ", 6) AS p_higher_auc FROM z",
    ("audit_events",),
)
def m_auc_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metrics(frames.audit_events(spark, sf_dir), ["instance"]).select("instance", "auc", "p_higher_auc"))


MEMBER_SQL = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY ingested_at DESC) AS rn FROM member_scores) WHERE rn = 1),
member_runs AS (
  SELECT l.target_id, a.attack_name, l.record_id, l.is_member, -l.member_prob AS s0, l.member_prob AS s1
  FROM latest l JOIN attack_names a ON lower(trim(l.attack_name)) = lower(trim(a.spelling))
  WHERE l.is_member IS NOT NULL AND l.member_prob IS NOT NULL AND NOT isnan(l.member_prob))"""
_MEMBER = {"key": "target_id, attack_name", "frame": "member_runs"}


def member_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scored` of every target and attack from the score entries, latest rows only."""
    scores = latest_rows(table(spark, sf_dir, "member_scores").select("score_id", "target_id", "record_id", "is_member", "member_prob", "attack_name", "ingested_at"), "score_id")
    names = table(spark, sf_dir, "attack_names").select(F.lower(F.trim("spelling")).alias("folded"), F.col("attack_name").alias("known"))
    named = scores.withColumn("folded", F.lower(F.trim("attack_name"))).drop("attack_name").join(names, "folded").withColumnRenamed("known", "attack_name")
    return metrics.scored(named, ["target_id", "attack_name"], "record_id", F.col("is_member"), -F.col("member_prob"), F.col("member_prob"))


@query(
    "WITH" + MEMBER_SQL + "," + RUNNING_SQL.format(**_MEMBER) + " SELECT target_id, attack_name, CAST(max(total_p) AS BIGINT) AS n_pos, CAST(max(total_n) AS BIGINT) AS n_neg,"
    " round(CASE WHEN max(total_p) * max(total_n) > 0 THEN round_even(sum(n * (cum_p - p / 2)) / (max(total_p) * max(total_n)), 8) END, 6) AS auc FROM running GROUP BY target_id, attack_name"
)
def m_auc_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["target_id", "attack_name"]
    running = _running(member_runs(spark, sf_dir), keys)
    return rounded(metrics.auc(running, keys, counts=True).select(*keys, "n_pos", "n_neg", "auc"))


@query(
    "WITH"
    + RUNNING_SQL.format(**EVENTS)
    + """,
rated AS (SELECT instance, CAST(cum_n AS DOUBLE) / total_n AS fpr, CAST(cum_p AS DOUBLE) / total_p AS tpr FROM running UNION ALL SELECT DISTINCT instance, 0.0, 0.0 FROM running),
vertices AS (SELECT instance, fpr, min(tpr) AS from_tpr, max(tpr) AS tpr FROM rated GROUP BY instance, fpr),
nexts AS (SELECT *, lead(fpr) OVER w AS nf, lead(from_tpr) OVER w AS nt FROM vertices WINDOW w AS (PARTITION BY instance ORDER BY fpr)),
grid AS (SELECT range AS point FROM range(1000)),
met AS (SELECT point, CASE WHEN nf IS NULL THEN tpr ELSE tpr + (point / 999 - fpr) / (nf - fpr) * (nt - tpr) END AS y
  FROM nexts JOIN grid ON point >= ceil(round(fpr * 999, 9)) AND point < CASE WHEN nf IS NULL THEN 1000 ELSE ceil(round(nf * 999, 9)) END)
SELECT CAST(point AS BIGINT) AS point, round(point / 999, 6) AS grid_fpr, round(avg(y), 6) AS mean_tpr FROM met GROUP BY point""",
    ("audit_events",),
)
def mean_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mean_roc(_running(frames.audit_events(spark, sf_dir), ["instance"]), ["instance"], []))


# ---------------------------------------------------------------- scalar expressions

_LOGIT = "ln(greatest(1e-16, least(1 - 1e-16, {p})) / (1 - greatest(1e-16, least(1 - 1e-16, {p}))))"


@query("SELECT o_orderkey AS record_id, round(" + _LOGIT.format(p="(o_totalprice % 1000) / 1000") + ", 6) AS logit FROM orders")
def p_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), exprs.logit((F.col("o_totalprice") % 1000) / 1000).alias("logit")))


_HINGE = (
    "logits AS (SELECT *, list_transform(probs, lambda p: " + _LOGIT.format(p="p") + ") AS lg FROM emb_probs),"
    " hinged AS (SELECT *, lg[y + 1] - list_max(list_filter(lg, lambda v, i: i <> y + 1)) AS score FROM logits)"
)


@query("WITH " + _HINGE + " SELECT record_id, round(score, 5) AS score FROM hinged", ("emb_probs",))
def p_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qmia.hinge_scores(frames.emb_probs(spark, sf_dir)).select("record_id", "score"), 5)


@query("SELECT record_id, list_transform(list_reverse_sort(probs), lambda p: round(p, 6)) AS features FROM emb_probs", ("emb_probs",))
def p_sorted_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.emb_probs(spark, sf_dir).select("record_id", F.transform(exprs.sorted_probs(F.col("probs")), lambda p: F.round(p, 6)).alias("features"))


@query("SELECT record_id, round(1 - probs[y + 1], 6) AS loss, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS prediction FROM emb_probs", ("emb_probs",))
def p_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames.emb_probs(spark, sf_dir)
    return rounded(df.select("record_id", exprs.loss(F.col("probs"), F.col("y")).alias("loss"), exprs.argmax(F.col("probs")).alias("prediction")))


@query("SELECT event_id AS record_id, round(-(value - 50), 6) AS s0, round(value - 50, 6) AS s1 FROM events")
def p_margin_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s0, s1 = exprs.margin_columns(F.col("value") - 50)
    return rounded(table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), s0.alias("s0"), s1.alias("s1")))


# ---------------------------------------------------------------- equivalence classes and structure

_COARSE = "coarse AS (SELECT record_id, is_member, y, list_transform(probs, lambda p: round(p, 1)) AS probs FROM emb_probs), classed AS (SELECT *, count(*) OVER (PARTITION BY probs) AS k FROM coarse)"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.emb_probs(spark, sf_dir).withColumn("probs", F.transform("probs", lambda p: F.round(p, 1)))


@query("WITH " + _COARSE + " SELECT record_id, CAST(k AS BIGINT) AS k_anonymity FROM classed", ("emb_probs",))
def g_eq_k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.record_risks(_coarse(spark, sf_dir), "probs").select("record_id", "k_anonymity")


@query("WITH " + _COARSE + " SELECT record_id, len(list_filter(probs, lambda p: abs(p) <= 1e-8)) > 0 AS class_disclosure FROM classed", ("emb_probs",))
def g_eq_class_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.record_risks(_coarse(spark, sf_dir), "probs").select("record_id", "class_disclosure")


@query("WITH " + _COARSE + " SELECT record_id, len(list_filter(probs, lambda p: p * k > 0 AND p * k < 10)) > 0 AS smallgroup_risk FROM classed", ("emb_probs",))
def g_eq_small_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.record_risks(_coarse(spark, sf_dir), "probs").select("record_id", "smallgroup_risk")


@query(
    "WITH " + _COARSE + ", kinds AS (SELECT probs, min(k) AS k FROM classed GROUP BY probs) SELECT CAST(min(k) AS BIGINT) AS min_k, bool_or(k < 10) AS k_anonymity_risk,"
    " bool_or(len(list_filter(probs, lambda p: abs(p) <= 1e-8)) > 0) AS class_disclosure_risk, bool_or(len(list_filter(probs, lambda p: p * k > 0 AND p * k < 10)) > 0) AS smallgroup_risk,"
    " CAST(count(*) AS BIGINT) AS n_classes FROM kinds",
    ("emb_probs",),
)
def g_eq_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.global_risks(equivalence.classes(_coarse(spark, sf_dir), "probs"))


@query("SELECT CAST(min(k) AS BIGINT) AS k_anonymity FROM (SELECT count(*) AS k FROM leaf_lineitem GROUP BY q, d)", ("leaf_lineitem",))
def g_leaf_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.smallest_leaf(frames.leaf_lineitem(spark, sf_dir), ["q", "d"])


@query("SELECT CAST(min(k) AS BIGINT) AS k_anonymity FROM (SELECT count(*) AS k FROM leaf_lineitem GROUP BY q, d, t, f)", ("leaf_lineitem",))
def g_forest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.smallest_leaf(frames.leaf_lineitem(spark, sf_dir), ["q", "d", "t", "f"])


@query(
    "WITH right_ones AS (SELECT is_member, CAST(list_position(probs, list_max(probs)) - 1 = y AS INTEGER) AS ok FROM emb_probs)"
    " SELECT round(avg(ok) FILTER (is_member = 1), 6) AS train_acc, round(avg(ok) FILTER (is_member = 0), 6) AS test_acc,"
    " round(avg(ok) FILTER (is_member = 1) - avg(ok) FILTER (is_member = 0), 6) AS generalisation_gap FROM right_ones",
    ("emb_probs",),
)
def g_gen_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structural.generalisation_gap(frames.emb_probs(spark, sf_dir), exprs.argmax(F.col("probs")) == F.col("y")))


@query("SELECT CAST(count(*) - 7400 AS BIGINT) AS residual_dof, count(*) - 7400 < 10 AS dof_risk FROM orders WHERE o_orderkey % 2 = 1")
def g_dof_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.dof_risk(frames.audit_orders(spark, sf_dir).filter("is_member = 1"), F.lit(7400))


_KS_SQL = (
    "WITH counts AS (SELECT instance, s1, sum(is_member) AS p, sum(1 - is_member) AS n FROM audit_events GROUP BY instance, s1),"
    " upto AS (SELECT instance, sum(p) OVER w AS up, sum(n) OVER w AS un, sum(p) OVER (PARTITION BY instance) AS tp, sum(n) OVER (PARTITION BY instance) AS tn FROM counts WINDOW w AS (PARTITION BY instance ORDER BY s1)),"
    " stats AS (SELECT instance, max(abs(up / tp - un / tn)) AS ks_stat, CAST(max(tp) AS BIGINT) AS n_train, CAST(max(tn) AS BIGINT) AS n_test FROM upto GROUP BY instance) "
)


@query(_KS_SQL + "SELECT instance, round(ks_stat, 6) AS ks_stat, n_train, n_test FROM stats", ("audit_events",))
def g_ks_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structural.ks_statistic(frames.audit_events(spark, sf_dir), "s1", ["instance"]))


@query(
    _KS_SQL.rstrip()
    + ", scaled AS (SELECT *, sqrt(CAST(n_train AS DOUBLE) * n_test / (n_train + n_test)) * ks_stat AS t FROM stats),"
    " tails AS (SELECT *, CASE WHEN t < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * t * t))))) END AS p FROM scaled)"
    " SELECT instance, round(ks_stat, 6) AS ks_stat, n_train, n_test, round(p, 6) AS ks_p, p < 0.05 AS ks_risk FROM tails",
    ("audit_events",),
)
def ks_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structural.ks_test(frames.audit_events(spark, sf_dir), "s1", ["instance"]))


_UNSET = "CASE WHEN max_depth = 0 THEN {d} ELSE max_depth END AS max_depth"
_RISK = "SELECT model_id, coalesce({rules}, false) AS unnecessary_risk FROM filled"


def _risk_sql(model: str, filled: str) -> str:
    return f"WITH filled AS (SELECT * REPLACE ({filled}) FROM params) " + _RISK.format(rules=" OR ".join(f"({r})" for r in structural.RISKY[model]))


def _risk(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return structural.unnecessary_risk(frames.params(spark, sf_dir), model).select("model_id", "unnecessary_risk")


@query(_risk_sql("DecisionTreeClassifier", _UNSET.format(d=500)), ("params",))
def unnecessary_risk_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir, "DecisionTreeClassifier")


@query(_risk_sql("RandomForestClassifier", _UNSET.format(d=500)), ("params",))
def unnecessary_risk_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir, "RandomForestClassifier")


@query(
    _risk_sql(
        "XGBClassifier",
        _UNSET.format(d=6) + ", CASE WHEN n_estimators = 0 THEN 100 ELSE n_estimators END AS n_estimators, CASE WHEN min_child_weight = 0 THEN 1 ELSE min_child_weight END AS min_child_weight",
    ),
    ("params",),
)
def unnecessary_risk_xgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir, "XGBClassifier")


@query("SELECT p_brand AS model_id, CAST(sum(2 * p_size + (p_size + 1) * 2) AS BIGINT) AS n_params FROM part GROUP BY p_brand")
def tree_param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model_id"), (2 * F.col("p_size") + 1).alias("n_nodes"), F.lit(3).alias("n_classes"))
    return structural.ensemble_parameters(trees, ["model_id"])


# ---------------------------------------------------------------- likelihood ratio


@query("SELECT record_id, round(in_mean, 6) AS in_mean, round(in_std, 6) AS in_std, round(out_mean, 6) AS out_mean, round(out_std, 6) AS out_std FROM lira_stats", ("shadow_events",))
def lira_out_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lira.shadow_stats(frames.shadow_events(spark, sf_dir)))


@query(
    "WITH whole AS (SELECT stddev_pop(conf) FILTER (in_train) AS i, stddev_pop(conf) FILTER (NOT in_train) AS o FROM shadow_events)"
    " SELECT record_id, round(in_mean, 6) AS in_mean, round(i, 6) AS in_std, round(out_mean, 6) AS out_mean, round(o, 6) AS out_std FROM lira_stats, whole",
    ("shadow_events",),
)
def lira_fixed_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lira.shadow_stats(frames.shadow_events(spark, sf_dir), fix_variance=True))


_Z = "(target_logit - {m}) / ({s} + 1e-16)"
_DENSITY = "(-0.5 * " + _Z + " * " + _Z + " - ln({s} + 1e-16) - 0.5 * ln(2 * pi()))"
_OUT, _IN = _DENSITY.format(m="out_mean", s="out_std"), _DENSITY.format(m="in_mean", s="in_std")


def _lira(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return lira.scores(frames.lira_targets(spark, sf_dir), lira.shadow_stats(frames.shadow_events(spark, sf_dir)), mode)


@query("SELECT record_id, round(" + _Z.format(m="out_mean", s="out_std") + ", 5) AS z FROM lira_targets JOIN lira_stats USING (record_id)", ("shadow_events",))
def lira_offline_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = frames.lira_targets(spark, sf_dir).join(lira.shadow_stats(frames.shadow_events(spark, sf_dir)), "record_id")
    return rounded(both.select("record_id", lira.offline_z(F.col("target_logit"), F.col("out_mean"), F.col("out_std")).alias("z")), 5)


@query(f"SELECT record_id, round({_OUT}, 5) AS s0, round(-{_OUT}, 5) AS s1 FROM lira_targets JOIN lira_stats USING (record_id)", ("shadow_events",))
def lira_offline_carlini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lira(spark, sf_dir, "offline-carlini").select("record_id", "s0", "s1"), 5)


@query(f"SELECT record_id, round({_OUT} - {_IN}, 5) AS s0, round({_IN} - {_OUT}, 5) AS s1 FROM lira_targets JOIN lira_stats USING (record_id)", ("shadow_events",))
def lira_online_carlini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lira(spark, sf_dir, "online-carlini").select("record_id", "s0", "s1"), 5)


@query(
    "SELECT record_id, is_member, round(1 - " + frames.normal_cdf_sql(_Z.format(m="out_mean", s="out_std")) + ", 6) AS s0, round(" + frames.normal_cdf_sql(_Z.format(m="out_mean", s="out_std"))
    + ", 6) AS s1 FROM lira_targets JOIN lira_stats USING (record_id)",
    ("shadow_events",),
)
def lira_offline_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lira(spark, sf_dir, "offline").select("record_id", "is_member", "s0", "s1"))


@query()
def lira_shapiro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lira.normality(frames.shadow_events(spark, sf_dir))


# ---------------------------------------------------------------- quantile regression


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qmia.margins(qmia.hinge_scores(frames.emb_probs(spark, sf_dir)).withColumn("threshold", F.col("y") / 10 - 1))


_MARGIN_SQL = "WITH " + _HINGE + ", margined AS (SELECT *, score - (y / 10 - 1) AS margin, y / 10 - 1 AS threshold FROM hinged) "


@query(_MARGIN_SQL + "SELECT record_id, round(-margin, 5) AS s0, round(margin, 5) AS s1 FROM margined", ("emb_probs",))
def qmia_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_margins(spark, sf_dir).select("record_id", "s0", "s1"), 5)


@query(
    _MARGIN_SQL + "SELECT round(avg(CAST(margin > 0 AS INTEGER)) FILTER (is_member = 0), 6) AS observed_fpr, CAST(count(*) FILTER (is_member = 0) AS BIGINT) AS n_non_members,"
    " abs(avg(CAST(margin > 0 AS INTEGER)) FILTER (is_member = 0) - 0.01) <= 1.96 * sqrt(0.01 * 0.99 / count(*) FILTER (is_member = 0)) AS calibrated FROM margined",
    ("emb_probs",),
)
def qmia_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qmia.calibration(_margins(spark, sf_dir)))


@query(_MARGIN_SQL + "SELECT stddev_pop(threshold) < greatest(1e-10, 1e-6 * stddev_pop(score) FILTER (is_member = 0)) AS degenerate FROM margined", ("emb_probs",))
def qmia_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qmia.degenerate(_margins(spark, sf_dir))


@query()
def qmia_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qmia.margins(qmia.quantile_tree(qmia.hinge_scores(frames.emb_probs(spark, sf_dir)), alpha=0.1))


# ---------------------------------------------------------------- stored instances, meta matrix


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    k, features = F.col("p_partkey"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    stored = part.select(k.alias("stored_id"), F.when(k % 2 == 0, k).otherwise(k + 1).alias("hint"), F.transform(features, lambda x: x * (1 + 1e-9)).alias("features"))
    return stored, part.select(k.alias("record_id"), features.alias("features"))


_MATCH_SQL = """WITH s AS (SELECT p_partkey AS stored_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey + 1 END AS hint, p_size * (1 + 1e-9) AS a, p_retailprice * (1 + 1e-9) AS b FROM part),
t AS (SELECT p_partkey AS record_id, p_size AS a, p_retailprice AS b FROM part),
near AS (SELECT s.stored_id, s.hint, t.record_id FROM s JOIN t ON CAST(round(s.a) AS INTEGER) = t.a AND abs(s.a - t.a) <= 1e-8 + 1e-5 * abs(t.a) AND abs(s.b - t.b) <= 1e-8 + 1e-5 * abs(t.b)),
matched AS (SELECT stored_id, coalesce(min(record_id) FILTER (record_id = hint), min(record_id)) AS record_id FROM near GROUP BY stored_id) """


@query(_MATCH_SQL + "SELECT stored_id, record_id FROM matched")
def instance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances.match(*_stored(spark, sf_dir))


@query(
    _MATCH_SQL + "SELECT (SELECT count(*) FROM s) AS n_stored, (SELECT count(*) FROM t) AS n_train, CAST(count(DISTINCT record_id) AS BIGINT) AS n_matched,"
    " 1.0::DOUBLE AS storage_fraction, round(count(DISTINCT record_id) / (SELECT count(*) FROM s), 6) AS match_fraction FROM matched"
)
def instance_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, train = _stored(spark, sf_dir)
    return rounded(instances.fractions(stored, instances.match(stored, train), train))


def _meta_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = member_runs(spark, sf_dir)
    return runs.select("record_id", F.lower(F.substring_index("attack_name", " ", 1)).alias("attack"), "is_member", F.col("s1").alias("score"))


_ATTACKS = ("lira", "qmia", "worstcase")
_REPS_SQL = (
    "WITH"
    + MEMBER_SQL
    + """,
reps AS (
  SELECT record_id, lower(split_part(attack_name, ' ', 1)) AS attack, max(is_member) AS is_member, avg(greatest(0, least(1, s1))) AS mean, stddev_pop(greatest(0, least(1, s1))) AS std,
    avg(CAST(greatest(0, least(1, s1)) > 0.5 AS INTEGER)) AS consistency FROM member_runs GROUP BY ALL),
structured AS (
  SELECT record_id, CAST(round_even(avg(k_anonymity), 0) AS INTEGER) AS struct_k, avg(CAST(class_disclosure AS INTEGER)) > 0.5 AS struct_cd, avg(CAST(smallgroup_risk AS INTEGER)) > 0.5 AS struct_sg
  FROM (SELECT * FROM structural_records QUALIFY row_number() OVER (PARTITION BY log_id, record_id ORDER BY ingested_at DESC) = 1) GROUP BY record_id) """
)


@query(_REPS_SQL + "SELECT record_id, attack, is_member, round(mean, 9) AS mean, round(std, 9) AS std, round(consistency, 9) AS consistency, round(mean, 12) > 0.5 AS vuln FROM reps")
def meta_rep_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(meta.repetitions(_meta_scores(spark, sf_dir)), 9)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    structs = meta.structural_repetitions(table(spark, sf_dir, "structural_records"))
    return meta.matrix(meta.repetitions(_meta_scores(spark, sf_dir)), list(_ATTACKS), structs)


_WIDE_SQL = (
    _REPS_SQL.rstrip()
    + ",\nwide AS (SELECT record_id, max(is_member) AS is_member, "
    + ", ".join(f"max(mean) FILTER (attack = '{a}') AS {a}_mean, max(std) FILTER (attack = '{a}') AS {a}_std, max(consistency) FILTER (attack = '{a}') AS {a}_consistency" for a in _ATTACKS)
    + " FROM reps WHERE attack IN ('lira', 'qmia', 'worstcase') GROUP BY record_id),\n"
    + "judged AS (SELECT w.*, "
    + ", ".join(f"round({a}_mean, 12) > 0.5 AS {a}_vuln" for a in _ATTACKS)
    + ", CASE WHEN is_member = 1 THEN struct_k END AS struct_k, CASE WHEN is_member = 1 THEN struct_k < 10 OR struct_cd OR struct_sg END AS struct_vuln FROM wide w LEFT JOIN structured s ON s.record_id = w.record_id),\n"
    + "counted AS (SELECT *, "
    + " + ".join(f"CAST(coalesce({v}_vuln, false) AS INTEGER)" for v in (*_ATTACKS, "struct"))
    + " AS n_vulnerable FROM judged) "
)


@query(
    _WIDE_SQL + "SELECT record_id, round(lira_mean, 9) AS lira_mean, round(qmia_mean, 9) AS qmia_mean, round(worstcase_mean, 9) AS worstcase_mean, round((lira_mean + qmia_mean + worstcase_mean) / 3, 9) AS arith_mean,"
    " round(exp((ln(lira_mean + 1e-10) + ln(qmia_mean + 1e-10) + ln(worstcase_mean + 1e-10)) / 3), 9) AS geo_mean, struct_k, struct_vuln, n_vulnerable FROM counted"
)
def meta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_matrix(spark, sf_dir).select("record_id", "lira_mean", "qmia_mean", "worstcase_mean", "arith_mean", "geo_mean", "struct_k", "struct_vuln", "n_vulnerable"), 9)


@query(_WIDE_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(count(*) FILTER (n_vulnerable = 4) AS BIGINT) AS n_vulnerable_all, max(n_vulnerable) AS max_vulnerable FROM counted")
def meta_n_vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.vulnerable_to_all(_matrix(spark, sf_dir))


@query(_WIDE_SQL + "SELECT record_id, is_member, n_vulnerable FROM counted ORDER BY n_vulnerable DESC, (lira_mean + qmia_mean + worstcase_mean) / 3 DESC NULLS LAST, record_id LIMIT 10")
def meta_top_vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.most_vulnerable(_matrix(spark, sf_dir)).select("record_id", "is_member", "n_vulnerable")


# ---------------------------------------------------------------- significance

_P_SQL = "runs AS (SELECT event_type AS experiment, ((event_id * 7919) % 10007) / 10007 AS p, round(value / (value + 50), 6) AS auc FROM events)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("event_id") * 7919) % 10007) / 10007.0
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("experiment"), p.alias("p_higher_auc"), F.round(F.col("value") / (F.col("value") + 50), 6).alias("auc"))


_RANKED_SQL = "WITH " + _P_SQL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY p) AS r, count(*) OVER (PARTITION BY experiment) AS m FROM runs) "


def _corrected(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return significance.corrected(_runs(spark, sf_dir), ["experiment"]).select("experiment", F.col(column).cast("bigint").alias(column))


@query(_RANKED_SQL + "SELECT experiment, CAST(coalesce(max(r) FILTER (p <= r / m * 0.05), 0) AS BIGINT) AS n_step_up FROM ranked GROUP BY experiment")
def sig_bh_stepup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, "n_step_up")


@query(_RANKED_SQL + "SELECT experiment, CAST(count(*) FILTER (p <= r / m * 0.05) AS BIGINT) AS n_bh FROM ranked GROUP BY experiment")
def sig_bh_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, "n_bh")


@query(_RANKED_SQL + "SELECT experiment, CAST(count(*) FILTER (p <= 0.05 / m) AS BIGINT) AS n_bonferroni FROM ranked GROUP BY experiment")
def sig_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, "n_bonferroni")


@query("WITH " + _P_SQL + " SELECT experiment, round(min(auc), 6) AS auc_min, round(max(auc), 6) AS auc_max, round(avg(auc), 6) AS auc_mean, round(median(auc), 6) AS auc_median FROM runs GROUP BY experiment")
def sig_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.univariate(_runs(spark, sf_dir), ["experiment"], ["auc"]))


@query(
    "WITH " + _P_SQL + ", sums AS (SELECT experiment, count(*) FILTER (p < 0.05) / count(*) AS share, avg(auc) FILTER (p < 0.05) AS a FROM runs GROUP BY experiment)"
    " SELECT experiment, CASE WHEN share > 0.1 THEN 'support_rejection' ELSE 'support_release' END AS bucket,"
    " CASE WHEN share > 0.1 THEN '>10% AUC are statistically significant' ELSE '<10% AUC are statistically significant' END AS reason FROM sums"
    " UNION ALL SELECT experiment, CASE WHEN a > 0.65 THEN 'support_rejection' ELSE 'support_release' END,"
    " CASE WHEN a > 0.65 THEN 'Attack AUC > threshold of 0.65' ELSE 'Attack AUC <= threshold of 0.65' END FROM sums WHERE a IS NOT NULL"
)
def recommendation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.recommendation(_runs(spark, sf_dir))


@query(
    "WITH hits AS (SELECT is_member, CAST(list_position(probs, list_max(probs)) - 1 = y AS INTEGER) AS ok FROM emb_probs)"
    " SELECT round(avg(ok) FILTER (is_member = 1), 6) AS tpr, round(avg(ok) FILTER (is_member = 0), 6) AS fpr, round(avg(ok) FILTER (is_member = 1) - avg(ok) FILTER (is_member = 0), 6) AS advantage FROM hits",
    ("emb_probs",),
)
def yeom_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(worstcase.yeom(frames.emb_probs(spark, sf_dir)))


# ---------------------------------------------------------------- attributes, rules


@query("WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, round(max(n) / sum(n) * 100, 6) AS baseline, CAST(count(*) AS BIGINT) AS n_unique, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY p_type")
def attr_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attribute.baseline(table(spark, sf_dir, "part"), F.col("p_brand"), ["p_type"]))


@query("WITH " + _COARSE + " SELECT record_id, list_max(probs) >= 0.3 AND len(list_filter(probs, lambda p: p = list_max(probs))) = 1 AS unique_max FROM coarse", ("emb_probs",))
def attr_unique_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir).select("record_id", exprs.unique_max(F.col("probs"), 0.3).alias("unique_max"))


@query(
    "WITH v AS (SELECT c_mktsegment AS candidate, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS candidate_no FROM (SELECT DISTINCT c_mktsegment FROM customer)),"
    " size AS (SELECT count(*) AS n FROM v) SELECT c_custkey AS record_id, candidate_no, candidate, list_transform(range(n), lambda i: CASE WHEN i = candidate_no THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS one_hot"
    " FROM customer, v, size"
)
def attr_onehot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), "c_mktsegment")
    values = attribute.feature_values(customers, F.col("c_mktsegment"))
    return attribute.one_hot_candidates(customers, F.col("c_mktsegment"), values).select("record_id", "candidate_no", "candidate", "one_hot")


def _rule_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = frames.params(spark, sf_dir).select("model_id", F.when(F.col("model_id") % 2 == 0, "DecisionTreeClassifier").otherwise("RandomForestClassifier").alias("model_type"), "min_samples_leaf", "bootstrap")
    pairs = F.array(
        F.struct(F.lit("min_samples_leaf").alias("keyword"), F.col("min_samples_leaf").cast("string").alias("value"), F.lit("int").alias("value_type")),
        F.struct(F.lit("bootstrap").alias("keyword"), F.col("bootstrap").cast("string").alias("value"), F.lit("bool").alias("value_type")),
    )
    return base.select("model_id", "model_type", F.explode(pairs).alias("p")).select("model_id", "model_type", "p.*")


@query("SELECT model_id, CASE WHEN model_id % 2 = 0 THEN min_samples_leaf < 5 ELSE NOT bootstrap OR min_samples_leaf < 5 END AS disclosive FROM params", ("params",))
def rules_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check(_rule_params(spark, sf_dir), rules.shipped_rules(spark)).select("model_id", "disclosive")


@query(
    "SELECT model_id, CAST(greatest(min_samples_leaf, 5) AS VARCHAR) AS min_samples_leaf, CASE WHEN model_id % 2 = 1 OR bootstrap THEN 'true' ELSE 'false' END AS bootstrap FROM params",
    ("params",),
)
def rules_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = rules.apply_constraints(_rule_params(spark, sf_dir), rules.shipped_rules(spark))
    pick = lambda k: F.max(F.when(F.col("keyword") == k, F.col("value"))).alias(k)
    return fixed.groupBy("model_id").agg(pick("min_samples_leaf"), pick("bootstrap"))


@query("SELECT p_partkey AS model_id, 'p_size' AS path, CAST(p_size + 1 AS VARCHAR) AS current_value, CAST(p_size AS VARCHAR) AS saved_value FROM part WHERE p_partkey % 10 = 0")
def rules_tampering(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    saved = part.select(F.col("p_partkey").alias("model_id"), F.lit("p_size").alias("path"), F.col("p_size").cast("string").alias("value"))
    now = part.select(F.col("p_partkey").alias("model_id"), F.lit("p_size").alias("path"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string").alias("value"))
    return rules.differences(now, saved)


# ---------------------------------------------------------------- fitted models and sampling


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.learnable(spark, sf_dir)


@query()
def worstcase_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worstcase.report(frames.emb_probs(spark, sf_dir), n_reps=10, n_dummy_reps=10)


@query()
def shadow_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadow.tree_confidences(cut_lineage(_learnable(spark, sf_dir)), TARGET, n_models=100, max_depth=4)


@query("SELECT CAST(count(*) * 3 AS BIGINT) AS n_rows, CAST(count(*) // 2 * 3 AS BIGINT) AS n_in FROM orders")
def shadow_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    membership = sampling.shadow_membership(records, 3, records.count() // 2)
    return membership.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("in_train").alias("n_in"))


@query("SELECT is_member, CAST(sum(CAST(ceil(n * 0.2) AS BIGINT)) AS BIGINT) AS n_test FROM (SELECT o_orderkey % 2 AS is_member, count(*) AS n FROM orders GROUP BY 1), range(2) GROUP BY 1")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 2).alias("is_member"))
    return sampling.repeated_splits(records, ["is_member"], 0.2, "record_id", [10, 11]).groupBy("is_member").agg(F.count_if("in_test").alias("n_test"))


@query()
def attribute_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut_lineage(_learnable(spark, sf_dir))
    last = F.element_at("features", -1)
    known = records.filter(last.isNotNull() & ~F.isnan(last))
    grown = trees.grow(known.filter("is_member = 1"), TARGET, max_depth=4)
    return attribute.risk_totals(attribute.last_value_attack(known, grown, TARGET, 4), TARGET)


@query()
def attribute_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut_lineage(_learnable(spark, sf_dir))
    grown = trees.grow(records.filter("is_member = 1"), TARGET, max_depth=4)
    return attribute.bounds_fraction(attribute.first_value_bounds(records, grown, TARGET, 4), TARGET)


@query()
def dt_leaf_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trees.leaves(cut_lineage(_learnable(spark, sf_dir)), TARGET, max_depth=4)
    return equivalence.record_risks(placed.filter("is_member = 1"), [*TARGET, "leaf"])


@query()
def rf_leaf_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trees.forest_leaves(cut_lineage(_learnable(spark, sf_dir)), TARGET, n_trees=5, max_depth=3)
    return equivalence.smallest_leaf(placed.filter("is_member = 1"), "leaf", TARGET)


@query()
def private_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.private_svms(_learnable(spark, sf_dir), TARGET, dhat=10).select("record_id", "probs", "prediction")
