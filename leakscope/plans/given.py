"""Queries of operators that usually follow a fitted model, over models given as arithmetic, so that SQL can repeat them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import exprs
from leakscope.operators import attribute, equivalence, instances, meta, metrics, models, qmia, rules, sampling, significance, structural, trees, worstcase
from leakscope.plans import frames
from leakscope.plans.audit import EVENTS, MEMBER_SQL, RUNNING_SQL, _WIDE_SQL, _coarse, _matrix, _running, member_runs, query, rounded
from leakscope.session import cut_lineage, latest_rows, table
from leakscope.sources import bundle

# ---------------------------------------------------------------- records, labels, expressions

_RECORDS = "rec AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) = 1)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "records"), "record_id")


@query(f"WITH {_RECORDS} SELECT record_id, CAST(split = 'train' AS INTEGER) AS is_member FROM rec")
def p_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(_records(spark, sf_dir).select("record_id", "split"))
    return bundle.combine(rows.filter("split = 'train'"), rows.filter("split <> 'train'")).select("record_id", "is_member")


@query("SELECT c_custkey AS record_id, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'MACHINERY' THEN 2 END AS INTEGER) AS y FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')")
def p_class_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("y"))
    return models.remap_classes(rows, ["BUILDING", "FURNITURE", "MACHINERY"])


@query(
    "SELECT p_partkey AS feature_id, e AS encoding, left(e, 3) IN ('str', 'int') OR left(e, 6) = 'onehot' AS categorical FROM ("
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'str' WHEN 1 THEN 'int64' WHEN 2 THEN 'onehot' WHEN 3 THEN 'float' ELSE 'double' END AS e FROM part)"
)
def p_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.element_at(F.array(*map(F.lit, ("str", "int64", "onehot", "float", "double"))), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), e.alias("encoding"), exprs.is_categorical(e).alias("categorical"))


@query("SELECT p_partkey AS record_id, list_transform(range(100), lambda i: round(CASE WHEN i = 99 THEN p_retailprice ELSE p_size + i * (p_retailprice - p_size) / 99.0::DOUBLE END, 5)) AS points FROM part")
def p_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = exprs.linspace(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.transform(points, lambda x: F.round(x, 5)).alias("points"))


_RHO = [[math.sin(3 * i + j) for j in range(10)] for i in range(4)]


def _fourier_sql() -> str:
    dots = [" + ".join(f"e[{j + 1}] * {v!r}" for j, v in enumerate(row)) for row in _RHO]
    return ", ".join(f"round(0.5 * {f}({d}), 6)" for f in ("cos", "sin") for d in dots)


@query(f"SELECT vec_id AS record_id, [{_fourier_sql()}] AS mapped FROM emb_raw", ("emb_probs",))
def p_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.emb_probs(spark, sf_dir).select("record_id", F.slice("features", 1, 10).alias("features"))
    mapped = models.fourier_features(rows, len(_RHO), 0.1, rho=_RHO)
    return mapped.select("record_id", F.transform("vec_rff", lambda x: F.round(x, 6)).alias("mapped"))


@query("SELECT p_brand AS model_id, CAST(sum(p_size * (p_partkey % 7 + 1) + p_partkey % 7 + 1) AS BIGINT) AS n_params FROM part GROUP BY p_brand")
def layer_param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model_id"), F.col("p_size").alias("n_in"), (F.col("p_partkey") % 7 + 1).alias("n_out"))
    return structural.layer_parameters(layers, ["model_id"])


@query(f"WITH {_RECORDS} SELECT record_id, round(ln(greatest(1e-16, coalesce(probs[y + 1], 0)) / (1 - greatest(1e-16, least(1 - 1e-16, coalesce(probs[y + 1], 0))))), 5) AS conf FROM rec WHERE y IS NOT NULL")
def p_label_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logit of a record's own class; a class without a probability has probability 0."""
    rows = _records(spark, sf_dir).filter("y is not null")
    return rounded(rows.select("record_id", exprs.logit(F.coalesce(exprs.class_prob(F.col("probs"), F.col("y")), F.lit(0.0))).alias("conf")), 5)


# ---------------------------------------------------------------- samples and noise, in an order that SQL can compute

_UNIT = "((({id} * 48271 + {seed} * 104729) % 2147483647) / 2147483647.0::DOUBLE)"


def _unit(record: str, seed: Column) -> Column:
    return ((F.col(record) * 48271 + seed * 104729) % 2147483647) / F.lit(2147483647.0)


@query(
    "WITH sized AS (SELECT count(*) // 2 AS n FROM orders), ranked AS (SELECT m.range AS model_idx, o_orderkey AS record_id,"
    " row_number() OVER (PARTITION BY m.range ORDER BY " + _UNIT.format(id="o_orderkey", seed="m.range") + ", o_orderkey) AS place FROM orders, range(5) m)"
    " SELECT CAST(model_idx AS INTEGER) AS model_idx, record_id, place <= n AS in_train FROM ranked, sized"
)
def shadow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    return sampling.shadow_membership(records, 5, records.count() // 2, unit=_unit("record_id", F.col("model_idx")))


@query(
    "WITH ranked AS (SELECT o_orderkey AS record_id, r.range AS rep, row_number() OVER (PARTITION BY r.range, o_orderkey % 2 ORDER BY " + _UNIT.format(id="o_orderkey", seed="(r.range + 10)") + ", o_orderkey) AS place,"
    " count(*) OVER (PARTITION BY r.range, o_orderkey % 2) AS n FROM orders, range(3) r) SELECT record_id, CAST(rep AS INTEGER) AS rep, place <= ceil(n * 0.2) AS in_test FROM ranked"
)
def stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 2).alias("is_member"))
    splits = sampling.repeated_splits(records, ["is_member"], 0.2, "record_id", [10, 11, 12], unit=_unit("record_id", F.col("rep_seed")))
    return splits.select("record_id", "rep", "in_test")


_U, _V = "((event_id * 7919 % 10007 + 0.5) / 10007)", "((event_id * 104729 % 10009 + 0.5) / 10009)"


def _uniform(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    k = F.col("event_id")
    return table(spark, sf_dir, "events"), (k * 7919 % 10007 + 0.5) / F.lit(10007.0), (k * 104729 % 10009 + 0.5) / F.lit(10009.0)


@query(f"WITH t AS (SELECT event_id AS record_id, 1 - CASE WHEN event_id % 3 = 0 THEN power(1 - {_U}, 1 / 2.0) ELSE power(1 - {_U}, 1 / 3.0) END AS top, {_V} AS v FROM events) SELECT record_id, round(1 - CASE WHEN v < 0.5 THEN top ELSE 1 - top END, 6) AS s0, round(CASE WHEN v < 0.5 THEN top ELSE 1 - top END, 6) AS s1 FROM t")
def dummy_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, u, v = _uniform(spark, sf_dir)
    s0, s1 = sampling.dummy_columns(u, v, (F.col("event_id") % 3 == 0).cast("int"), 2.0, 3.0)
    return rounded(rows.select(F.col("event_id").alias("record_id"), s0.alias("s0"), s1.alias("s1")))


@query(f"SELECT event_id AS record_id, round(-1.5 * sign({_U} - 0.5) * ln(1 - 2 * abs({_U} - 0.5)), 6) AS laplace, round(1.5 * sqrt(-2 * ln({_U})) * cos({2 * math.pi!r} * {_V}), 6) AS gaussian FROM events")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, u, v = _uniform(spark, sf_dir)
    return rounded(rows.select(F.col("event_id").alias("record_id"), sampling.laplace_noise(u, 1.5).alias("laplace"), sampling.gaussian_noise(u, v, 1.5).alias("gaussian")))


# ---------------------------------------------------------------- given trees

_TREE = {1: (0, 0.0), 2: (1, -0.5), 3: (2, 0.25)}
_LEAF = "CASE WHEN coalesce(f[1], 0) > 0 THEN CASE WHEN coalesce(f[3], 0) > 0.25 THEN 7 ELSE 6 END ELSE CASE WHEN coalesce(f[2], 0) > -0.5 THEN 5 ELSE 4 END END"
_LEAVES = _RECORDS + ", placed AS (SELECT target_id, record_id, probs, " + _LEAF + " AS leaf FROM (SELECT *, list_transform(features, lambda x: CASE WHEN isnan(x) THEN NULL ELSE x END) AS f FROM rec) WHERE split = 'train' AND features IS NOT NULL AND target_id IS NOT NULL)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = F.map_from_arrays(F.array(*map(F.lit, _TREE)), F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in _TREE.values()]))
    rows = _records(spark, sf_dir).filter("split = 'train' and features is not null and target_id is not null")
    return rows.withColumn("leaf", trees.walk(trees.filled("features"), splits, 2))


@query(
    f"WITH {_LEAVES}, sized AS (SELECT *, count(*) OVER (PARTITION BY target_id, leaf) AS k, first_value(probs) OVER (PARTITION BY target_id, leaf ORDER BY record_id) AS p FROM placed)"
    " SELECT record_id, CAST(k AS BIGINT) AS k_anonymity, coalesce(len(list_filter(p, lambda v: abs(v) <= 1e-8)) > 0, false) AS class_disclosure,"
    " coalesce(len(list_filter(p, lambda v: v * k > 0 AND v * k < 10)) > 0, false) AS smallgroup_risk FROM sized"
)
def g_tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = equivalence.record_risks(cut_lineage(_placed(spark, sf_dir)), ["target_id", "leaf"])
    no = F.lit(False)
    return risks.withColumns({c: F.coalesce(c, no) for c in ("class_disclosure", "smallgroup_risk")})


@query(f"WITH {_LEAVES} SELECT target_id, CAST(min(k) AS BIGINT) AS k_anonymity FROM (SELECT target_id, count(*) AS k FROM placed GROUP BY target_id, leaf) GROUP BY target_id")
def g_tree_k_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.smallest_leaf(_placed(spark, sf_dir), "leaf", ["target_id"])


# ---------------------------------------------------------------- attributes, with a confidence given by arithmetic

_SEGMENTS = "v AS (SELECT c_mktsegment AS candidate, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer))"
_SCORED = (
    _SEGMENTS
    + ", scored AS (SELECT c_custkey, c_custkey % 3 > 0 AS m, c_custkey % 2 AS label, c_mktsegment, candidate, ((c_custkey * 31 + i * 17) % 23) / 23.0::DOUBLE AS p FROM customer, v),"
    " kept AS (SELECT *, CASE WHEN CASE WHEN p > 1 - p THEN 1 ELSE 0 END = label THEN CASE WHEN label = 1 THEN p ELSE 1 - p END END AS conf FROM scored),"
    " tops AS (SELECT c_custkey, CAST(any_value(m) AS INTEGER) AS is_member, any_value(c_mktsegment) AS actual, max(conf) AS top, max_by(candidate, conf) AS guess, list(conf) AS confs FROM kept GROUP BY c_custkey),"
    " judged AS (SELECT *, coalesce(top >= 0.6 AND len(list_filter(confs, lambda c: c = top)) = 1, false) AS inferred FROM tops)"
)


def _inferred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(k.alias("record_id"), (k % 3 > 0).cast("int").alias("is_member"), (k % 2).cast("int").alias("label"), "c_mktsegment")
    values = attribute.feature_values(customers, F.col("c_mktsegment"))
    swept = attribute.one_hot_candidates(customers, F.col("c_mktsegment"), values)
    p = ((F.col("record_id") * 31 + F.col("candidate_no") * 17) % 23) / F.lit(23.0)
    return attribute.infer_categorical(swept.withColumn("probs", F.array(1 - p, p)), 0.6), customers


@query(f"WITH {_SCORED} SELECT c_custkey AS record_id, is_member, inferred, inferred AND guess = actual AS correct FROM judged")
def attr_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir)[0]


@query(
    f"WITH {_SCORED}, base AS (SELECT is_member, max(n) / sum(n) * 100 AS baseline, count(*) AS n_unique FROM (SELECT is_member, actual, count(*) AS n FROM judged GROUP BY ALL) GROUP BY is_member)"
    " SELECT j.is_member, CAST(count(*) FILTER (inferred AND guess = actual) AS BIGINT) AS n_correct, CAST(count(*) FILTER (inferred) AS BIGINT) AS n_inferred, CAST(count(*) AS BIGINT) AS n_records,"
    " round(any_value(baseline), 6) AS baseline, CAST(any_value(n_unique) AS BIGINT) AS n_unique FROM judged j JOIN base b ON b.is_member = j.is_member GROUP BY j.is_member"
)
def attr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, customers = _inferred(spark, sf_dir)
    return rounded(attribute.risk_report(found, customers, F.col("c_mktsegment")))


_SCORE = "(CASE WHEN abs({x} - c) <= 3 THEN 0.9 WHEN abs({x} - c) <= 9 THEN 0.5 ELSE 0.1 END)"
_SWEPT = (
    "ends AS (SELECT min(v) AS low, max(v) AS high FROM (SELECT CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part)),"
    " rows AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS DOUBLE) END AS v, p_size + p_partkey % 5 - 2 AS c FROM part),"
    " swept AS (SELECT p_partkey, v, c, list_transform(range(100), lambda i: CASE WHEN i = 99 THEN high ELSE low + i * (high - low) / 99.0::DOUBLE END) AS pts FROM rows, ends),"
    " scored AS (SELECT *, list_transform(pts, lambda x: " + _SCORE.format(x="x") + ") AS sc FROM swept),"
    " peaks AS (SELECT *, list_max(sc) AS peak, list_filter(pts, lambda x, i: sc[i] >= list_max(sc)) AS best FROM scored),"
    " judged AS (SELECT p_partkey AS record_id, p_partkey % 2 AS is_member, coalesce(peak > 0 AND " + _SCORE.format(x="v") + " = peak AND best[1] >= 0.9 * v AND best[-1] <= 1.1 * v, false) AS at_risk FROM peaks)"
)


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("p_partkey"), F.col("p_size") + F.col("p_partkey") % 5 - 2
    rows = table(spark, sf_dir, "part").select(k.alias("record_id"), (k % 2).alias("is_member"), F.when(k % 11 > 0, F.col("p_size").cast("double")).otherwise(float("nan")).alias("actual"), c.alias("c"))
    value = F.when(~F.isnan("actual"), F.col("actual"))
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()  # two numbers
    score = lambda x: F.when(F.abs(x - F.col("c")) <= 3, 0.9).when(F.abs(x - F.col("c")) <= 9, 0.5).otherwise(0.1)
    return attribute.swept_risk(rows, score, F.lit(ends.low), F.lit(ends.high)).select("record_id", "is_member", "at_risk")


@query(f"WITH {_SWEPT} SELECT record_id, is_member, at_risk FROM judged")
def attr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir)


@query(f"WITH {_SWEPT} SELECT is_member, round(avg(CAST(at_risk AS INTEGER)), 6) AS risk_fraction FROM judged GROUP BY is_member")
def attr_bounds_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attribute.bounds_fraction(_swept(spark, sf_dir)))


# ---------------------------------------------------------------- quantile thresholds of given leaves


@query(
    "WITH s AS (SELECT o_orderkey AS record_id, o_orderkey % 2 AS is_member, CAST(o_custkey % 40 AS INTEGER) AS leaf, o_totalprice AS score FROM orders),"
    " q AS (SELECT leaf, quantile_disc(score, 0.9) FILTER (is_member = 0) AS t FROM s GROUP BY leaf) SELECT record_id, round(-(score - t), 4) AS s0, round(score - t, 4) AS s1 FROM s JOIN q USING (leaf)"
)
def qmia_leaf_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("record_id"), (k % 2).alias("is_member"), (F.col("o_custkey") % 40).cast("int").alias("leaf"), F.col("o_totalprice").alias("score"))
    return rounded(qmia.margins(qmia.leaf_thresholds(rows, 0.1)).select("record_id", "s0", "s1"), 4)


# ---------------------------------------------------------------- stored instances and structure


@query(
    "WITH m AS (SELECT target_id, CASE target_id % 4 WHEN 0 THEN 'SVC' WHEN 1 THEN 'KNeighborsClassifier' WHEN 2 THEN 'DPSVC' ELSE 'RandomForestClassifier' END AS t FROM targets)"
    " SELECT target_id, t <> 'RandomForestClassifier' AS stores_instances, t = 'DPSVC' AS private_noise, t IN ('SVC', 'KNeighborsClassifier') AS advised FROM m"
)
def instance_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("target_id")
    kind = F.when(k % 4 == 0, "SVC").when(k % 4 == 1, "KNeighborsClassifier").when(k % 4 == 2, "DPSVC").otherwise("RandomForestClassifier")
    found = instances.kinds(table(spark, sf_dir, "targets").select("target_id", kind.alias("model_type")))
    return found.select("target_id", "stores_instances", "private_noise", F.col("mitigation").isNotNull().alias("advised"))


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    train = part.select(F.col("p_partkey").alias("record_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"))
    stored = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("stored_id"), F.col("p_partkey").alias("hint"), F.array(F.col("p_size") * 1.0, F.col("p_retailprice") + F.col("p_partkey") % 2).alias("features"))
    return stored, train


_TWO = (
    "hits AS (SELECT DISTINCT coalesce(min(t.p_partkey) FILTER (t.p_partkey = s.p_partkey), min(t.p_partkey)) AS record_id FROM part s JOIN part t"
    " ON s.p_size = t.p_size AND abs(s.p_retailprice + s.p_partkey % 2 - t.p_retailprice) <= 1e-8 + 1e-5 * abs(t.p_retailprice) WHERE s.p_partkey % 3 = 0 GROUP BY s.p_partkey)"
)


@query(f"WITH {_TWO} SELECT p_partkey AS record_id, CAST(h.record_id IS NOT NULL AS INTEGER) AS individual_risk FROM part LEFT JOIN hits h ON h.record_id = p_partkey")
def instance_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, train = _two_sets(spark, sf_dir)
    return instances.individual_risk(train, instances.match(stored, train))


@query("SELECT p_partkey AS stored_id, p_partkey AS record_id FROM part WHERE p_partkey % 6 = 0 ORDER BY 1 LIMIT 10")
def instance_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, train = _two_sets(spark, sf_dir)
    return instances.examples(instances.match(stored.filter("stored_id % 2 = 0"), train))


@query(
    "WITH coarse AS (SELECT record_id, is_member, y, list_transform(probs, lambda p: round(p, 1)) AS probs FROM emb_probs), kinds AS (SELECT probs, count(*) AS k FROM coarse WHERE is_member = 1 GROUP BY probs),"
    " g AS (SELECT CAST(min(k) AS BIGINT) AS min_k, bool_or(k < 10) AS k_anonymity_risk, bool_or(len(list_filter(probs, lambda p: abs(p) <= 1e-8)) > 0) AS class_disclosure_risk,"
    " bool_or(len(list_filter(probs, lambda p: p * k > 0 AND p * k < 10)) > 0) AS smallgroup_risk, CAST(count(*) AS BIGINT) AS n_classes FROM kinds),"
    " a AS (SELECT CAST(count(*) FILTER (is_member = 1) - 100 AS BIGINT) AS residual_dof, count(*) FILTER (is_member = 1) - 100 < 10 AS dof_risk,"
    " avg(ok) FILTER (is_member = 1) AS train_acc, avg(ok) FILTER (is_member = 0) AS test_acc FROM (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 = y AS INTEGER) AS ok FROM coarse)),"
    " counts AS (SELECT 1 - probs[y + 1] AS v, sum(is_member) AS p, sum(1 - is_member) AS n FROM coarse GROUP BY 1),"
    " upto AS (SELECT sum(p) OVER (ORDER BY v) AS up, sum(n) OVER (ORDER BY v) AS un, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM counts), ks AS (SELECT max(abs(up / tp - un / tn)) AS ks_stat FROM upto)"
    " SELECT g.*, residual_dof, dof_risk, round(train_acc, 6) AS train_acc, round(test_acc, 6) AS test_acc, round(train_acc - test_acc, 6) AS generalisation_gap, round(ks_stat, 6) AS ks_stat, true AS unnecessary_risk FROM g, a, ks",
    ("emb_probs",),
)
def structural_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coarse(spark, sf_dir).withColumn("loss", exprs.loss(F.col("probs"), F.col("y")))
    params = spark.createDataFrame([(None, None, 2, 2, "best")], "max_depth int, max_features string, min_samples_leaf int, min_samples_split int, splitter string")
    out = structural.structural_report(cut_lineage(rows), "probs", 100, exprs.argmax(F.col("probs")) == F.col("y"), params=params, model_type="DecisionTreeClassifier", loss="loss")
    return rounded(out.drop("ks_p", "ks_risk"))


# ---------------------------------------------------------------- meta attack

_CACHED = MEMBER_SQL + ", cached AS (SELECT DISTINCT target_id, attack_name AS attack FROM member_runs WHERE target_id IS NOT NULL AND record_id IS NOT NULL)"


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = member_runs(spark, sf_dir).filter("record_id is not null")
    return runs.select("target_id", F.col("attack_name").alias("attack"), "record_id", "is_member", F.col("s1").alias("score"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "targets").select("target_id")
    return targets.withColumn("attack", F.explode(F.array(F.lit("LiRA Attack"), F.lit("QMIA Attack"))))


@query(
    f"WITH {_CACHED} SELECT t.target_id, a.attack FROM targets t CROSS JOIN (VALUES ('LiRA Attack'), ('QMIA Attack')) a(attack) WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.target_id = t.target_id AND c.attack = a.attack)"
)
def meta_missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.missing_runs(_wanted(spark, sf_dir), _cached(spark, sf_dir).select("target_id", "attack").distinct())


_FILLED = (
    f"WITH {_CACHED}, wanted AS (SELECT t.target_id, a.attack FROM targets t CROSS JOIN (VALUES ('LiRA Attack'), ('QMIA Attack')) a(attack)),"
    " kept AS (SELECT w.target_id, w.attack, r.record_id, r.s1 AS score FROM wanted w JOIN member_runs r ON r.target_id = w.target_id AND r.attack_name = w.attack WHERE r.record_id IS NOT NULL),"
    " rec AS (SELECT DISTINCT target_id, record_id FROM records WHERE target_id IS NOT NULL AND record_id IS NOT NULL),"
    " fresh AS (SELECT w.target_id, w.attack, r.record_id, (r.record_id % 100) / 100 AS score FROM wanted w JOIN rec r ON r.target_id = w.target_id {only}) "
    "SELECT target_id, attack, CAST(count(*) AS BIGINT) AS n, round(avg(greatest(0, least(1, score))), 12) AS mean FROM {source} GROUP BY ALL"
)


def _gathered(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    records = table(spark, sf_dir, "records").filter("target_id is not null and record_id is not null").select("target_id", "record_id").distinct()
    run = lambda runs: runs.join(records, "target_id").withColumns({"is_member": F.lit(1), "score": F.col("record_id") % 100 / F.lit(100.0)})
    scores = meta.gathered(_wanted(spark, sf_dir), _cached(spark, sf_dir), None if mode == "use_existing_only" else run, mode)
    return rounded(scores.groupBy("target_id", "attack").agg(F.count(F.lit(1)).alias("n"), F.avg(exprs.clip01(F.col("score"))).alias("mean")), 12)


@query(_FILLED.format(only="", source="fresh"))
def meta_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(spark, sf_dir, "run_all")


@query(_FILLED.format(only="", source="kept"))
def meta_use_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(spark, sf_dir, "use_existing_only")


@query(_FILLED.format(only="WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.target_id = w.target_id AND c.attack = w.attack)", source="(SELECT * FROM kept UNION ALL SELECT * FROM fresh)"))
def meta_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(spark, sf_dir, "fill_missing")


@query(_WIDE_SQL + "SELECT is_member, n_vulnerable, CAST(count(*) AS BIGINT) AS n_records FROM counted GROUP BY ALL")
def meta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.histogram(_matrix(spark, sf_dir))


@query(
    _WIDE_SQL.rstrip()
    + ", scored AS (SELECT 'meta' AS attack, is_member, (lira_mean + qmia_mean + worstcase_mean) / 3 AS s1 FROM counted WHERE lira_mean IS NOT NULL AND qmia_mean IS NOT NULL AND worstcase_mean IS NOT NULL),"
    + RUNNING_SQL.format(key="attack", frame="scored")
    + " SELECT attack, CAST(max(total_p) AS BIGINT) AS n_pos, CAST(max(total_n) AS BIGINT) AS n_neg, round(sum(n * (cum_p - p / 2)) / (max(total_p) * max(total_n)), 3) AS auc FROM running GROUP BY attack"
)
def meta_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = meta.as_scored(_matrix(spark, sf_dir)).filter("s1 is not null")
    return rounded(metrics.auc(_running(scored, ["attack"]), ["attack"], counts=True), 3)


# ---------------------------------------------------------------- significance, summaries, plots

_P = "((event_id * 7919) % 10007) / 10007.0::DOUBLE"
_RUNS = f"runs AS (SELECT event_type AS experiment, event_id, {_P} AS p, round(value / (value + 50), 6) AS auc, round(value / (value + 80), 6) AS acc, round(value / 1000, 6) AS fdif01, -ln({_P} * 0.99 + 0.001) AS pdif01 FROM events)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v = ((F.col("event_id") * 7919) % 10007) / F.lit(10007.0), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("experiment"), "event_id", p.alias("p_higher_auc"), F.round(v / (v + 50), 6).alias("auc"), F.round(v / (v + 80), 6).alias("acc"), F.round(v / 1000, 6).alias("fdif01"), (-F.log(p * 0.99 + 0.001)).alias("pdif01")
    )


_THREE = ("auc", "acc", "fdif01")


@query(f"WITH {_RUNS} SELECT experiment, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in _THREE for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"))) + " FROM runs GROUP BY experiment")
def sig_univariate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.univariate(_runs(spark, sf_dir), ["experiment"], list(_THREE)))


@query(f"WITH {_RUNS} SELECT experiment, CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (p <= 0.05) AS BIGINT) AS n_significant FROM runs GROUP BY experiment")
def sig_uncorrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.corrected(_runs(spark, sf_dir), ["experiment"]).select("experiment", F.col("n_total").cast("bigint").alias("n_total"), F.col("n_significant").cast("bigint").alias("n_significant"))


@query(
    f"WITH {_RUNS}, e AS (SELECT *, exp(-pdif01) AS q FROM runs), ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY q) AS r, count(*) OVER (PARTITION BY experiment) AS m FROM e)"
    " SELECT experiment, CAST(count(*) FILTER (q <= 0.05) AS BIGINT) AS n_significant, CAST(count(*) FILTER (q <= 0.05 / m) AS BIGINT) AS n_bonferroni FROM ranked GROUP BY experiment"
)
def sig_fdif_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumn("fdif_p", significance.pdif_p(F.col("pdif01")))
    return significance.corrected(runs, ["experiment"], "fdif_p").select("experiment", *[F.col(c).cast("bigint").alias(c) for c in ("n_significant", "n_bonferroni")])


@query("SELECT p_partkey AS run, printf('%.4f -> %.4f', 0.5 - 3 * (p_size / 977.0::DOUBLE), 0.5 + 3 * (p_size / 977.0::DOUBLE)) AS null_range FROM part")
def sig_null_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), significance.null_range(F.col("p_size") / F.lit(977.0)).alias("null_range"))


@query(f"WITH {_RUNS} SELECT event_id AS run, CASE WHEN p <= 0.05 THEN 'Significant at p=0.05' ELSE 'Not significant at p=0.05' END AS lira, CASE WHEN p < 0.05 THEN 'Significant at p=0.05' ELSE 'Not significant at p=0.05' END AS qmia FROM runs")
def sig_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_higher_auc")
    return _runs(spark, sf_dir).select(F.col("event_id").alias("run"), significance.significance_text(p).alias("lira"), significance.significance_text(p, strict=True).alias("qmia"))


@query(
    f"WITH {_RUNS}, shown AS (SELECT experiment, auc, exp(-pdif01) AS pdif01 FROM runs) SELECT experiment, "
    + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("auc", "pdif01") for n, f in (("mean", "avg"), ("var", "var_pop"), ("min", "min"), ("max", "max")))
    + " FROM shown GROUP BY experiment"
)
def sig_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.display_summary(_runs(spark, sf_dir), ["experiment"], ["auc", "pdif01"]))


_MODELS = "m AS (SELECT p_partkey AS target_id, CASE p_partkey % 4 WHEN 0 THEN 'SVC' WHEN 1 THEN 'KNeighborsClassifier' ELSE 'RandomForestClassifier' END AS model_name, CASE WHEN p_partkey % 5 > 0 THEN p_size % 9 END AS leaf FROM part)"


@query(
    f"WITH {_MODELS} SELECT target_id, 'immediate_rejection' AS bucket, CASE model_name WHEN 'SVC' THEN 'Model is SVM' ELSE 'Model is kNN' END AS reason FROM m WHERE model_name IN ('SVC', 'KNeighborsClassifier')"
    " UNION ALL SELECT target_id, CASE WHEN leaf < 5 THEN 'support_rejection' ELSE 'support_release' END, CASE WHEN leaf < 5 THEN 'Min samples per leaf < 5' ELSE 'Min samples per leaf > 5' END FROM m WHERE leaf IS NOT NULL"
)
def recommendation_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "SVC").when(k % 4 == 1, "KNeighborsClassifier").otherwise("RandomForestClassifier")
    return significance.model_recommendation(table(spark, sf_dir, "part").select(k.alias("target_id"), name.alias("model_name"), F.when(k % 5 > 0, F.col("p_size") % 9).alias("min_samples_leaf")))


@query(
    "SELECT is_member, instance, round(s1, 6) AS s1, CAST(n AS BIGINT) AS n_records, CAST(sum(n) OVER (PARTITION BY instance, is_member ORDER BY s1) AS BIGINT) AS last_place"
    " FROM (SELECT instance, is_member, s1, count(*) AS n FROM audit_events GROUP BY ALL)",
    ("audit_events",),
)
def plot_sorted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sorted_scores(frames.audit_events(spark, sf_dir), ["instance"]))


_BOARD = "SELECT p_brand AS scenario, p_type AS attack, (p_partkey * 37 % 1009) / 1009.0::DOUBLE AS auc, 1 + p_partkey * 91 % 977 AS seconds FROM part"


@query(
    f"WITH means AS (SELECT scenario, attack, avg(auc) AS auc, avg(seconds) AS seconds FROM ({_BOARD}) GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY auc DESC, attack) AS a,"
    " row_number() OVER (PARTITION BY scenario ORDER BY seconds, attack) AS s, row_number() OVER (PARTITION BY scenario ORDER BY auc / seconds DESC, attack) AS r FROM means)"
    " SELECT scenario, max(attack) FILTER (a = 1) AS best, round(max(auc) FILTER (a = 1), 6) AS best_auc, max(attack) FILTER (s = 1) AS fastest, round(max(seconds) FILTER (s = 1), 6) AS least_seconds, max(attack) FILTER (r = 1) AS best_rate FROM placed GROUP BY scenario"
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    runs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scenario"), F.col("p_type").alias("attack"), (k * 37 % 1009 / F.lit(1009.0)).alias("auc"), (1 + k * 91 % 977).alias("seconds"))
    return rounded(significance.leaderboard(runs))


@query(
    "WITH a AS (SELECT p_partkey AS k, p_type AS t, p_brand AS b FROM part WHERE p_partkey % 3 <> 0), z AS (SELECT p_partkey AS k, p_type AS b, p_name AS n FROM part WHERE p_partkey % 3 <> 1)"
    " SELECT coalesce(a.k, z.k) AS report, a.t AS type, coalesce(z.b, a.b) AS brand, z.n AS name FROM a FULL JOIN z ON a.k = z.k"
)
def reports_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("report"), F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand").alias("values"))
    second = part.filter("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("report"), F.create_map(F.lit("brand"), "p_type", F.lit("name"), "p_name").alias("values"))
    return significance.merged_reports(first, second, "report").select("report", *[F.try_element_at("values", F.lit(k)).alias(k) for k in ("type", "brand", "name")])


@query(
    "WITH"
    + RUNNING_SQL.format(**EVENTS)
    + ", sized AS (SELECT instance, CAST(max(total_p) AS DOUBLE) AS np, CAST(max(total_n) AS DOUBLE) AS nn FROM running GROUP BY instance)"
    " SELECT instance, 3 AS n_total, printf('%.4f -> %.4f', 0.5 - 3 * sqrt((0.25 + (np - 1 + nn - 1) * (1 / 3 - 0.25)) / (np * nn)), 0.5 + 3 * sqrt((0.25 + (np - 1 + nn - 1) * (1 / 3 - 0.25)) / (np * nn))) AS null_auc_range FROM sized",
    ("audit_events",),
)
def worstcase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal repetitions of a given score, summed up as the worst-case attack does."""
    df = frames.audit_events(spark, sf_dir)
    runs = metrics.metrics(df, ["instance"]).withColumn("rep", F.explode(F.array(*map(F.lit, range(3)))))
    return worstcase.summary(cut_lineage(runs), ["instance"]).select("instance", F.col("n_total").cast("int").alias("n_total"), "null_auc_range")


# ---------------------------------------------------------------- rules and equality of models

_ODD_RULES = [
    ("Odd", 1, None, "or", None, None),
    ("Odd", 2, 1, "max", "size", "30"),
    ("Odd", 3, 1, "min", "price", "1000"),
    ("Odd", 4, None, "max", "size", "45"),
    ("Odd", 5, None, "between", "size", "3"),
]


def _odd_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(c).cast("string").alias("value"), F.lit(t).alias("value_type")) for k, c, t in (("size", "p_size", "int"), ("price", "p_retailprice", "float"))])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.lit("Odd").alias("model_type"), F.explode(pairs).alias("p")).select("model_id", "model_type", "p.*")


@query("SELECT p_partkey AS model_id, (p_size > 30 AND p_retailprice < 1000) OR p_size > 45 AS disclosive FROM part")
def rules_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An or-group, a maximum, and an operator that is not known, which is reported and not disclosive."""
    return rules.check(_odd_params(spark, sf_dir), spark.createDataFrame(_ODD_RULES, rules._SCHEMA)).select("model_id", "disclosive")


@query("SELECT p_partkey AS model_id, CASE WHEN p_size > 45 THEN '- size is ' || p_size || ', which breaks max 45' END AS too_large, '- the rule''s operator between is not known' AS unknown FROM part")
def rules_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = rules.check_leaves(_odd_params(spark, sf_dir), spark.createDataFrame(_ODD_RULES, rules._SCHEMA))
    pick = lambda n: F.max(F.when(F.col("rule_id") == n, F.col("message")))
    return leaves.groupBy("model_id").agg(pick(4).alias("too_large"), pick(5).alias("unknown"))


@query("SELECT model_id, CASE WHEN model_id % 2 = 0 THEN min_samples_leaf < 5 ELSE NOT bootstrap OR min_samples_leaf < 5 END OR model_id % 10 = 0 OR model_id % 7 = 0 AS refused FROM params", ("params",))
def rules_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that break a rule, changed after fitting (a tenth), or have no saved copy (a seventh)."""
    from leakscope.plans.audit import _rule_params

    params = _rule_params(spark, sf_dir)
    now = params.select("model_id", F.col("keyword").alias("path"), F.when(F.col("model_id") % 10 == 0, "other").otherwise(F.col("value")).alias("value"))
    saved = params.filter("model_id % 7 <> 0").select("model_id", F.col("keyword").alias("path"), "value")
    changed = rules.differences(now.join(saved.select("model_id").distinct(), "model_id", "left_semi"), saved)
    verdict = rules.release(rules.check(params, rules.shipped_rules(spark)), changed, saved)
    return verdict.select("model_id", (F.col("recommendation") != rules.RELEASE).alias("refused"))


@query(
    "WITH a AS (SELECT p_partkey AS id, 0 AS i, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part WHERE p_partkey % 4 = 0),"
    " b AS (SELECT p_partkey AS id, 0 AS i, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_brand END FROM part)"
    " SELECT coalesce(a.id, b.id) AS model_id, CAST(coalesce(a.i, b.i) AS VARCHAR) AS position, a.v AS current_value, b.v AS saved_value FROM a FULL JOIN b ON a.id = b.id AND a.i = b.i WHERE a.v IS DISTINCT FROM b.v"
)
def rules_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size, brand, kind = F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_type")
    now = part.select(k.alias("model_id"), F.when(k % 4 == 0, F.array(size, brand, kind)).otherwise(F.array(size, brand)).alias("values"))
    saved = part.select(k.alias("model_id"), F.array(size, F.when(k % 6 == 0, "x").otherwise(brand)).alias("values"))
    return rules.list_differences(now, saved)


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node tables of forests: an order is a tree of a customer's forest; prices of some lines differ in the saved copy, some orders lack there."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 500).alias("model_id"), F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").alias("node_id"), F.col("l_quantity").alias("threshold"), F.col("l_partkey").alias("feature")
    )
    saved = rows.filter("tree_id % 97 <> 0").withColumn("threshold", F.when(F.col("tree_id") % 53 == 0, F.col("threshold") + 1).otherwise(F.col("threshold")))
    return rows.dropDuplicates(["model_id", "tree_id", "node_id"]), saved.dropDuplicates(["model_id", "tree_id", "node_id"])


@query(
    "WITH n AS (SELECT DISTINCT l_suppkey % 500 AS model_id, l_orderkey AS t, l_linenumber AS node FROM lineitem)"
    " SELECT model_id, CAST(count(*) AS BIGINT) AS n_nodes, CAST(count(*) FILTER (t % 53 = 0 OR t % 97 = 0) AS BIGINT) AS n_differing, count(*) FILTER (t % 53 = 0 OR t % 97 = 0) = 0 AS equal FROM n GROUP BY model_id"
)
def tree_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, saved = (df.withColumn("node_id", F.struct("tree_id", "node_id")).drop("tree_id") for df in _nodes(spark, sf_dir))
    return rules.tree_differences(now, saved)


@query(
    "WITH n AS (SELECT DISTINCT l_suppkey % 500 AS model_id, l_orderkey AS t FROM lineitem)"
    " SELECT model_id, CAST(count(*) FILTER (t % 53 = 0 OR t % 97 = 0) AS BIGINT) AS n_differing_trees, CAST(count(*) AS BIGINT) AS n_trees, CAST(count(*) FILTER (t % 97 <> 0) AS BIGINT) AS n_saved_trees, count(*) FILTER (t % 53 = 0 OR t % 97 = 0) = 0 AS equal FROM n GROUP BY model_id"
)
def forest_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.forest_differences(*_nodes(spark, sf_dir))


@query(
    "SELECT p_partkey AS model_id, 'size' AS path, CAST(p_size AS VARCHAR) AS current_value, CAST(p_size + 1 AS VARCHAR) AS saved_value FROM part WHERE p_partkey % 8 = 0"
    " UNION ALL SELECT p_partkey, 'brand', p_brand, NULL FROM part WHERE p_partkey % 9 = 0"
)
def svm_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    now = part.select(k.alias("model_id"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand").alias("values"))
    size = F.when(k % 8 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    saved = part.select(k.alias("model_id"), F.when(k % 9 == 0, F.create_map(F.lit("size"), size)).otherwise(F.create_map(F.lit("size"), size, F.lit("brand"), "p_brand")).alias("values"))
    return rules.nested_differences(now, saved)
