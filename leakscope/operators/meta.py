"""Cross-attack vulnerability: scores of several attacks joined per record into one matrix.

Repetitions are combined before anything is joined: one aggregate by record and
attack, one pivot by record over a fixed list of attacks.

Defined results: scores are held in [0, 1] (NaN counts as 1); null scores are left
out; a record without scores of an attack has nulls there, which count as not
vulnerable; structural results exist for members only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import EPS_META, clip01
from leakscope.session import latest_rows

SCORE_THRESHOLD, K_THRESHOLD = 0.5, 10


def repetitions(scores: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """(record_id, attack, is_member, mean, std, consistency, vuln) of scores (record_id, attack, is_member, score)."""
    held = scores.filter("score is not null and record_id is not null").withColumn("score", clip01(F.col("score")))
    out = held.groupBy("record_id", "attack").agg(
        F.max("is_member").alias("is_member"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.avg((F.col("score") > threshold).cast("double")).alias("consistency"),
    )
    # 12 digits: the sum's order must not decide a mean that lies on the threshold
    return out.withColumn("vuln", F.round("mean", 12) > threshold)


def structural_repetitions(structural: DataFrame, k_threshold: int = K_THRESHOLD) -> DataFrame:
    """(record_id, struct_k, struct_cd, struct_sg, struct_vuln): k is the rounded mean, a flag holds if more than half do.

    Rows delivered more than once (if there is ingested_at) count once, as received last.
    """
    most = lambda c: F.avg(F.col(c).cast("double")) > 0.5
    rows = structural if "ingested_at" not in structural.columns else latest_rows(structural.select("log_id", "record_id", "ingested_at", "k_anonymity", "class_disclosure", "smallgroup_risk"), ["log_id", "record_id"])
    out = rows.groupBy("record_id").agg(F.bround(F.avg("k_anonymity")).cast("int").alias("struct_k"), most("class_disclosure").alias("struct_cd"), most("smallgroup_risk").alias("struct_sg"))
    return out.withColumn("struct_vuln", (F.col("struct_k") < k_threshold) | F.col("struct_cd") | F.col("struct_sg"))


def matrix(reps: DataFrame, attacks: list[str], structural: DataFrame | None = None) -> DataFrame:
    """One row of a record: mean, std, consistency, vuln of every attack, means across attacks, and n_vulnerable."""
    pick = lambda a, c: F.max(F.when(F.col("attack") == a, F.col(c))).alias(f"{a}_{c}")
    wide = reps.filter(F.col("attack").isin(*attacks)).groupBy("record_id").agg(
        F.max("is_member").alias("is_member"), *[pick(a, c) for a in attacks for c in ("mean", "std", "consistency", "vuln")]
    )
    means = [F.col(f"{a}_mean") for a in attacks]
    logs = [F.log(m + EPS_META) for m in means]
    total = lambda cols: sum(cols[1:], cols[0])
    wide = wide.withColumns({"arith_mean": total(means) / len(attacks), "geo_mean": F.exp(total(logs) / len(attacks))})
    vulns = [f"{a}_vuln" for a in attacks]
    if structural is not None:
        wide = wide.join(structural, "record_id", "left")
        for c in ("struct_k", "struct_cd", "struct_sg", "struct_vuln"):
            wide = wide.withColumn(c, F.when(F.col("is_member") == 1, F.col(c)))
        vulns.append("struct_vuln")
    count = total([F.coalesce(F.col(v).cast("int"), F.lit(0)) for v in vulns])
    return wide.withColumns({"n_vulnerable": count, "vulnerable_to_all": count == len(vulns)})


def vulnerable_to_all(wide: DataFrame) -> DataFrame:
    """One row: records, those vulnerable to every attack, and the histogram's largest count."""
    return wide.agg(F.count(F.lit(1)).alias("n_records"), F.count_if("vulnerable_to_all").alias("n_vulnerable_all"), F.max("n_vulnerable").alias("max_vulnerable"))


def histogram(wide: DataFrame) -> DataFrame:
    """(is_member, n_vulnerable, n_records)."""
    return wide.groupBy("is_member", "n_vulnerable").agg(F.count(F.lit(1)).alias("n_records"))


def most_vulnerable(wide: DataFrame, n: int = 10) -> DataFrame:
    return wide.orderBy(F.desc("n_vulnerable"), F.desc("arith_mean"), "record_id").limit(n)


def as_scored(wide: DataFrame, keys: dict | None = None) -> DataFrame:
    """The matrix as input of the metric engine: 1 - mean and mean."""
    named = [F.lit(v).alias(k) for k, v in (keys or {"attack": "meta"}).items()]
    return wide.select(*named, "record_id", "is_member", (1 - F.col("arith_mean")).alias("s0"), F.col("arith_mean").alias("s1"))


def missing_runs(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Runs (target_id, attack) that are wanted and not on file."""
    return wanted.join(cached, ["target_id", "attack"], "left_anti")


MODES = ("run_all", "use_existing_only", "fill_missing")


def gathered(wanted: DataFrame, cached: DataFrame, run: Callable[[DataFrame], DataFrame] | None = None, mode: str = "fill_missing") -> DataFrame:
    """Scores (target_id, attack, record_id, is_member, score) of the wanted runs (target_id, attack), from file and from new runs by mode.

    run computes the scores of a frame of runs. use_existing_only leaves runs that are not on file
    out; fill_missing computes just those; run_all computes all and takes none from file.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(MODES)}")
    columns = ["target_id", "attack", "record_id", "is_member", "score"]
    wanted = wanted.select("target_id", "attack").distinct()
    if mode != "use_existing_only" and run is None:
        raise ValueError(f"mode {mode} needs a way to run attacks")
    if mode == "run_all":
        return run(wanted).select(*columns)
    kept = cached.join(wanted, ["target_id", "attack"], "left_semi").select(*columns)
    if mode == "use_existing_only":
        return kept
    return kept.unionByName(run(missing_runs(wanted, cached.select("target_id", "attack").distinct())).select(*columns))
