"""Run configured attacks on a saved target: python -m leakscope.cli TARGET CONFIG OUT.

CONFIG is JSON: {"attacks": [{"name": "worstcase", "params": {...}}, ...]}. Without
arguments after `config` the questions of a configuration are asked.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.exprs import class_prob, logit
from leakscope.operators import attribute, equivalence, instances, lira, meta, metrics, models, qmia, sampling, structural, worstcase
from leakscope.session import cut_lineage
from leakscope.sources import bundle, report_sink


def _measured(scored: DataFrame, run: str) -> DataFrame:
    scored = scored.withColumn("run", F.lit(run))
    return metrics.metrics(metrics.scored(scored, ["run"], "record_id", F.col("is_member"), F.col("s0"), F.col("s1")), ["run"])


def run_worstcase(records: DataFrame, **params) -> DataFrame:
    return worstcase.report(records, **params).withColumn("run", F.concat_ws("_", "kind", "rep")).drop("kind", "rep")


def lira_scores(records: DataFrame, model: str = "RandomForestClassifier", n_shadow_models: int = 100, mode: str = "offline", fix_variance: bool = False, store: str | None = None, **params) -> DataFrame:
    """(record_id, is_member, s0, s1); store: a folder in which shadow confidences are kept and taken up again."""
    n_train = records.filter("is_member = 1").count()
    membership = cut_lineage(sampling.shadow_membership(records, n_shadow_models, n_train))
    shadow = models.shadow_confidences(records, membership, model, store=store, **params)
    target = models.score(models.fit(records.filter("is_member = 1"), model, **params), records)
    target = target.withColumn("target_logit", logit(class_prob(F.col("probs"), F.col("y"))))
    return lira.scores(target, lira.shadow_stats(shadow, fix_variance), mode)


def run_lira(records: DataFrame, mode: str = "offline", **params) -> DataFrame:
    return _measured(lira_scores(records, mode=mode, **params), mode)


def qmia_scores(records: DataFrame, alpha: float = qmia.ALPHA, **params) -> DataFrame:
    return qmia.margins(qmia.quantile_tree(qmia.hinge_scores(records), alpha, **params))


def run_qmia(records: DataFrame, alpha: float = qmia.ALPHA, **params) -> DataFrame:
    """Metrics with the calibration of the thresholds, and whether they are degenerate."""
    placed = cut_lineage(qmia_scores(records, alpha, **params))
    more = qmia.calibration(placed, alpha=alpha).crossJoin(F.broadcast(qmia.degenerate(placed)))  # one row each
    return _measured(placed, "qmia").crossJoin(F.broadcast(more))


def run_structural(records: DataFrame, key: str = "probs", threshold: int = equivalence.THRESHOLD, n_params: int = 0) -> DataFrame:
    from leakscope.functions.exprs import argmax, loss

    rows = records.withColumn("loss", loss(F.col("probs"), F.col("y")))
    report = structural.structural_report(cut_lineage(rows), key, n_params, argmax(F.col("probs")) == F.col("y"), threshold, loss="loss")
    return report.withColumn("run", F.lit("structural"))


def run_attribute(records: DataFrame, model: str = "DecisionTreeClassifier", features: dict | None = None, max_values: int = 20, **params) -> DataFrame:
    """One row of each feature and split: totals of categorical features, share at risk of the others.

    features: {id: {name, indices, encoding}}; without it a feature of at most max_values values is categorical.
    """
    width = records.select(F.max(F.size("features"))).first()[0] or 0
    listed = features or {str(i): {"name": f"f{i}", "indices": [i], "encoding": None} for i in range(width)}
    fitted = models.fit(records.filter("is_member = 1"), model, **params)
    out = None
    for f in listed.values():  # features of one model
        indices, encoding = [int(i) for i in f["indices"]], f["encoding"]
        column = F.get("features", F.lit(indices[0]))
        known = records.filter(column.isNotNull() & ~F.isnan(column))
        few = known.select(column.alias("v")).distinct().limit(max_values + 1).count() <= max_values
        if encoding in ("str", "int", "onehot") or (encoding is None and few):
            if len(indices) > 1:
                column = F.to_json(F.array(*[F.get("features", F.lit(i)) for i in indices]))
                values = attribute.feature_values(known, column)
                order = [json.loads(v).index(1.0) if 1.0 in json.loads(v) else 0 for v in values]
                values = [v for _, v in sorted(zip(order, values, strict=True))]
            else:
                values = attribute.feature_values(known, column)
            found = attribute.categorical_attack(known, fitted, indices, values, column)
            part = attribute.risk_report(found, known, column).withColumn("risk_fraction", F.lit(None).cast("double"))
        else:
            found = attribute.bounds_fraction(attribute.quantitative_attack(known, fitted, indices[0]))
            nothing = {c: F.lit(None).cast(t) for c, t in (("n_correct", "bigint"), ("n_inferred", "bigint"), ("n_records", "bigint"), ("baseline", "double"), ("n_unique", "bigint"))}
            part = found.withColumns(nothing)
        part = part.select(F.concat_ws("_", F.lit(f["name"]), F.when(F.col("is_member") == 1, "train").otherwise("test")).alias("run"), "n_correct", "n_inferred", "n_records", "baseline", "n_unique", "risk_fraction")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a target without features has no attributes to infer")
    return out


def run_instances(records: DataFrame, model_type: str = "KNeighborsClassifier", stored: str | None = None) -> DataFrame:
    """stored: a Parquet folder of stored rows (stored_id, hint, features); without it every training row counts as stored, as such models keep them."""
    train = records.filter("is_member = 1").select("record_id", "features")
    kept = records.sparkSession.read.parquet(stored) if stored else train.select(F.col("record_id").alias("stored_id"), F.col("record_id").alias("hint"), "features")
    return instances.report(kept, train, cut_lineage(instances.match(kept, train)), model_type).withColumn("run", F.lit("instances"))


def run_meta(records: DataFrame, lira_params: dict | None = None, qmia_params: dict | None = None, k_threshold: int = meta.K_THRESHOLD) -> DataFrame:
    """Metrics of the mean of LiRA and QMIA scores per record, with the numbers of vulnerable records."""
    parts = {"lira": lira_scores(records, **(lira_params or {})), "qmia": qmia_scores(records, **(qmia_params or {}))}
    scores = None
    for name, scored in parts.items():
        part = scored.select("record_id", F.lit(name).alias("attack"), "is_member", F.col("s1").alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    members = records.filter("is_member = 1")
    structs = meta.structural_repetitions(equivalence.record_risks(members, "probs"), k_threshold)
    wide = cut_lineage(meta.matrix(meta.repetitions(scores), list(parts), structs))
    whole = meta.vulnerable_to_all(wide)
    return _measured(meta.as_scored(wide).drop("attack").filter("s1 is not null"), "meta").crossJoin(F.broadcast(whole))  # one row


#: Attacks by the name a configuration uses.
ATTACKS: dict[str, Callable[..., DataFrame]] = {
    "worstcase": run_worstcase, "lira": run_lira, "qmia": run_qmia, "structural": run_structural, "attribute": run_attribute, "instance_based": run_instances, "meta": run_meta,
}


def default_config(names: list[str] | None = None) -> dict:
    return {"attacks": [{"name": n, "params": {}} for n in (names or sorted(ATTACKS))]}


def asked_config(ask: Callable[[str], str] = input) -> dict:
    """A configuration from answers: for each attack whether it is wanted, and its parameters as JSON (nothing for the defaults)."""
    chosen = []
    for name in sorted(ATTACKS):
        if ask(f"Run {name}? [y/N] ").strip().lower() in ("y", "yes"):
            given = ask(f"Parameters of {name} as JSON, or nothing: ").strip()
            chosen.append({"name": name, "params": json.loads(given) if given else {}})
    return {"attacks": chosen}


def run(spark: SparkSession, target: str, config: dict, out: str) -> list[str]:
    """Run every configured attack and append its report; the log ids come back."""
    records, manifest = bundle.load_target(spark, target)
    done = []
    for item in config["attacks"]:
        if item["name"] not in ATTACKS:
            raise ValueError(f"unknown attack {item['name']}; known: {', '.join(sorted(ATTACKS))}")
        log = str(uuid.uuid4())
        rows = report_sink.report_rows(ATTACKS[item["name"]](records, **item.get("params", {})), item["name"], log, "run", {"target": manifest.get("name", target)})
        report_sink.append_report(rows, out)
        done.append(log)
    return done


def main(args: list[str]) -> int:
    if args[:1] == ["config"]:
        print(json.dumps(asked_config(), indent=2))
        return 0
    if len(args) != 3:
        print(__doc__)
        return 2
    with open(args[1], encoding="utf-8") as text:
        config = json.load(text)
    spark = SparkSession.builder.appName("leakscope").getOrCreate()
    print("\n".join(run(spark, args[0], config, args[2])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
