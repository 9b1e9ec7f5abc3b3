"""Shadow trees of many targets at once.

Defined results: every shadow model of a target is trained on as many of the target's records
as the target has members; a class that a model has not seen has probability 0; targets without
members have no shadow models. Record ids are unique within a target.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.exprs import class_prob, logit
from leakscope.operators import resampled, sampling, trees
from leakscope.session import cut_lineage, small_side


def _whole(spark: SparkSession, path: str) -> list[str]:
    """The folders below path whose write was committed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [str(s.getPath().toString()) for s in files.listStatus(folder)]
    return sorted(f for f in found if files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def stored(spark: SparkSession, path: str, n_models: int, compute: Callable[[list[int]], DataFrame]) -> DataFrame:
    """The confidences of the first n_models shadow models, kept under path: only models not on file are computed.

    compute gives the confidences of the models asked for; they are written as one folder. A folder
    that was not written to its end does not count.
    """
    folders = _whole(spark, path)
    done = {r.model_idx for r in spark.read.parquet(*folders).select("model_idx").distinct().collect()} if folders else set()  # one row of each model
    missing = [i for i in range(n_models) if i not in done]
    if missing:
        compute(missing).write.parquet(f"{path}/{uuid.uuid4().hex}")
    return spark.read.parquet(*_whole(spark, path)).filter(F.col("model_idx") < n_models)


#: Values (rows times features) of a key up to which its shadow trees are grown in tasks of their own, and values times models of one such task.
MOST_VALUES, TASK_VALUES = 8_000_000, 100_000_000
#: Rows times models of a task of small keys, and the deepest trees of such tasks.
TASK_ROWS, TASK_DEPTH = 500_000, 8
#: Types of keys that the tasks compare.
_PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint", "date", "string"}


def tree_confidences(records: DataFrame, keys: list[str], n_models: int, max_depth: int, only: list[int] | None = None, most_values: int = MOST_VALUES, task_values: int = TASK_VALUES) -> DataFrame:
    """(keys, model_idx, record_id, in_train, conf): every record scored by every shadow tree of its key; conf is the logit of its class. only: the models wanted of those.

    The rows of a key go once to a task that grows the trees of all its models (to one for each block
    of models, if there are more than task_values values times models). Keys of more than most_values
    values, and keys whose rows lack features or label, differ in their number of features or have labels below 0,
    are grown from counts of rows by model.
    """
    width = F.size("features")
    known = records.dropna(subset=[*keys, "record_id"])
    sizes = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_member") == 1).alias("n_members"),
        F.max(width).alias("width"),
        ((F.min(width) != F.max(width)) | (F.min(F.col("y").cast("int")) < 0) | (F.count_if(F.col("features").isNull() | F.col("y").cast("int").isNull()) > 0)).alias("uneven"),
    )
    values = F.col("n") * F.col("width")
    simple = max_depth <= TASK_DEPTH and all(kind in _PLAIN for name, kind in records.dtypes if name in keys)
    sizes = sizes.filter("n_members > 0").withColumn("by_counts", F.col("uneven") | (values > most_values) | F.lit(not simple))
    sizes = cut_lineage(sizes.withColumn("blocks", F.least(F.lit(n_models), F.ceil(values * n_models / task_values)).cast("int")))
    total = sizes.agg(F.count_if("by_counts").alias("by_counts"), F.count_if((F.col("blocks") > 1) & ~F.col("by_counts")).alias("large"), F.coalesce(F.sum(F.when(~F.col("by_counts"), F.col("n"))), F.lit(0)).alias("n")).first()
    models = [i for i in range(n_models) if only is None or i in only]
    if total.by_counts:
        apart = small_side(sizes.filter("by_counts").select(*keys))
        counted = _from_counts(known.join(apart, keys, "left_semi"), keys, n_models, max_depth, only)
        if not total.n:
            return counted
        known = known.join(apart, keys, "left_anti")
    known = known.withColumns({"blocks": F.lit(1), "block": F.lit(0)})
    if total.large:
        known = known.drop("blocks").join(small_side(sizes.filter("blocks > 1 and not by_counts").select(*keys, "blocks")), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        known = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = trees.filled(F.col("features").cast("array<double>"))
    sent = known.select(*keys, "block", "blocks", "record_id", F.xxhash64("record_id").alias("hash"), F.coalesce(F.col("is_member") == 1, F.lit(False)).alias("is_member"), F.col("y").cast("int").alias("y"), x.alias("x"))
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, math.ceil(total.n * len(models) / TASK_ROWS))
    sent = sent.repartition(tasks, *keys, "block").sortWithinPartitions(*keys, "block", "record_id")
    kinds, n_keys = dict(records.dtypes), len(keys)
    schema = ", ".join([*[f"k{i} {kinds[k]}" for i, k in enumerate(keys)], "model_idx int", f"record_id {kinds['record_id']}", "in_train boolean", "p double"])
    out = sent.mapInArrow(lambda batches: resampled.scored(batches, n_keys, models, max_depth), schema).toDF(*keys, "model_idx", "record_id", "in_train", "p")
    out = out.select(*keys, "model_idx", "record_id", "in_train", logit(F.col("p")).alias("conf"))
    return out.unionByName(counted) if total.by_counts else out


def _from_counts(records: DataFrame, keys: list[str], n_models: int, max_depth: int, only: list[int] | None) -> DataFrame:
    """tree_confidences from counts by model, so that the rows of a key are in no single task."""
    sizes = records.groupBy(*keys).agg(F.count_if(F.col("is_member") == 1).alias("n_members"))
    sized = records.join(small_side(sizes), keys)
    sides = sampling.shadow_membership(sized, n_models, F.col("n_members"), keys=keys)
    sides = sides if only is None else sides.filter(F.col("model_idx").isin(*only))
    both = cut_lineage(sized.drop("n_members").join(sides, [*keys, "record_id"]))
    own = [*keys, "model_idx"]
    grown = trees.grow(both.filter("in_train"), own, max_depth)
    scored = trees.placed(trees.planted(both, grown, own), max_depth)
    conf = logit(F.coalesce(class_prob(F.col("probs"), F.col("y")), F.lit(0.0)))
    return scored.select(*own, "record_id", "in_train", conf.alias("conf"))
