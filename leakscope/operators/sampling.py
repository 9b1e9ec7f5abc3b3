"""Deterministic sampling and splitting by hashes of record ids.

Ranks by hash replace random generators: the same seed gives the same rows on any
cluster and after any retry. Exact numbers are taken by a threshold on the hash
found from counts, so no sample is sorted in one task.

Defined results: rows with a null id are never sampled; n beyond the rows takes all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.session import small_side

#: The hash is ranked in this many buckets before rows of one bucket are ranked themselves.
BUCKETS = 4_096


def hash_unit(record: Column, *seeds: int | Column) -> Column:
    """A number in [0, 1) from the hash of a record and seeds."""
    parts = [F.lit(s) if isinstance(s, int) else s for s in seeds]
    return F.pmod(F.xxhash64(record, *parts), F.lit(1 << 53)) / float(1 << 53)


def hash_sample(df: DataFrame, groups: list[str], n: Column, record: str, seed: Column | int = 0, unit: Column | None = None) -> DataFrame:
    """The n rows of smallest hash of every group; n is a column of the group (the same in all its rows). unit: numbers in [0, 1) to order by instead.

    Rows are counted by hash bucket. Buckets below the boundary are taken whole; only rows of
    the boundary bucket, about 1/BUCKETS of a group, are ranked by a window.
    """
    from pyspark.sql import Window

    hashed = df.filter(F.col(record).isNotNull()).withColumn("sample_hash", hash_unit(F.col(record), seed) if unit is None else unit).withColumn("sample_n", n)
    hashed = hashed.withColumn("sample_bucket", F.floor(F.col("sample_hash") * BUCKETS).cast("int"))
    counts = hashed.groupBy(*groups, "sample_bucket").agg(F.count(F.lit(1)).alias("bucket_rows"), F.max("sample_n").alias("bucket_n"))
    upto = Window.partitionBy(*groups).orderBy("sample_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("bucket_rows").over(upto))
    cut = counts.filter(F.col("upto") - F.col("bucket_rows") < F.col("bucket_n")).withColumn("room", F.col("bucket_n") - F.col("upto") + F.col("bucket_rows"))
    kept = hashed.join(small_side(cut.select(*groups, "sample_bucket", "room", "bucket_rows")), [*groups, "sample_bucket"])
    whole = kept.filter(F.col("room") >= F.col("bucket_rows"))
    part = kept.filter(F.col("room") < F.col("bucket_rows"))
    place = F.row_number().over(Window.partitionBy(*groups, "sample_bucket").orderBy("sample_hash", record))
    part = part.withColumn("place", place).filter(F.col("place") <= F.col("room")).drop("place")
    return whole.unionByName(part).select(*df.columns)


def shadow_membership(records: DataFrame, n_models: int, n_train: int | Column, record: str = "record_id", keys: list[str] | None = None, unit: Column | None = None) -> DataFrame:
    """(keys, model_idx, record, in_train) of every shadow model: n_train of all records (of the key) without replacement."""
    keys = list(keys or [])
    n = F.lit(n_train) if isinstance(n_train, int) else n_train
    models = records.select(*keys, record, n.alias("n_train")).withColumn("model_idx", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))))
    chosen = hash_sample(models, [*keys, "model_idx"], F.col("n_train"), record, F.col("model_idx"), unit).drop("n_train").withColumn("in_train", F.lit(True))
    return models.join(chosen, [*keys, record, "model_idx"], "left").select(*keys, "model_idx", record, F.coalesce("in_train", F.lit(False)).alias("in_train"))


def stratified_split(df: DataFrame, strata: list[str], test_share: float, record: str, seed: Column | int = 0, groups: list[str] | None = None, unit: Column | None = None) -> DataFrame:
    """df with in_test: the ceil(share) rows of smallest hash of each stratum (within each group)."""
    keys = [*(groups or []), *strata]
    sizes = df.filter(F.col(record).isNotNull()).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * test_share).alias("stratum_n"))
    sized = df.join(small_side(sizes), keys)
    test = hash_sample(sized, keys, F.col("stratum_n"), record, seed, unit).select(*(groups or []), record).withColumn("in_test", F.lit(True))
    return df.join(test, [*(groups or []), record], "left").withColumn("in_test", F.coalesce("in_test", F.lit(False)))


def repeated_splits(df: DataFrame, strata: list[str], test_share: float, record: str, seeds: list[int], unit: Column | None = None) -> DataFrame:
    """One stratified split per seed, under the column rep."""
    reps = df.withColumn("rep", F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])))
    reps = reps.select("*", F.col("rep.no").alias("rep_no"), F.col("rep.seed").alias("rep_seed")).drop("rep")
    return stratified_split(reps, strata, test_share, record, F.col("rep_seed"), ["rep_no"], unit).withColumnRenamed("rep_no", "rep").drop("rep_seed")


def split_seeds(seed: int | list[int], n: int) -> list[int]:
    """Seeds of n repetitions: an integer is followed by squares of its successors; a list is made unique,
    cut to n, or continued by multiples of its last."""
    if isinstance(seed, int):
        return [seed, *[x * x for x in range(seed, seed + n - 1)]][:n]
    unique = list(dict.fromkeys(seed))[:n]
    return unique + [unique[-1] * (i + 2) for i in range(n - len(unique))] if unique else list(range(n))


def dummy_columns(u: Column, side: Column, is_member: Column, beta_member: float = 1.0, beta_other: float = 1.0) -> tuple[Column, Column]:
    """s0 and s1 of a guess: a confidence from Beta(1, beta) of the record's side, by its inverse distribution function, for a class at random."""
    top = 1 - F.when(is_member == 1, F.pow(1 - u, F.lit(1.0 / beta_member))).otherwise(F.pow(1 - u, F.lit(1.0 / beta_other)))
    s1 = F.when(side < 0.5, top).otherwise(1 - top)
    return 1 - s1, s1


def dummy_scores(spark, n_pos: int, n_neg: int, n_reps: int, beta_member: float = 1.0, beta_other: float = 1.0, seed: int = 0) -> DataFrame:
    """A baseline that knows nothing: per rep, member scores from Beta(1, beta) of either side and classes at random."""
    rows = spark.range(n_pos + n_neg).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))))
    u, side = hash_unit(F.col("id"), F.col("rep"), seed), hash_unit(F.col("id"), F.col("rep"), seed + 1)
    member = (F.col("id") < n_pos).cast("int")
    s0, s1 = dummy_columns(u, side, member, beta_member, beta_other)
    return rows.select("rep", F.col("id").alias("record_id"), member.alias("is_member"), s0.alias("s0"), s1.alias("s1"))


def laplace_noise(u: Column, scale: float) -> Column:
    """Laplace noise from a uniform number, by the inverse distribution function."""
    centred = u - 0.5
    return -scale * F.signum(centred) * F.log(1 - 2 * F.abs(centred))


def gaussian_noise(u: Column, v: Column, scale: float) -> Column:
    """Normal noise from two uniform numbers, the first above 0."""
    return scale * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
