"""Equivalence classes of records: k-anonymity, class disclosure and small groups.

A class is the records that share a key: a tree's leaf, the vector of leaves of a
forest, or the vector of probabilities. Two records fall into one leaf in every
tree exactly if their leaf vectors are equal, so grouping by the vector replaces
any comparison of pairs. Classes are counted by a map-side combined aggregate; only
class rows are joined back.

Defined results: records with a null key form no class and are left out; a class's
probabilities are those of its smallest record_id; an empty table gives no classes
and null global risks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.exprs import near_zero
from leakscope.session import small_side

#: Records of a class below which it is at risk.
THRESHOLD = 10


def classes(df: DataFrame, key: str | list[str], probs: str = "probs", record: str = "record_id") -> DataFrame:
    """(key, k, class_probs): the size of every class and the probabilities of its first record."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min_by(probs, record).alias("class_probs"))


def small_group(probs: Column, k: Column, threshold: int = THRESHOLD) -> Column:
    """Some label holds more than none but fewer than threshold records of the class."""
    return F.exists(probs, lambda p: (p * k > 0) & (p * k < threshold))


def class_risks(found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """classes with class_disclosure (a label with probability zero) and smallgroup_risk."""
    return found.withColumns({"class_disclosure": near_zero(F.col("class_probs")), "smallgroup_risk": small_group(F.col("class_probs"), F.col("k"), threshold)})


def record_risks(df: DataFrame, key: str | list[str], probs: str = "probs", record: str = "record_id", threshold: int = THRESHOLD) -> DataFrame:
    """(record, k_anonymity, class_disclosure, smallgroup_risk) of every record."""
    keys = [key] if isinstance(key, str) else list(key)
    risks = class_risks(classes(df, keys, probs, record), threshold).drop("class_probs")
    return df.select(record, *keys).join(small_side(risks), keys).select(record, F.col("k").alias("k_anonymity"), "class_disclosure", "smallgroup_risk")


def global_risks(found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row: smallest class, and whether any class is at risk."""
    return class_risks(found, threshold).agg(
        F.min("k").alias("min_k"),
        F.bool_or(F.col("k") < threshold).alias("k_anonymity_risk"),
        F.bool_or("class_disclosure").alias("class_disclosure_risk"),
        F.bool_or("smallgroup_risk").alias("smallgroup_risk"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def smallest_leaf(df: DataFrame, leaf: str | list[str], keys: list[str] | None = None) -> DataFrame:
    """One row (of every key): the k-anonymity of a tree (leaf) or forest (leaf columns or an array of leaves)."""
    leaves, keys = [leaf] if isinstance(leaf, str) else list(leaf), list(keys or [])
    return df.dropna(subset=leaves).groupBy(*keys, *leaves).agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.min("k").alias("k_anonymity"))
