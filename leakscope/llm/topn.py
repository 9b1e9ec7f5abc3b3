"""The N best items of every group.

A row_number window ordered by score and identifiers carries a rank filter; the
optimiser turns the pair into a group limit that keeps N rows of a group in
every partition before the shuffle and again after it. So a group of any size,
a third of all rows included, reaches the final task as at most N rows of each
partition.

Defined results: null and NaN scores and null groups are left out; equal scores
are ordered by the smaller record_id, then the smaller score_id (nulls last);
groups with fewer items give all they have; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.scores import finite, latest_scores

TOP = 5


def top_items(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int = TOP, rank: str = "item_rank") -> DataFrame:
    """The n rows of highest score of every group, with their rank from 1."""
    order: list[Column] = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    kind = dict(df.dtypes)[score]
    known = df.filter(F.col(score).isNotNull() if kind not in ("double", "float") else finite(F.col(score)).isNotNull())
    for g in groups:
        known = known.filter(F.col(g).isNotNull())
    return known.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def top_scores(scores: DataFrame, names: DataFrame, n: int = TOP) -> DataFrame:
    """(target_id, attack_name, score_id, record_id, member_prob, item_rank): the n highest member_prob of every target and attack."""
    latest = latest_scores(scores, names).withColumnRenamed("known_attack", "attack_name")
    return top_items(latest, ["target_id", "attack_name"], "member_prob", ["record_id", "score_id"], n)
