"""What the score operators share: attack names by their spellings, and the latest finite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.session import broadcast_if_small, latest_rows


def folded(name: Column) -> Column:
    """A spelling without case and outer blanks."""
    return F.lower(F.trim(name))


def spelled(names: DataFrame) -> DataFrame:
    """(folded_spelling, known_attack), one row of each spelling; the smaller name wins if a spelling is listed twice."""
    known = names.filter(F.col("spelling").isNotNull() & F.col("attack_name").isNotNull())
    return known.groupBy(folded(F.col("spelling")).alias("folded_spelling")).agg(F.min("attack_name").alias("known_attack"))


def finite(value: Column) -> Column:
    """The value, or null for NaN."""
    return F.when(~F.isnan(value), value)


def latest_scores(scores: DataFrame, names: DataFrame) -> DataFrame:
    """(score_id, target_id, record_id, known_attack, member_prob) of the latest row of every score_id.

    Names are mapped before the shuffle, so only small columns travel; unmapped
    names and NaN become null but keep their row until the latest is known.
    Rows without a score_id are left out, as nothing says what they revise.
    """
    mapped = scores.filter(F.col("score_id").isNotNull()).select(
        "score_id", "target_id", "record_id", "ingested_at", finite(F.col("member_prob")).alias("member_prob"), folded(F.col("attack_name")).alias("folded_spelling")
    )
    mapped = mapped.join(broadcast_if_small(spelled(names)), "folded_spelling", "left").drop("folded_spelling")
    return latest_rows(mapped, "score_id").drop("ingested_at")
