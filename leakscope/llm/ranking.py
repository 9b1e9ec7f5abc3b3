"""One order from scores of different units, ranges and spreads: relative closeness to an ideal point.

Every score of a group (here: a target) is winsorised at its outer quantiles,
centred, and divided by the length of its vector over the group, so each score
brings the same sum of squares whatever its unit. A record's distances to the
best and to the worst value of every score give its relative closeness
worst / (best + worst), by which the records are sorted.

The plain method divides without centring. Then a score that lies far from zero
(log densities around -400, say) would hardly count, as its vector's length is
mostly its offset; centring first is what makes the say of all scores equal.

Defined results: records that lack one of the scores take no part; a score that
is the same for all records of the group decides nothing; equal closeness (to
12 digits) is ordered by how far the values lie beyond the cuts, then by the smaller
identifier; groups without a full record
give no rows; repeated rows must be made unique beforehand (see the callers).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.scores import latest_scores
from leakscope.operators import metrics
from leakscope.session import broadcast_if_small, cut_lineage, latest_rows, small_side

#: Share of a group's values that is pulled in at either end.
TAIL = 0.1


@dataclass(frozen=True)
class Score:
    """A numeric column; larger means more exposed unless smaller_first."""

    column: str
    smaller_first: bool = False
    weight: float = 1.0
    #: A flag or a small scale has no outliers to pull in, and its rare level may be what matters.
    winsorise: bool = True


def order_cuts(df: DataFrame, group: str, columns: dict[str, str], tail: float) -> DataFrame:
    """(group, cut_<name> of each column): the smallest values that tail and 1 - tail of the group's rows do not exceed, as an array of two."""
    values = df.select(group, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("s1")) for n, c in columns.items()])).alias("v")).select(group, "v.name", "v.s1")
    counts = cut_lineage(values.groupBy(group, "name", "s1").agg(F.count(F.lit(1)).alias("p"), F.lit(0).cast("bigint").alias("n")))
    below = F.col("total_p") - F.col("cum_p") + F.col("p")  # rows up to and with this value
    rank = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total_p")))
    cut = lambda share: F.min(F.when(below >= rank(share), F.col("s1")))
    found = metrics.running_counts(counts, [group, "name"]).groupBy(group, "name").agg(F.array(cut(tail), cut(1 - tail)).alias("cut"))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("name") == n, F.col("cut"))).alias(f"cut_{n}") for n in columns])


def closeness(df: DataFrame, group: str, scores: list[Score], tail: float = TAIL) -> DataFrame:
    """df with `closeness` in [0, 1], 1 being the ideal point, and `beyond`; rows lacking a score are left out.

    `beyond` keeps the order among records that winsorising makes equal: over the scores, the
    weighted sum of e / (1 + |e|), e being what was pulled in, in standard deviations. So no single
    outlier decides, and a score that decides nothing does not count.

    Cuts are exact order statistics from running counts of distinct values, so they do not depend
    on the partitioning; sums, squares and bounds are aggregates combined before their shuffle. A
    group of any size is never gathered in one task.
    """
    full = df
    for s in scores:
        full = full.filter(F.col(s.column).isNotNull())
    signed = {s.column: (-1.0 if s.smaller_first else 1.0) * F.col(s.column).cast("double") for s in scores}
    full = full.withColumns({f"say_{s.column}": signed[s.column] for s in scores})
    pulled = [s.column for s in scores if s.winsorise]
    held = full.join(small_side(order_cuts(full, group, {c: f"say_{c}" for c in pulled}, tail)), group) if pulled else full
    held = held.withColumns({f"raw_{s.column}": F.col(f"say_{s.column}") for s in scores})
    held = held.withColumns(
        {f"say_{s.column}": F.greatest(F.col(f"cut_{s.column}")[0], F.least(F.col(f"cut_{s.column}")[1], F.col(f"say_{s.column}"))) for s in scores if s.winsorise}
    ).drop(*[f"cut_{s.column}" for s in scores])
    shape = held.groupBy(group).agg(
        *[
            F.struct(
                F.avg(f"say_{s.column}").alias("centre"),
                (F.stddev_pop(f"say_{s.column}") * F.sqrt(F.count(F.lit(1)))).alias("length"),
                F.min(f"say_{s.column}").alias("worst"),
                F.max(f"say_{s.column}").alias("best"),
                F.stddev_pop(f"say_{s.column}").alias("spread"),
            ).alias(f"shape_{s.column}")
            for s in scores
        ]
    )
    placed = held.join(small_side(shape), group)

    def distance(to: str):
        parts = []
        for s in scores:
            length = F.col(f"shape_{s.column}.length")
            gap = F.when(length > 1e-12, s.weight * (F.col(f"say_{s.column}") - F.col(f"shape_{s.column}.{to}")) / length).otherwise(0.0)
            parts.append(gap * gap)
        return F.sqrt(sum(parts[1:], parts[0]))

    best, worst = distance("best"), distance("worst")
    near = F.when(best + worst > 0, worst / (best + worst)).otherwise(0.5)
    over = []
    for s in scores:
        e = (F.col(f"raw_{s.column}") - F.col(f"say_{s.column}")) / F.col(f"shape_{s.column}.spread")
        over.append(F.when(F.col(f"shape_{s.column}.length") > 1e-12, s.weight * e / (1 + F.abs(e))).otherwise(0.0))
    placed = placed.withColumns({"closeness": F.round(near, 12), "beyond": F.round(sum(over[1:], over[0]), 12)})
    return placed.drop(*[f"{p}_{s.column}" for p in ("say", "raw", "shape") for s in scores])


def ranked(df: DataFrame, group: str, item: str, scores: list[Score], limit: str | None = None, tail: float = TAIL) -> DataFrame:
    """(group, item, closeness, place) in one order per group; with limit, only the first rows of that column's number.

    The largest limit is read first and stated in the filter, so the optimiser prunes every
    group to that many rows before and after the shuffle.
    """
    order = Window.partitionBy(group).orderBy(F.col("closeness").desc(), F.col("beyond").desc(), F.col(item))
    out = closeness(df, group, scores, tail).withColumn("place", F.row_number().over(order))
    if limit:
        most = df.agg(F.max(limit)).first()[0] or 0
        out = out.filter(F.col("place") <= most).filter(F.col("place") <= F.col(limit))
    return out.select(group, item, "closeness", "place")


AUDIT_SCORES = [
    Score("lira_prob"),
    Score("qmia_prob"),
    Score("k_anonymity", smaller_first=True),
    Score("smallgroup", winsorise=False),
]


def audit_frame(scores: DataFrame, names: DataFrame, structural: DataFrame, requests: DataFrame) -> DataFrame:
    """(target_id, record_id, top_n, lira_prob, qmia_prob, k_anonymity, smallgroup) of the requested targets.

    Only requested targets are read into the shuffles: an entry's target does not
    change when it is delivered again. Several entries of one attack and record
    count with their mean. A target requested twice keeps its larger top_n.
    """
    wanted = requests.filter(F.col("target_id").isNotNull()).groupBy("target_id").agg(F.max("top_n").alias("top_n"))
    wanted = broadcast_if_small(wanted)
    latest = latest_scores(scores.join(wanted.select("target_id"), "target_id", "left_semi"), names)
    mean = latest.filter(F.col("known_attack").isin("LiRA Attack", "QMIA Attack") & F.col("member_prob").isNotNull())
    mean = mean.groupBy("target_id", "record_id").agg(
        F.avg(F.when(F.col("known_attack") == "LiRA Attack", F.col("member_prob"))).alias("lira_prob"),
        F.avg(F.when(F.col("known_attack") == "QMIA Attack", F.col("member_prob"))).alias("qmia_prob"),
    )
    state = structural.join(wanted.select("target_id"), "target_id", "left_semi")
    state = latest_rows(state.select("target_id", "record_id", "ingested_at", "k_anonymity", F.col("smallgroup_risk").cast("int").alias("smallgroup")), ["target_id", "record_id"])
    return mean.join(state.drop("ingested_at"), ["target_id", "record_id"]).join(wanted, "target_id")


def exposed_records(scores: DataFrame, names: DataFrame, structural: DataFrame, requests: DataFrame) -> DataFrame:
    """(target_id, record_id, closeness, place): the first top_n records of every requested target."""
    frame = cut_lineage(audit_frame(scores, names, structural, requests))  # a row of a requested record; read by four aggregates
    return ranked(frame, "target_id", "record_id", AUDIT_SCORES, limit="top_n")
