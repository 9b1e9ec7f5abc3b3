"""Mixing sources to target shares of all tokens, with a cap on how often a document repeats.

Sizes are tokens of a public tokenizer, counted once. A source that is to give a
multiple c of its tokens uses each of its documents floor(c) times; the fraction
that remains is a copy probability, equal for all its documents. Pivotal rounding
makes these probabilities whole: two documents at a time, mass is moved from one
to the other at random, keeping both expectations and the expected tokens of the
pair, until one of them is 0 or 1; the other goes on. So a group of documents
leaves at most one open document of a source, and the source's tokens never move
by more than that document holds.

The groups are the leaves of a reduction tree: documents are spread by hash over
groups of about LEAF_DOCUMENTS (a hot source over all of them), each is streamed
through with one open document in memory, and the open documents of FAN groups
are joined in the next level, until one group is left. All randomness comes from
hashes of ids and a seed: a task that is run again decides the same.

How much is mixed: by default the largest total at which every source that has
documents reaches its share within its cap, shares being taken among those
sources. With a larger total, sources at their cap give all they can, the rest is
divided among the others by their shares, and the report says who fell short.

Defined results: documents of unlisted or null sources, and those without a token
(null, empty texts), are not used; a share of 0 or null uses nothing; max_repeats
null or below 1 allows nothing; a source listed twice counts with the sum of its
shares and the smaller cap; without documents or shares the mixture is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.tokens import BYTE_BPE_50K, count_tokens
from leakscope.session import BROADCAST_ROWS, cut_lineage

LEAF_DOCUMENTS, FAN, SEED = 20_000, 64, 20_240_501
_OPEN = 1e-9


def amounts(sources: list[dict], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives. sources: dicts of source, share, cap, tokens (available)."""
    able = {s["source"]: s for s in sources if s["share"] > 0 and s["cap"] >= 1 and s["tokens"] > 0}
    if not able:
        return {}
    whole = sum(s["share"] for s in able.values())
    most = {k: s["cap"] * s["tokens"] for k, s in able.items()}
    if total is None:
        total = min(most[k] / (s["share"] / whole) for k, s in able.items())
    given: dict[str, float] = {}
    free = dict(able)
    while free:
        left, shares = total - sum(given.values()), sum(s["share"] for s in free.values())
        full = [k for k, s in free.items() if left * s["share"] / shares > most[k]]
        if not full:
            given |= {k: max(0.0, left) * s["share"] / shares for k, s in free.items()}
            break
        for k in full:
            given[k] = float(most[k])
            del free[k]
    return given


class _Pivot:
    """One stream of documents of a group and source; holds the open document."""

    def __init__(self):
        self.open: tuple | None = None

    def add(self, key, tokens: int, p: float, chance: float) -> Iterator[tuple]:
        """Take a document; yield those that are decided, as (key, tokens, p)."""
        if p < _OPEN or p > 1 - _OPEN:
            yield key, tokens, float(round(p))
            return
        if self.open is None:
            self.open = key, tokens, p
            return
        key_i, t_i, p_i = self.open
        ratio = tokens / t_i
        up, down = min(1 - p_i, p * ratio), min(p_i, (1 - p) * ratio)
        move = up if chance * (up + down) < down else -down
        both = (key_i, t_i, p_i + move), (key, tokens, p - move / ratio)
        self.open = None
        for one in both:
            if _OPEN < one[2] < 1 - _OPEN:
                self.open = one
            else:
                yield one[0], one[1], float(round(one[2]))


def _round_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream rows sorted by group and source; decided rows have p 0 or 1, open ones keep their p."""
    at, pivot = None, _Pivot()
    columns = ["doc_id", "source", "n_tokens", "p", "grp"]
    for frame in frames:
        out = []
        for key, source, tokens, p, group, chance in zip(frame.doc_id, frame.source, frame.n_tokens, frame.p, frame.grp, frame.chance, strict=True):
            if at != (group, source):
                if pivot.open:
                    out.append((pivot.open[0], at[1], pivot.open[1], pivot.open[2], at[0]))
                at, pivot = (group, source), _Pivot()
            out += [(k, source, t, q, group) for k, t, q in pivot.add(key, tokens, p, chance)]
        yield pd.DataFrame(out, columns=columns)
    if pivot.open:
        yield pd.DataFrame([(pivot.open[0], at[1], pivot.open[1], pivot.open[2], at[0])], columns=columns)


def pivotal_rounding(items: DataFrame, n_items: int, seed: int = SEED) -> DataFrame:
    """items (doc_id, source, n_tokens, p) with every p made 0 or 1 by the reduction tree."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select("doc_id", "source", "n_tokens").schema) + ", p double, grp bigint"
    groups = max(1, math.ceil(n_items / LEAF_DOCUMENTS))
    level = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))
    decided = None
    depth = 0
    while True:
        chance = (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(depth + 1)), F.lit(1 << 53)) / float(1 << 53)).alias("chance")
        ordered = level.select("doc_id", "source", "n_tokens", "p", "grp", chance).repartition("grp").sortWithinPartitions("grp", "source", "chance", "doc_id")
        done = cut_lineage(ordered.mapInPandas(_round_groups, schema))
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        part = done.filter(whole).select("doc_id", "source", "n_tokens", "p")
        decided = part if decided is None else decided.unionByName(part)
        level = done.filter(~whole).withColumn("grp", F.floor(F.col("grp") / FAN).cast("bigint"))
        if groups == 1:
            break
        groups, depth = math.ceil(groups / FAN), depth + 1
    # at most one open document of a source is left
    last = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(-1)), F.lit(1 << 53)) / float(1 << 53)
    return decided.unionByName(level.select("doc_id", "source", "n_tokens", F.when(last < F.col("p"), 1.0).otherwise(0.0).alias("p")))


def _listed(mix: DataFrame) -> DataFrame:
    listed = mix.filter("source is not null").groupBy("source").agg(
        F.sum(F.coalesce(F.col("target_share"), F.lit(0.0))).alias("target_share"), F.min(F.coalesce(F.col("max_repeats"), F.lit(0))).alias("max_repeats")
    )
    if listed.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"a mixture of more than {BROADCAST_ROWS} sources")
    return listed


def mixture(documents: DataFrame, mix: DataFrame, total: float | str | None = None, vocabulary: str = BYTE_BPE_50K, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents used (doc_id, source, n_tokens, copies), and the report of every listed source
    (source, target_share, max_repeats, n_documents, available_tokens, n_used, copies, tokens, actual_share, reached).

    total: tokens of the mixture, or "available" for as many as the listed sources have; by default
    the largest total at which every source that has documents reaches its share.
    """
    spark = documents.sparkSession
    sizes = cut_lineage(count_tokens(documents, "doc_id", "text", vocabulary, keep=("source",)).filter("source is not null and n_tokens > 0"))
    supply = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("available_tokens"))
    listed = cut_lineage(_listed(mix).join(supply, "source", "left").fillna(0, ["n_documents", "available_tokens"]))
    rows = listed.collect()  # one row of each listed source, BROADCAST_ROWS at most
    if total == "available":
        total = float(sum(r.available_tokens for r in rows))
    given = amounts([{"source": r.source, "share": r.target_share, "cap": r.max_repeats, "tokens": r.available_tokens} for r in rows], total)
    stock = {r.source: r for r in rows}
    times = {s: tokens / stock[s].available_tokens for s, tokens in given.items()}
    plan = [(s, min(int(c + _OPEN), stock[s].max_repeats), max(0.0, c - int(c + _OPEN))) for s, c in times.items()]
    wanted = F.broadcast(spark.createDataFrame(plan or [("", 0, 0.0)], "source string, base int, p double"))
    items = sizes.join(wanted, "source")
    loose = items.filter(F.col("p") > _OPEN)
    extra = pivotal_rounding(loose.select("doc_id", "source", "n_tokens", "p"), sum(stock[s].n_documents for s, _, p in plan if p > _OPEN), seed)
    even = items.filter(F.col("p") <= _OPEN).select("doc_id", "source", "n_tokens", F.lit(0.0).alias("p"))
    used = extra.unionByName(even).join(wanted.drop("p"), "source").withColumn("copies", (F.col("base") + F.col("p")).cast("int"))
    used = cut_lineage(used.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies"))
    sums = used.groupBy("source").agg(F.count(F.lit(1)).alias("n_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    report = listed.join(F.broadcast(sums), "source", "left").fillna(0, ["n_used", "copies", "tokens"])
    whole = report.agg(F.sum("tokens").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)).drop("whole")
    reached = F.col("actual_share") >= F.col("target_share") - 0.005
    return used, report.withColumn("reached", reached)
