"""The metric engine: membership-inference metrics of every attack run at once.

Input is the long table `scored`: key columns, record_id, is_member (1 or 0), s0 and
s1 (scores of non-member and member; any monotone score). Records are counted by
distinct score first; ranking metrics, the ROC and the AUC then come from running
counts over distinct scores. A run with very many distinct scores is cut into score
ranges whose running counts are local, with the counts of the ranges before added,
so no run is sorted in one task. The frequencies of the outermost records come from
the same counts; single records are ordered only within the tie at the boundary.

Defined results: rows with a null key, label or score and with NaN are left out
(`scored` checks shapes); ties of the outermost records are ordered by record_id;
a rate whose denominator is 0 is null, and so are metrics derived from it; far,
ppv, npv and f1 are 0 then; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions.exprs import ratio, safe_div
from leakscope.functions.stats import neg_log, upper_ps
from leakscope.session import broadcast_if_small, cut_lineage, small_side

#: Shares of outermost records, and the false-positive rates (in percent) at which the ROC is read.
SHARES = {"01": 0.1, "02": 0.2, "001": 0.01}
FPR_PERCENT = (0.5, 0.2, 0.1, 0.01, 0.001, 0.00001)
#: Distinct scores of a run up to which one window is used; ranges a larger run is cut into.
ONE_WINDOW, RANGES = 2_000_000, 256


def scored(df: DataFrame, keys: list[str], record: str, member: Column, s0: Column, s1: Column) -> DataFrame:
    """The engine's input from any frame; rows that cannot be scored are dropped."""
    out = df.select(*keys, F.col(record).alias("record_id"), member.cast("int").alias("is_member"), s0.cast("double").alias("s0"), s1.cast("double").alias("s1"))
    return out.dropna(subset=[*keys, "is_member", "s1"]).filter(~F.isnan("s1"))


def from_score_array(df: DataFrame, keys: list[str], record: str, member: Column, scores: str) -> DataFrame:
    """`scored` from an array of two scores; any other shape is an error."""
    kind = dict(df.dtypes)[scores]
    if not kind.startswith("array"):
        raise ValueError(f"y_pred: column {scores} holds no arrays of two scores")
    checked = F.when(F.size(scores) == 2, F.col(scores)).otherwise(F.raise_error(F.lit("multiclass scores are unsupported: two scores per record are needed")).cast("array<double>"))
    df = df.withColumn("two_scores", checked)
    return scored(df, keys, record, member, F.col("two_scores")[0], F.col("two_scores")[1])


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, tn, fn and counts per run; a record is called a member if s1 > s0 (a tie is not)."""
    called, truth = F.col("s1") > F.col("s0"), F.col("is_member") == 1
    return df.groupBy(*keys).agg(
        F.count_if(called & truth).alias("tp"),
        F.count_if(called & ~truth).alias("fp"),
        F.count_if(~called & ~truth).alias("tn"),
        F.count_if(~called & truth).alias("fn"),
        F.count_if(truth).alias("n_pos"),
        F.count_if(~truth).alias("n_neg"),
        F.var_pop("s1").alias("pred_prob_var"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Rates to 8 digits from the counts of a confusion."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns(
        {
            "tpr": ratio(tp, tp + fn),
            "fpr": ratio(fp, fp + tn),
            "far": safe_div(fp, fp + tp),
            "tnr": ratio(tn, tn + fp),
            "ppv": safe_div(tp, tp + fp),
            "npv": safe_div(tn, tn + fn),
            "fnr": ratio(fn, tp + fn),
            "acc": ratio(tp + tn, tp + fp + tn + fn),
        }
    )
    return out.withColumns({"f1score": safe_div(2 * F.col("ppv") * F.col("tpr"), F.col("ppv") + F.col("tpr")), "advantage": F.abs(F.col("tpr") - F.col("fpr"))})


def score_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Members and non-members at each distinct score."""
    return df.groupBy(*keys, "s1").agg(F.sum("is_member").alias("p"), F.sum(1 - F.col("is_member")).alias("n"))


def running_counts(counts: DataFrame, keys: list[str], one_window: int = ONE_WINDOW, ranges: int = RANGES, score: str = "s1") -> DataFrame:
    """counts with cum_p, cum_n (from the highest score down, inclusive), total_p, total_n. Read several times: hand over a written frame."""
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("total_p"), F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("n_scores"))
    most = totals.agg(F.max("n_scores")).first()[0] or 0
    down = lambda *by: Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    if most <= one_window:
        out = counts.withColumns({"cum_p": F.sum("p").over(down(*keys)), "cum_n": F.sum("n").over(down(*keys))})
        whole = Window.partitionBy(*keys)
        return out.withColumns({"total_p": F.sum("p").over(whole), "total_n": F.sum("n").over(whole)})
    # two levels: ranges of about equal numbers of scores, then the sums of the ranges above
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(score, steps, 10 * ranges).alias("cuts"))
    placed = _joined(counts, cuts, keys).withColumn("range_no", F.size(F.filter("cuts", lambda c: c < F.col(score)))).drop("cuts")
    sums = placed.groupBy(*keys, "range_no").agg(F.sum("p").alias("range_p"), F.sum("n").alias("range_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("range_no")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "range_no", F.coalesce(F.sum("range_p").over(above), F.lit(0)).alias("above_p"), F.coalesce(F.sum("range_n").over(above), F.lit(0)).alias("above_n"))
    out = placed.join(small_side(sums), [*keys, "range_no"])
    local = down(*keys, "range_no")
    out = out.withColumns({"cum_p": F.col("above_p") + F.sum("p").over(local), "cum_n": F.col("above_n") + F.sum("n").over(local)})
    return _joined(out, totals.drop("n_scores"), keys).select(*keys, score, "p", "n", "cum_p", "cum_n", "total_p", "total_n")


def _joined(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of one row per run."""
    return df.join(small_side(small), keys) if keys else df.crossJoin(F.broadcast(small))


def _area() -> Column:
    """Aggregate: the exact area under the ROC to 8 digits."""
    pairs = F.max("total_p").cast("double") * F.max("total_n")
    return F.bround(F.sum(F.col("n") * (F.col("cum_p") - F.col("p") / 2.0)) / F.when(pairs > 0, pairs), 8)


def auc(running: DataFrame, keys: list[str], counts: bool = False) -> DataFrame:
    """Exact area under the ROC, ties counting half; null without members or non-members. With counts also n_pos and n_neg."""
    more = [F.max("total_p").alias("n_pos"), F.max("total_n").alias("n_neg")] if counts else []
    return running.groupBy(*keys).agg(_area().alias("auc"), *more)


def roc(running: DataFrame, keys: list[str], drop_collinear: bool = True) -> DataFrame:
    """(keys, fpr, tpr, threshold) of every vertex; (0, 0) with threshold 1 first. Collinear vertices are dropped."""
    # the score below is the one whose rows begin where those of this one end: a join instead of a window over the run
    size, upto = F.col("p") + F.col("n"), F.col("cum_p") + F.col("cum_n")
    below = running.select(*keys, (upto - size).alias("upto"), F.col("p").alias("next_p"), F.col("n").alias("next_n"))
    kept = running.withColumn("upto", upto).join(below, [*keys, "upto"], "left")
    if drop_collinear:
        kept = kept.filter((F.col("upto") == size) | F.col("next_p").isNull() | (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n")))
    rate = lambda c, of: F.col(c) / F.when(F.col(of) > 0, F.col(of))
    vertices = kept.select(*keys, rate("cum_n", "total_n").alias("fpr"), rate("cum_p", "total_p").alias("tpr"), F.col("s1").alias("threshold"))
    start = running.select(*keys).distinct().select(*keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(1.0).alias("threshold"))
    return start.unionByName(vertices)


def tpr_name(percent: float) -> str:
    return "tpr_at_" + f"{percent:g}".replace(".", "_").replace("-", "m")


def _interpolated(fpr: Column, tpr: Column, at: Column) -> Column:
    """Aggregate: the ROC at a false-positive rate; 0 before the first vertex."""
    low_f, low_t = F.max(F.when(fpr <= at, fpr)), F.max(F.when(fpr <= at, tpr))
    high_f, high_t = F.min(F.when(fpr > at, fpr)), F.min(F.when(fpr > at, tpr))
    inside = low_t + (F.max(at) - low_f) / (high_f - low_f) * (high_t - low_t)
    return F.when(low_f.isNull(), F.lit(0.0)).when(high_f.isNull(), low_t).otherwise(inside)


def tpr_at_fpr(running: DataFrame, keys: list[str], percents: tuple[float, ...] = FPR_PERCENT) -> DataFrame:
    """True-positive rate at false-positive rates given in percent, between vertices by interpolation."""
    fpr, tpr = F.col("cum_n") / F.when(F.col("total_n") > 0, F.col("total_n")), F.col("cum_p") / F.when(F.col("total_p") > 0, F.col("total_p"))
    return running.groupBy(*keys).agg(*[_interpolated(fpr, tpr, F.lit(p / 100)).alias(tpr_name(p)) for p in percents])


def outermost(df: DataFrame, running: DataFrame, keys: list[str], shares: dict[str, float] = SHARES) -> DataFrame:
    """fmax, fmin, fdif per share: frequency of members among the ceil(n x) records of highest and lowest score."""
    both = running.withColumns(
        {
            "size": F.col("p") + F.col("n"),
            "down": F.col("cum_p") + F.col("cum_n"),
            "whole": F.col("total_p") + F.col("total_n"),
        }
    )
    both = both.withColumn("up", F.col("whole") - F.col("down") + F.col("size"))
    # only scores that some share reaches from either side go on
    most = F.ceil(F.col("whole") * max(shares.values()))
    outer = both.filter((F.col("down") - F.col("size") < most) | (F.col("up") - F.col("size") < most))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), F.lit(x).alias("x"), F.lit(side).alias("side")) for name, x in shares.items() for side in ("max", "min")]))
    cut = outer.select(*keys, "s1", "p", "size", "down", "up", "whole", wanted.alias("w")).select("*", "w.*").drop("w")
    reach = F.when(F.col("side") == "max", F.col("down")).otherwise(F.col("up"))
    cut = cut.withColumns({"k": F.ceil(F.col("whole") * F.col("x")), "reach": reach})
    cut = cut_lineage(cut.filter(F.col("reach") - F.col("size") < F.col("k")).drop("down", "up", "whole", "x"))
    full = cut.groupBy(*keys, "share", "side").agg(F.max("k").alias("k"), F.sum(F.when(F.col("reach") <= F.col("k"), F.col("p")).otherwise(0)).alias("members"))
    ties = cut.filter(F.col("reach") > F.col("k")).select(*keys, "s1", "share", "side", "size", (F.col("k") - F.col("reach") + F.col("size")).alias("room"))
    largest = ties.agg(F.max("size")).first()[0] or 0
    inside = df.select(*keys, "s1", "record_id", "is_member").join(broadcast_if_small(ties), [*keys, "s1"])
    own = [*keys, "share", "side"]
    first = F.when(F.col("side") == "max", F.col("record_id")).otherwise(-F.col("record_id"))
    if largest <= ONE_WINDOW:
        inside = inside.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(first.desc()))).filter(F.col("place") <= F.col("room"))
        some = inside.groupBy(*own).agg(F.sum("is_member").alias("tied"))
    else:
        # a tie of very many records is ordered by running counts over ranges of record_id
        counts = inside.groupBy(*own, first.alias("first")).agg(F.sum("is_member").alias("p"), F.sum(1 - F.col("is_member")).alias("n"))
        ordered = running_counts(cut_lineage(counts), own, score="first").join(broadcast_if_small(ties.select(*own, "room")), own)
        left = F.col("room") - (F.col("cum_p") + F.col("cum_n") - F.col("p") - F.col("n"))
        some = ordered.filter(left > 0).groupBy(*own).agg(F.sum(F.least(F.col("p"), left)).alias("tied"))
    freq = full.join(some, [*keys, "share", "side"], "left").withColumn("freq", (F.col("members") + F.coalesce("tied", F.lit(0))) / F.col("k"))
    pick = lambda share, side: F.max(F.when((F.col("share") == share) & (F.col("side") == side), F.col("freq")))
    out = freq.groupBy(*keys).agg(*[pick(s, side).alias(f"f{side}{s}") for s in shares for side in ("max", "min")])
    return out.withColumns({f"fdif{s}": F.col(f"fmax{s}") - F.col(f"fmin{s}") for s in shares})


def null_auc_variance(area: Column, n_pos: Column, n_neg: Column) -> Column:
    """Variance of the AUC at a given area under independence."""
    product = n_pos.cast("double") * n_neg
    spread = area * (1 - area) + (n_pos - 1) * (1 / 3 - area * area) + (n_neg - 1) * (1 / 3 - area * area)
    return spread / F.when(product > 0, product)


def auc_z(area: Column, n_pos: Column, n_neg: Column) -> Column:
    """An AUC above one half in standard deviations under independence."""
    return (area - 0.5) / F.sqrt(null_auc_variance(F.lit(0.5), n_pos, n_neg))


def difference_z(fdif: Column, n_pos: Column, n_neg: Column, share: float) -> Column:
    """A frequency difference in standard deviations under independence; null where there are none."""
    whole = n_pos + n_neg
    freq = n_pos / F.when(whole > 0, whole)
    sd = F.sqrt(2 * freq * (1 - freq) / F.ceil(whole * share))
    return fdif / F.when(sd > 0, sd)


def metrics(df: DataFrame, keys: list[str], p_values: bool = True) -> DataFrame:
    """All metrics of every run in one row. p_values adds p_higher_auc and the pdif columns.

    The input is read once and reduced to one row of each distinct score, which is written
    down; running counts and one aggregate by run give all but the ties at the boundary of the
    outermost records, for which the input is read again through a join with those few scores.
    """
    keys = list(keys)
    called = F.col("s1") > F.col("s0")
    counts = df.groupBy(*keys, "s1").agg(
        F.sum("is_member").alias("p"),
        F.sum(1 - F.col("is_member")).alias("n"),
        F.count_if(called & (F.col("is_member") == 1)).alias("called_p"),
        F.count_if(called & (F.col("is_member") == 0)).alias("called_n"),
    )
    counts = cut_lineage(counts)
    running = running_counts(counts.drop("called_p", "called_n"), keys)
    size = F.col("p") + F.col("n")
    mean = counts.groupBy(*keys).agg((F.sum(F.col("s1") * size) / F.sum(size)).alias("mean_s1"))
    spread = counts.join(mean, keys) if keys else counts.crossJoin(mean)
    gap = F.col("s1") - F.col("mean_s1")
    confused = spread.groupBy(*keys).agg(
        F.sum("called_p").alias("tp"),
        F.sum("called_n").alias("fp"),
        F.sum(F.col("n") - F.col("called_n")).alias("tn"),
        F.sum(F.col("p") - F.col("called_p")).alias("fn"),
        F.sum("p").alias("n_pos"),
        F.sum("n").alias("n_neg"),
        (F.sum(gap * gap * size) / F.sum(size)).alias("pred_prob_var"),
    )
    fpr, tpr = F.col("cum_n") / F.when(F.col("total_n") > 0, F.col("total_n")), F.col("cum_p") / F.when(F.col("total_p") > 0, F.col("total_p"))
    curve = running.groupBy(*keys).agg(_area().alias("auc"), *[_interpolated(fpr, tpr, F.lit(p / 100)).alias(tpr_name(p)) for p in FPR_PERCENT])
    out = rates(confused)
    for part in (curve, outermost(df, running, keys)):
        out = out.join(part, keys, "left") if keys else out.crossJoin(part)
    if p_values:
        n = F.col("n_pos"), F.col("n_neg")
        out = out.withColumn("tails", upper_ps(auc_z(F.col("auc"), *n), *[difference_z(F.col(f"fdif{s}"), *n, x) for s, x in SHARES.items()]))
        out = out.withColumns({"p_higher_auc": F.col("tails")[0], **{f"pdif{s}": neg_log(F.col("tails")[i + 1]) for i, s in enumerate(SHARES)}}).drop("tails")
    return out


def mean_roc(running: DataFrame, run_keys: list[str], group_keys: list[str], points: int = 1000) -> DataFrame:
    """Mean true-positive rate of the runs of a group on a grid of false-positive rates, by interpolation.

    Each vertex meets only the grid points up to the next vertex, so the work is the
    vertices plus points per run, not their product.
    """
    start = running.groupBy(*run_keys).agg(F.max("total_p").alias("total_p"), F.max("total_n").alias("total_n")).withColumns({"cum_p": F.lit(0), "cum_n": F.lit(0)})
    columns = [*run_keys, "cum_p", "cum_n", "total_p", "total_n"]
    vertices = running.select(*columns).unionByName(start.select(*columns)).groupBy(*run_keys, "cum_n").agg(
        F.min("cum_p").alias("from_p"), F.max("cum_p").alias("cum_p"), F.max(F.col("cum_p") + F.col("cum_n")).alias("upto"), F.max("total_p").alias("total_p"), F.max("total_n").alias("total_n")
    )
    # the next vertex begins with the score whose rows begin where those of this vertex end
    begins = (F.col("cum_p") + F.col("cum_n") - F.col("p") - F.col("n")).alias("upto")
    below = running.select(*run_keys, begins, F.col("cum_p").alias("next_p"), F.col("cum_n").alias("next_n"))
    rate = lambda c, of: F.col(c) / F.when(F.col(of) > 0, F.col(of))
    nexts = vertices.join(below, [*run_keys, "upto"], "left").select(
        *run_keys, rate("cum_n", "total_n").alias("fpr"), rate("cum_p", "total_p").alias("tpr"), rate("next_n", "total_n").alias("next_fpr"), rate("next_p", "total_p").alias("next_tpr")
    )
    step = points - 1
    first = F.ceil(F.round(F.col("fpr") * step, 9))
    last = F.when(F.col("next_fpr").isNull(), F.lit(step)).otherwise(F.ceil(F.round(F.col("next_fpr") * step, 9)) - 1)
    at = nexts.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("point"))
    x = F.col("point") / F.lit(float(step))
    y = F.when(F.col("next_fpr").isNull(), F.col("tpr")).otherwise(F.col("tpr") + (x - F.col("fpr")) / (F.col("next_fpr") - F.col("fpr")) * (F.col("next_tpr") - F.col("tpr")))
    return at.select(*run_keys, "point", x.alias("grid_fpr"), y.alias("y")).groupBy(*group_keys, "point", "grid_fpr").agg(F.avg("y").alias("mean_tpr"))


def sorted_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_member, s1, n_records, last_place): scores of either side from the lowest up, with the place of the last record of each, for plots.

    Places come from running counts of distinct scores, so a side of any size is not sorted in one task.
    """
    counts = df.groupBy(*keys, "is_member", (-F.col("s1")).alias("s1")).agg(F.count(F.lit(1)).alias("p"), F.lit(0).cast("bigint").alias("n"))
    ordered = running_counts(cut_lineage(counts), [*keys, "is_member"])
    return ordered.select(*keys, "is_member", (-F.col("s1")).alias("s1"), F.col("p").alias("n_records"), F.col("cum_p").alias("last_place"))
