"""Records of evaluation splits that recur, exactly or almost, in the training split.

A record is read as a text: its features in order, each reduced to the symbol of
its cell on a grid far wider than the tolerance, with a symbol of its own for a
missing value. Two records that may differ in k of d positions must agree on all of
one of any k + 1 stretches that partition the positions, and so on any window of
that stretch. So a sparse suffix array suffices: the texts of a target are
concatenated, and of every text only the k + 1 suffixes that begin at a window are
kept. They are partitioned by target, window and their first symbols, and sorted.
Adjacent suffixes whose common prefix is as long as the window form a run; members
of both splits in a run share a span. The features of such pairs are compared
exactly: spans are extended while values agree, further ones of the pair are added,
and all are merged into coverage.

Nothing is lost to the grid: a training record has one text, an evaluation record
has a variant for every cell its value could meet within the tolerance. Stretches
are balanced by the information of their positions (how many cells are in use
within the target), and a window is the part of a stretch that tells most, of
WINDOW positions at most. So flags with two levels do not make a window that
everything shares, and a record has at most 2^WINDOW variants of a window.

Scale. Identical records are one class first, so copies are compared once, and
only the pairs asked for are expanded. Large targets are split by the hash of the
record. A run of more than RUN_PAIRS pairs is not paired in its task: its members
become a group of their own, whose remaining positions are indexed in the same way;
what is still large then is compared by a salted join of blocks of BLOCK members.
Which way a pair took does not show in its result. No group is collected anywhere.

Defined results: rows without record_id, target_id, split or features take no
part; of rows with one record_id the one ingested last counts; null, NaN both
mean missing and agree with each other only; infinities agree with themselves;
records of different lengths, or of length 0, have no common positions and never
match; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, latest_rows, small_side

TRAIN, EVALUATION = "train", ("test", "test_late")
#: Values agree up to TOLERANCE; one position of SHARE may disagree. SLACK absorbs binary rounding of decimal values.
TOLERANCE, SHARE, SLACK = 0.02, 8, 1e-9
#: Width and offset of the grid. The offset keeps whole numbers away from cell borders.
GRID, OFFSET = 0.2, 0.367
#: Most positions of a window, symbols of a suffix that decide its partition, and positions of a span.
WINDOW, LEAD, SPAN = 8, 4, 2
#: Pairs of one run that a task emits itself; members of a side of a block in which a larger run is compared.
RUN_PAIRS, BLOCK = 4_096, 512
#: Targets with more than 1/HOT of all records (HOT at most, therefore) are split by the hash of the record.
HOT = 200
_MISSING, _CELLS = 255, 251


def allowed(size: Column) -> Column:
    """Positions that may disagree in records of this length."""
    return F.floor(size / SHARE).cast("int")


def agreeing(a: Column, b: Column) -> Column:
    """Which positions of two arrays of one length agree."""
    return F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | (F.abs(x - y) <= TOLERANCE + SLACK), x.isNull() & y.isNull()))


def members(records: DataFrame) -> DataFrame:
    """(record_id, target_id, split, source, features, h1, h2): one row of a record; the hashes name its identical records."""
    kept = ["record_id", "target_id", "split", "source", "features", "ingested_at"]
    rows = latest_rows(records.select(*kept).filter(F.col("record_id").isNotNull()), "record_id").drop("ingested_at")
    rows = rows.filter(F.col("target_id").isNotNull() & F.col("split").isin(TRAIN, *EVALUATION) & (F.size("features") > 0))
    # adding zero turns -0.0 into 0.0
    rows = rows.withColumn("features", F.transform("features", lambda x: F.when(~F.isnan(x), x + F.lit(0.0))))
    # hashes skip nulls, so missing values get a text of their own
    text = F.transform("features", lambda x: F.coalesce(x.cast("string"), F.lit("-")))
    return rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), "target_id", text) for i in (1, 2)})


def classes(rows: DataFrame) -> DataFrame:
    """(class_id, target_id, grp, h1, h2, features, size, k, in_train, in_evaluation), one row of identical records; class_id is the smallest record_id.

    Rows are spread by target (hot targets also by hash), so grouping needs no shuffle beyond that one.
    """
    counts = rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * HOT > whole).select("target_id", F.ceil(F.col("n") * HOT / whole).alias("parts")).collect() if whole else []  # HOT rows at most
    parts = F.lit(1)
    for r in hot:
        parts = F.when(F.col("target_id") == r.target_id, F.lit(r.parts)).otherwise(parts)
    spread = rows.withColumn("part", F.pmod(F.col("h1"), parts)).repartition("target_id", "part")
    grouped = spread.groupBy("target_id", "part", "h1", "h2").agg(
        F.min("record_id").alias("class_id"),
        F.first("features").alias("features"),
        F.max(F.col("split") == TRAIN).alias("in_train"),
        F.max(F.col("split") != TRAIN).alias("in_evaluation"),
    )
    size = F.size("features")
    return grouped.select("class_id", "target_id", F.xxhash64("target_id", size).alias("grp"), "h1", "h2", "features", size.alias("size"), allowed(size).alias("k"), "in_train", "in_evaluation")


# ---------------------------------------------------------------- windows


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of arrays (missing ones NaN) and the offsets of its rows."""
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]


def cells(values: np.ndarray) -> np.ndarray:
    """The symbol of each value's cell."""
    with np.errstate(invalid="ignore", over="ignore"):
        place = np.floor(values / GRID + OFFSET)
        own = np.where(np.isfinite(place), np.mod(place, _CELLS), np.where(values > 0, _CELLS, _CELLS + 1))
    return np.where(np.isnan(values), _MISSING, own).astype(np.uint8)


_SEEN = "grp bigint, size int, k int, pos int, seen bigint"


def _cells_in_use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group and position a set of 63 marks, one of which each cell in use sets."""
    for batch in batches:
        values, offsets = _flat(batch, "features")
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        marks = np.int64(1) << (cells(values).astype(np.int64) * 37 % 63)
        group, first, place = np.unique(batch.column("grp").to_numpy(), return_index=True, return_inverse=True)
        width = max(1, int(sizes.max(initial=0)))
        key = place[row] * width + np.arange(len(row)) - offsets[row]
        order = np.argsort(key, kind="stable")
        own = key[order]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        seen = np.bitwise_or.reduceat(marks[order], start) if len(own) else np.zeros(0, np.int64)
        at = own[start] // width
        columns = [group[at], sizes[first][at].astype(np.int32), batch.column("k").to_numpy()[first][at].astype(np.int32), (own[start] % width).astype(np.int32), seen]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SEEN.split(", ")])


def windows(kinds: DataFrame, window: int = WINDOW) -> DataFrame:
    """(grp, windows): for each group the array of (start, length) of the windows of its k + 1 stretches of about equal information."""
    seen = kinds.select("grp", "size", "k", "features").mapInArrow(_cells_in_use, _SEEN)
    seen = seen.groupBy("grp", "size", "k", "pos").agg(F.bit_or("seen").alias("seen"))
    bits = F.log2(F.bit_count("seen").cast("double"))
    listed = seen.groupBy("grp", "size", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", bits.alias("bits")))), lambda x: x["bits"]).alias("bits"))  # one number of a position
    index = F.sequence(F.lit(0), F.col("size") - 1)
    upto = lambda p: F.aggregate(F.slice("bits", 1, p + 1), F.lit(0.0), lambda s, x: s + x)
    whole, parts = upto(F.col("size")), F.col("k") + 1
    balanced = F.transform(index, lambda p: F.least(F.col("k"), F.floor((upto(p) - F.get("bits", p) / 2) / whole * parts).cast("int")))
    # where one feature outweighs a part, parts stay empty: then the positions are divided evenly
    even = F.transform(index, lambda p: F.floor(p * parts / F.col("size")).cast("int"))
    listed = listed.withColumn("part", F.when((whole > 0) & (F.size(F.array_distinct(balanced)) == parts), balanced).otherwise(even))

    def best(j: Column) -> Column:
        start, length = F.array_position("part", j) - 1, F.size(F.filter("part", lambda x: x == j))
        begins = F.sequence(start, start + F.greatest(F.lit(0), length - window))
        held = lambda a: F.aggregate(F.slice("bits", a + 1, F.least(length, F.lit(window))), F.lit(0.0), lambda s, x: s + x)
        top = F.array_max(F.transform(begins, lambda a: F.struct(held(a).alias("bits"), (-a).alias("a"))))
        return F.struct((-top["a"]).cast("int").alias("start"), F.least(length, F.lit(window)).alias("length"))

    return listed.select("grp", F.transform(F.sequence(F.lit(0), F.col("k")), best).alias("windows"))


# ---------------------------------------------------------------- the suffix array

_SUFFIX = "run bigint, suffix binary, length int, class_id bigint, is_train boolean"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each class at its windows, with the variants of evaluation records."""
    edge = TOLERANCE + 2 * SLACK
    for batch in batches:
        values, offsets = _flat(batch, "features")
        own, low, high = (cells(v) for v in (values, values - edge, values + edge))
        border, text = low != high, own.tobytes()
        groups, ids = batch.column("grp").to_numpy().view(np.uint64), batch.column("class_id").to_pylist()
        train, other, places = (batch.column(c).to_pylist() for c in ("in_train", "in_evaluation", "windows"))
        mixed = [((groups * _MIX) ^ np.uint64(j + 1)).view(np.int64).tolist() for j in range(max((len(w) for w in places), default=0))]
        out: list[tuple] = []
        for i, (name, ours, theirs, found) in enumerate(zip(ids, train, other, places, strict=True)):
            begin, end = int(offsets[i]), int(offsets[i + 1])
            for j, w in enumerate(found):
                at, length = begin + w["start"], w["length"]
                suffix = text[at:end]
                if ours:
                    out.append((mixed[j][i], suffix, length, name, True))
                if theirs:
                    open_at = np.flatnonzero(border[at : at + length])
                    if not len(open_at):
                        out.append((mixed[j][i], suffix, length, name, False))
                        continue
                    stem = bytearray(suffix)
                    for choice in product(*[(int(low[at + p]), int(high[at + p])) for p in open_at]):
                        for p, symbol in zip(open_at.tolist(), choice, strict=True):
                            stem[p] = symbol
                        out.append((mixed[j][i], bytes(stem), length, name, False))
            if len(out) > 50_000 or i == len(ids) - 1:
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SUFFIX.split(", ")])
                out = []


_OPEN = "train_class is null or evaluation_class is null"
_SHARED = "train_class bigint, evaluation_class bigint, run bigint, start int, length int"


def _run_starts(table: pa.Table) -> np.ndarray:
    """Whether a row of sorted suffixes begins a run: its common prefix with the row before is shorter than the window."""
    run, length = table.column("run").to_numpy(), table.column("length").to_numpy()
    suffix = table.column("suffix").combine_chunks().cast(pa.binary())  # offsets of 32 bits, whatever the session asks Arrow for
    offsets = np.frombuffer(suffix.buffers()[1], np.int32)[suffix.offset : suffix.offset + len(suffix) + 1].astype(np.int64)
    data = np.frombuffer(suffix.buffers()[2], np.uint8) if suffix.buffers()[2] else np.zeros(0, np.uint8)
    new = np.r_[True, run[1:] != run[:-1]]
    for p in range(int(length.max(initial=0))):
        inside = np.flatnonzero(~new & (length > p))
        new[inside] = data[offsets[inside] + p] != data[offsets[inside - 1] + p]
    return new


def _walk(batches: Iterator[pa.RecordBatch], run_pairs: int) -> Iterator[pa.RecordBatch]:
    """Go through sorted suffixes; emit the pairs of small runs, and the members of large ones with the other side null."""
    names = [f.split()[0] for f in _SHARED.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    held: pa.Table | None = None  # the last run, which may go on
    flushed = False  # its members were passed on already

    def emitted(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(p[c], kinds[c], mask=p[c] < 0 if c < 2 else None) for p in parts]) for c in range(5)], names=names)

    def runs_of(table: pa.Table, first: np.ndarray, last: np.ndarray, large: np.ndarray) -> list[tuple]:
        """Columns of pairs, or of members, of the given runs."""
        ids, train = table.column("class_id").to_numpy(), table.column("is_train").to_numpy()
        length, group = table.column("length").to_numpy(), table.column("run").to_numpy()
        suffixes, out = table.column("suffix"), []
        for a, b, passed_on in zip(first.tolist(), last.tolist(), large.tolist(), strict=True):
            side, own = train[a:b], ids[a:b]
            size, start = int(length[a]), len(suffixes[a].as_py())
            if passed_on:
                key = int.from_bytes(hashlib.blake2b(group[a].tobytes() + suffixes[a].as_py()[:size], digest_size=8).digest(), signed=True)
                ours, theirs = np.where(side, own, -1), np.where(side, -1, own)
            else:
                key = 0
                ours, theirs = np.repeat(own[side], (~side).sum()), np.tile(own[~side], side.sum())
                unlike = ours != theirs
                ours, theirs = ours[unlike], theirs[unlike]
            n = len(ours)
            out.append((ours, theirs, np.full(n, key), np.full(n, start, np.int32), np.full(n, size, np.int32)))
        return out

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        first = np.flatnonzero(_run_starts(table))
        last = np.r_[first[1:], table.num_rows]
        ours = np.add.reduceat(table.column("is_train").to_numpy().astype(np.int64), first)
        theirs = last - first - ours
        large = (ours * theirs > run_pairs) | (last - first > run_pairs)
        done = np.ones(len(first), bool)
        done[-1] = False
        large[0] |= flushed
        before = held.num_rows if flushed and held is not None else 0
        whole = done & (large | ((ours > 0) & (theirs > 0)))
        parts = [p for p in runs_of(table, np.where(np.arange(len(first)) == 0, first + before, first)[whole], last[whole], large[whole]) if len(p[0])]
        flushed = bool(large[-1])
        if flushed:
            begin = int(first[-1]) + (before if len(first) == 1 else 0)
            if begin < table.num_rows:
                parts += runs_of(table, np.array([begin]), np.array([table.num_rows]), np.array([True]))
            held = table.slice(table.num_rows - 1)
        else:
            held = table.slice(int(first[-1]))
        if parts:
            yield emitted(parts)
    if held is not None and not flushed:
        parts = [p for p in runs_of(held, np.array([0]), np.array([held.num_rows]), np.array([False])) if len(p[0])]
        if parts:
            yield emitted(parts)


def suffixes(kinds: DataFrame, places: DataFrame) -> DataFrame:
    """(run, suffix, length, class_id, is_train): the indexed suffixes of every class, variants included; run is group and window."""
    both = kinds.join(broadcast_if_small(places), "grp")
    return both.select("grp", "class_id", "features", "windows", "in_train", "in_evaluation").mapInArrow(_suffix_rows, _SUFFIX)


def shared_spans(index: DataFrame) -> DataFrame:
    """Partition and sort the suffixes, and walk the sorted array of every partition: (train_class, evaluation_class, run, start, length).

    start is the number of positions from the window's start to the end of the text. Members of
    large runs come with the other side null, under the number of their run.
    """
    limit = RUN_PAIRS
    ordered = index.repartition(F.xxhash64("run", F.substring("suffix", 1, LEAD))).sortWithinPartitions("run", "suffix", "class_id", "is_train")
    return ordered.mapInArrow(lambda batches: _walk(batches, limit), _SHARED)


def _pairs(shared: DataFrame) -> DataFrame:
    return shared.filter("train_class is not null and evaluation_class is not null").select("train_class", "evaluation_class")


def _in_blocks(large: DataFrame) -> DataFrame:
    """All pairs across the splits of each large run, by blocks of about BLOCK members a side."""
    sizes = large.groupBy("run").agg(*[F.ceil(F.count(f"{s}_class") / BLOCK).cast("bigint").alias(f"{s}_parts") for s in ("train", "evaluation")])
    sized = large.join(small_side(sizes.filter("train_parts > 0 and evaluation_parts > 0")), "run")
    part = lambda s: F.pmod(F.xxhash64(f"{s}_class"), F.col(f"{s}_parts")).alias(f"{s}_part")
    every = lambda s: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{s}_parts") - 1)).alias(f"{s}_part")
    ours = sized.filter("train_class is not null").select("run", "train_class", part("train"), every("evaluation"))
    theirs = sized.filter("evaluation_class is not null").select("run", "evaluation_class", part("evaluation"), every("train"))
    return ours.join(theirs, ["run", "train_part", "evaluation_part"]).filter("train_class <> evaluation_class").select("train_class", "evaluation_class")


def _rest_of_runs(large: DataFrame, kinds: DataFrame) -> DataFrame:
    """The members of large runs that hold both splits as classes of a group of their own, without the positions of the window."""
    inside = cut_lineage(large.groupBy("run", F.coalesce("train_class", "evaluation_class").alias("class_id")).agg(
        F.max("start").alias("start"), F.max("length").alias("length"), F.max(F.col("train_class").isNotNull()).alias("in_train"), F.max(F.col("evaluation_class").isNotNull()).alias("in_evaluation")
    ))
    both = inside.groupBy("run").agg(F.bool_or("in_train").alias("t"), F.bool_or("in_evaluation").alias("e")).filter("t and e").select("run")
    inside = inside.join(small_side(both), "run").join(kinds.select("class_id", "features", "size", "k"), "class_id")
    begin = F.col("size") - F.col("start")
    rest = F.concat(F.slice("features", 1, begin), F.slice("features", begin + F.col("length") + 1, F.col("size")))
    return inside.select("class_id", F.col("run").alias("grp"), rest.alias("features"), (F.col("size") - F.col("length")).alias("size"), "k", "in_train", "in_evaluation")


def _one_sided(kinds: DataFrame) -> DataFrame:
    """Classes of groups as members of large runs."""
    nothing = F.lit(None).cast("bigint")
    ours = kinds.filter("in_train").select(F.col("class_id").alias("train_class"), nothing.alias("evaluation_class"), F.col("grp").alias("run"))
    return ours.unionByName(kinds.filter("in_evaluation").select(nothing.alias("train_class"), F.col("class_id").alias("evaluation_class"), F.col("grp").alias("run")))


def candidates(kinds: DataFrame, places: DataFrame) -> DataFrame:
    """(train_class, evaluation_class): distinct pairs that share a span."""
    shared = cut_lineage(shared_spans(suffixes(kinds, places)))
    pairs, large = _pairs(shared), shared.filter(_OPEN)
    if large.limit(1).count():
        inner = cut_lineage(_rest_of_runs(large, kinds))
        split = inner.filter("size > k")
        again = cut_lineage(shared_spans(suffixes(split, cut_lineage(windows(split)))))
        still = again.filter(_OPEN).select("train_class", "evaluation_class", "run").unionByName(_one_sided(inner.filter("size <= k")))
        pairs = pairs.unionByName(_pairs(again)).unionByName(_in_blocks(cut_lineage(still)))
    return pairs.distinct()


def _covered(wrong: Column, size: Column) -> Column:
    """Positions in agreeing stretches of at least SPAN positions (all, if there are fewer); wrong: running number of disagreements, from 0."""
    span = F.least(F.lit(SPAN), size)
    begins = lambda p: F.sequence(F.greatest(F.lit(0), p - span + 1), F.least(p, size - span))
    return F.filter(F.sequence(F.lit(0), size - 1), lambda p: F.exists(begins(p), lambda a: F.get(wrong, a) == F.get(wrong, a + span)))


def matched_classes(kinds: DataFrame) -> DataFrame:
    """(train_class, evaluation_class, covered, size, n_disagree): classes that match across splits, with the positions their spans cover; a class in both splits matches itself."""
    places = cut_lineage(windows(kinds))
    pairs = cut_lineage(candidates(kinds, places))
    hint = _hint(pairs)
    for s in ("train", "evaluation"):
        full = kinds.select(F.col("class_id").alias(f"{s}_class"), F.col("target_id").alias(f"{s}_target"), F.col("features").alias(f"{s}_features"))
        pairs = hint(pairs).join(full, f"{s}_class")
    # groups and runs go by hashes: what two of one hash have in common is no pair
    pairs = pairs.filter((F.col("train_target") == F.col("evaluation_target")) & (F.size("train_features") == F.size("evaluation_features")))
    pairs = pairs.withColumns({"agree": agreeing(F.col("train_features"), F.col("evaluation_features")), "size": F.size("train_features")})
    pairs = pairs.withColumn("n_disagree", F.size(F.filter("agree", lambda x: ~x))).filter(F.col("n_disagree") <= allowed(F.col("size")))
    wrong = F.aggregate("agree", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.when(x, 0).otherwise(1))))
    found = pairs.withColumn("wrong", wrong).select("train_class", "evaluation_class", _covered(F.col("wrong"), F.col("size")).alias("covered"), "size", "n_disagree")
    every = F.sequence(F.lit(0), F.col("size") - 1)
    itself = kinds.filter("in_train and in_evaluation").select(
        F.col("class_id").alias("train_class"), F.col("class_id").alias("evaluation_class"), every.alias("covered"), "size", F.lit(0).alias("n_disagree")
    )
    return found.unionByName(itself)


def _hint(df: DataFrame):
    """A broadcast hint for frames of as many rows as df, if those are few."""
    return F.broadcast if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x


def _overlaps(rows: DataFrame) -> DataFrame:
    kinds = cut_lineage(classes(rows))
    matches = matched_classes(kinds).withColumn("coverage", F.size("covered") / F.col("size")).drop("covered", "size")
    matches = cut_lineage(matches)
    hint = _hint(matches)
    for s in ("train", "evaluation"):
        names = kinds.select(F.col("class_id").alias(f"{s}_class"), F.col("h1").alias(f"{s}_h1"), F.col("h2").alias(f"{s}_h2"))
        matches = hint(matches).join(names, f"{s}_class")
    keyed = lambda s, *more: rows.filter((F.col("split") == TRAIN) == (s == "train")).select(F.col("h1").alias(f"{s}_h1"), F.col("h2").alias(f"{s}_h2"), F.col("record_id").alias(f"{s}_record"), *more)
    train, other = keyed("train", "target_id"), keyed("evaluation", "split", "source")
    both = hint(matches).join(train, ["train_h1", "train_h2"])
    return both.join(other, ["evaluation_h1", "evaluation_h2"]).select("target_id", "train_record", "evaluation_record", "split", "source", "coverage", "n_disagree")


def overlaps(records: DataFrame) -> DataFrame:
    """(target_id, train_record, evaluation_record, split, source, coverage, n_disagree): every overlapping pair; split and source of the evaluation record.

    coverage: the share of positions that lie in spans, agreeing stretches of at least SPAN positions.
    """
    return _overlaps(cut_lineage(members(records)))


def record_coverage(records: DataFrame) -> DataFrame:
    """(record_id, target_id, split, source, n_classes, coverage): of each overlapping evaluation record the number of different training
    records it matches, and the share of its positions that the merged spans of all of them cover."""
    rows = cut_lineage(members(records))
    kinds = cut_lineage(classes(rows))
    matches = cut_lineage(matched_classes(kinds))
    counts = matches.groupBy("evaluation_class").agg(F.count(F.lit(1)).alias("n_classes"), F.max("size").alias("size"))
    # positions of a class are few: at most its length is left of any number of partners before the shuffle
    spans = matches.select("evaluation_class", F.explode("covered").alias("pos")).distinct().groupBy("evaluation_class").agg(F.count(F.lit(1)).alias("n_covered"))
    merged = counts.join(spans, "evaluation_class").join(kinds.select(F.col("class_id").alias("evaluation_class"), "h1", "h2"), "evaluation_class")
    own = rows.filter(F.col("split") != TRAIN).select("record_id", "target_id", "split", "source", "h1", "h2")
    return own.join(merged, ["h1", "h2"]).select("record_id", "target_id", "split", "source", "n_classes", (F.col("n_covered") / F.col("size")).alias("coverage"))


def found_pairs(records: DataFrame) -> DataFrame:
    """(record_a, record_b): the overlapping pairs, smaller id first."""
    pair = overlaps(records)
    return pair.select(F.least("train_record", "evaluation_record").alias("record_a"), F.greatest("train_record", "evaluation_record").alias("record_b"))


def overlap_report(records: DataFrame) -> DataFrame:
    """(split, source, n_records, n_overlapping, n_pairs) of every evaluation split and source; a null source is a group of its own."""
    rows = cut_lineage(members(records))
    per_record = _overlaps(rows).groupBy("evaluation_record").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.filter(F.col("split") != TRAIN).select("record_id", "split", "source").join(per_record, F.col("record_id") == F.col("evaluation_record"), "left")
    return joined.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs")
    )
