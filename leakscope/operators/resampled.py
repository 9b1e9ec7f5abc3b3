"""Trees of many samples of the same rows, grown side by side in one task.

The trees are those of `trees.grow`: Gini gain, cuts at midpoints or quantiles of the rows of
the sample, the smaller feature and threshold of equal gains, leaves of one parent that predict
the same class made one. A sample's rows are sorted by node and bin for every feature; running
counts of classes at the ends of bins give the gains of all splits of a level at once.

Arrays are by feature, sample and row. As many samples are grown at a time as fill CELLS, one at
least, so memory follows the rows, not the number of samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leakscope.operators.trees import LEAST_GAIN, MAX_BINS

#: Values that are looked at at a time.
CELLS = 150_000
#: Gains are compared in these units.
_UNIT = 1e-9
_BIN_BITS = (MAX_BINS - 1).bit_length()
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def sampled(hashes: np.ndarray, models: np.ndarray, n: int) -> np.ndarray:
    """(models, rows): whether a row is one of the n of smallest `hash_unit(record, model)`; hashes are xxhash64 of the records, rows in their order."""
    if n >= len(hashes):
        return np.ones((len(models), len(hashes)), bool)
    h = (hashes.astype(np.int64).view(np.uint64) + _P5 + np.uint64(4)) ^ (models.astype(np.uint64) * _P1)[:, None]
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h = (h ^ (h >> np.uint64(32))) & np.uint64((1 << 53) - 1)
    if not n:
        return np.zeros(h.shape, bool)
    last = np.partition(h, n - 1, axis=1)[:, n - 1 : n]
    below, same = h < last, h == last
    return below | (same & (np.cumsum(same, axis=1) <= n - below.sum(axis=1, keepdims=True)))


def _upper_cuts(v: np.ndarray) -> np.ndarray:
    """The first cut that is not below each value, inf if there is none; v is sorted along its last axis."""
    size = v.shape[-1]
    new = v[..., 1:] != v[..., :-1]
    few = new.sum(axis=-1) < MAX_BINS - 1
    out = np.empty(v.shape)
    if few.any():
        a = v[few]
        following = np.full(a.shape, np.inf)
        following[:, :-1] = np.where(new[few], a[:, 1:], np.inf)
        following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
        with np.errstate(invalid="ignore", over="ignore"):
            middle = (a + following) / 2
        for i in np.flatnonzero((np.isnan(middle) | ((middle >= following) & (following < np.inf))).any(axis=1)):  # a midpoint that is rounded up
            values = np.unique(a[i])
            with np.errstate(invalid="ignore", over="ignore"):
                cuts = (values[1:] + values[:-1]) / 2
            cuts = cuts[~np.isnan(cuts)]
            middle[i] = np.append(cuts, np.inf)[np.searchsorted(cuts, a[i])]
        out[few] = middle
    if not few.all():
        b, many = v[~few], MAX_BINS - 1
        places = (np.arange(1, MAX_BINS) * size + MAX_BINS - 1) // MAX_BINS - 1
        at = np.searchsorted(places, np.arange(size))
        upper = np.where(at < many, b[:, places[np.minimum(at, many - 1)]], np.inf)
        out[~few] = np.where((at > 0) & (b[:, places[np.maximum(at - 1, 0)]] == b), b, upper)
    return out


def _binned(x: np.ndarray, order: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins (features, samples, rows of the sample in their order) and cuts (features, samples, bins)."""
    (m, n), size, width = inside.shape, int(inside[0].sum()), len(x)
    place = np.cumsum(inside, axis=1).ravel() - 1
    bins, cuts = np.empty((width, m, size), np.int32), np.full((width, m, MAX_BINS), np.inf)
    step = max(1, CELLS // (m * n))
    for low in range(0, width, step):
        o = order[low : low + step]
        own = np.ascontiguousarray(np.take(inside, o, axis=1).transpose(1, 0, 2))
        lanes = own.shape[:2]
        rows = np.broadcast_to(o[:, None], own.shape)[own].reshape(*lanes, size)
        upper = _upper_cuts(np.broadcast_to(np.take_along_axis(x[low : low + step], o, axis=1)[:, None], own.shape)[own].reshape(*lanes, size))
        b = np.zeros(upper.shape, np.int32)
        np.cumsum(upper[..., 1:] != upper[..., :-1], axis=-1, out=b[..., 1:])
        lane = np.arange(lanes[0] * m).reshape(*lanes, 1)
        part, ends = np.empty(lane.size * size, np.int32), np.full(lane.size * MAX_BINS, np.inf)
        part[place.take(rows + np.arange(0, m * n, n)[:, None]) + lane * size] = b
        ends[lane * MAX_BINS + b] = upper
        bins[low : low + step], cuts[low : low + step] = part.reshape(*lanes, size), ends.reshape(*lanes, MAX_BINS)
    return bins, cuts


def true_class_probs(x: np.ndarray, order: np.ndarray, y: np.ndarray, n_classes: int, inside: np.ndarray, depth: int) -> np.ndarray:
    """(samples, rows): the probability that the tree grown on a sample gives to a row's class.

    x: features by rows; order: the rows of every feature from its least value up; y: classes from 0;
    inside: (samples, rows), as many rows in each.
    """
    (m, n), size, width = inside.shape, int(inside[0].sum()), len(x)
    bits = max(1, (n_classes - 1).bit_length())
    bins, cuts = _binned(x, order, inside)
    key = bins if depth + 1 + _BIN_BITS + bits < 32 else bins.astype(np.int64)
    key <<= bits
    key += np.broadcast_to(y.astype(key.dtype), inside.shape)[inside].reshape(m, size)
    sample = np.arange(m)[:, None]
    node = np.ones((m, n), np.int32)
    split_on, split_at = np.full((m, 2 << depth), -1, np.int32), np.zeros((m, 2 << depth))
    counts = np.zeros((m, 2 << depth, n_classes))
    counts[:, 1] = np.stack([((key[0] & ((1 << bits) - 1)) == c).sum(axis=1) for c in range(n_classes)], axis=1)
    step = max(1, CELLS // (m * size))

    for level in range(depth):
        first = 1 << level
        at = node[inside].reshape(m, size)
        local = np.where(at >= first, at - first, first)  # rows that stay in a leaf come last
        # a row's place among those sorted by node tells its node, whatever the feature
        group = np.sort(local, axis=1) + sample * (first + 1)
        whole = np.zeros((m, first + 1, n_classes))
        whole[:, :first] = counts[:, first : 2 * first]
        before, whole = [[np.ascontiguousarray(a[..., c]).ravel()[group] for c in range(n_classes)] for a in (np.cumsum(whole, axis=1) - whole, whole)]
        n_left, n_whole = np.arange(1, size + 1) - sum(before), sum(whole)
        inner = n_left < n_whole
        if not inner.any():
            break
        n_right, n_whole = np.where(inner, n_whole - n_left, 1), np.maximum(n_whole, 1)
        undivided = sum(t * t for t in whole) / n_whole
        local = local.astype(key.dtype) << (_BIN_BITS + bits)
        best = np.full(m * (first + 1), LEAST_GAIN / _UNIT + 0.5)
        on, bin_of, sides = np.full(len(best), -1), np.zeros(len(best), np.int64), np.zeros((2, len(best), n_classes))
        for low in range(0, width, step):
            s = key[low : low + step] + local
            s.sort(axis=-1)
            tops = s >> bits
            s &= (1 << bits) - 1
            ends = np.zeros(s.shape, bool)
            np.not_equal(tops[..., 1:], tops[..., :-1], out=ends[..., :-1])
            ends &= inner
            left = [None] + [np.cumsum(s if n_classes == 2 else s == c, axis=-1, dtype=np.int32) - before[c] for c in range(1, n_classes)]
            left[0] = n_left - sum(left[1:]) if n_classes > 1 else np.broadcast_to(n_left, s.shape)
            gain, right = np.zeros(s.shape), np.zeros(s.shape)
            for c, l in enumerate(left):
                gain += l * l
                r = whole[c] - l
                r *= r
                right += r
            gain /= n_left
            right /= n_right
            gain += right
            gain -= undivided
            gain *= 1 / _UNIT
            gain += 0.5
            np.floor(gain, out=gain)
            gain *= ends
            top = best.copy()
            np.maximum.at(top, group, gain.max(axis=0))
            found = np.where(top > best, top, -1.0)
            hit = np.flatnonzero(gain == found[group])[::-1]
            won = np.full(len(best), -1)
            won[group.ravel()[hit % group.size]] = hit  # of equal gains the first stays
            now = np.flatnonzero(won >= 0)
            won, best = won[now], top
            on[now], bin_of[now] = low + won // group.size, tops.ravel()[won] & (MAX_BINS - 1)
            sides[0, now] = np.stack([l.ravel()[won] for l in left], axis=1)
            sides[1, now] = np.stack([t.ravel()[won % group.size] for t in whole], axis=1) - sides[0, now]
        now = np.flatnonzero(on >= 0)
        of, parent = now // (first + 1), first + now % (first + 1)
        split_on[of, parent], split_at[of, parent] = on[now], cuts[on[now], of, bin_of[now]]
        counts[of, 2 * parent], counts[of, 2 * parent + 1] = sides[0, now], sides[1, now]
        on = split_on[sample, node]
        beyond = x.ravel()[np.maximum(on, 0) * np.int64(n) + np.arange(n)] > split_at[sample, node]
        node = np.where(on >= 0, 2 * node + beyond, node)

    label, leaf = counts.argmax(axis=2), np.broadcast_to(np.arange(2 << depth), (m, 2 << depth)).copy()
    for level in reversed(range(depth)):
        of = np.arange(1 << level, 2 << level)
        same = (split_on[:, 2 * of] < 0) & (split_on[:, 2 * of + 1] < 0) & (label[:, 2 * of] == label[:, 2 * of + 1])
        split_on[:, of] = np.where(same, -1, split_on[:, of])
    for level in range(depth):
        of = np.arange(1 << level, 2 << level)
        ended = (split_on[:, of] < 0) | (leaf[:, of] != of)
        for child in (2 * of, 2 * of + 1):
            leaf[:, child] = np.where(ended, leaf[:, of], child)
    shares = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1)
    return shares[sample, leaf[sample, node], y]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first n_keys columns; they come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.columns[:n_keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = bool(held) and any(k[0] != h[len(h) - 1] for k, h in zip(keys, held[-1].columns[:n_keys], strict=True))
        for k in keys:
            new[1:] |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
        low = 0
        for high in np.flatnonzero(new).tolist():
            if high > low:
                held.append(batch.slice(low, high - low))
            if held:
                yield pa.Table.from_batches(held)
            held, low = [], high
        held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def scored(batches: Iterator[pa.RecordBatch], n_keys: int, models: list[int], depth: int) -> Iterator[pa.RecordBatch]:
    """(keys, model_idx, record_id, in_train, p) of rows (keys, block, blocks, record_id, hash, is_member, y, x), sorted by keys, block and record.

    A block has every blocks-th of the models. Each is grown on as many rows as are members; p is the probability of the row's class.
    """
    for table in _groups(batches, n_keys + 1):
        n, own = table.num_rows, [c.combine_chunks() for c in table.select(range(n_keys + 5)).columns]
        key, (block, blocks, record, hashes, member) = own[:n_keys], own[n_keys:]
        size = int(member.to_numpy(zero_copy_only=False).sum())
        mine = np.asarray(models[block[0].as_py() :: blocks[0].as_py()], np.int64)
        if not size or not len(mine):
            continue
        classes, y = np.unique(table.column(n_keys + 5).to_numpy(), return_inverse=True)
        x = np.ascontiguousarray(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n_keys + 6).chunks]).reshape(n, -1).T)
        del table, own
        if not len(x):
            continue
        order = np.stack([np.argsort(v, kind="stable").astype(np.int32) for v in x])
        step = max(1, CELLS // x.size)
        for low in range(0, len(mine), step):
            part = mine[low : low + step]
            inside = sampled(hashes.to_numpy(), part, size)
            p = true_class_probs(x, order, y, len(classes), inside, depth)
            out = [pa.repeat(k[0], p.size) for k in key]
            out += [pa.array(np.repeat(part.astype(np.int32), n)), pa.concat_arrays([record] * len(part)), pa.array(inside.ravel()), pa.array(p.ravel())]
            yield pa.RecordBatch.from_arrays(out, [*[f"k{i}" for i in range(n_keys)], "model_idx", "record_id", "in_train", "p"])
