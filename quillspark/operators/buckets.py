"""Links within buckets of 64-bit fingerprints that agree in chosen bits, in numpy over Arrow batches of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of small groups that are worked on together, and comparisons that are made at once.
ROWS, PAIRS = 1 << 16, 1 << 20


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups (prefix, value) of one prefix, about ROWS rows or one group at a time. Batches come sorted by both."""
    held, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, low = pa.Table.from_batches([batch]), 0
        group = np.stack([t["prefix"].to_numpy(), t["value"].to_numpy()])
        before = np.column_stack([group[:, 0] if last is None else last, group[:, :-1]])
        for at in np.flatnonzero((group != before).any(axis=0)):
            if n + at - low >= ROWS or group[0, at] != before[0, at]:
                yield pa.concat_tables([*held, t.slice(low, at - low)])
                held, n, low = [], 0, at
        held.append(t.slice(low))
        n, last = n + t.num_rows - low, group[:, -1]
    if held:
        yield pa.concat_tables(held)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place of its part, when the places u and v are linked too."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, lower := label[label]):
            label = lower


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _spanning(keys: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in buckets that span several parts, a bucket after another, and how many places of the bucket each is to be compared
    with, just behind it. Those of the bucket's largest part come last, and are to be compared with none."""
    order = np.argsort(keys, kind="stable")
    starts, own = _starts(keys[order]), label[order]
    sizes = np.diff(np.r_[starts, len(order)])
    spans = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
    order, bucket = order[np.repeat(spans, sizes)], np.repeat(np.arange(spans.sum()), sizes[spans])
    if not len(order):
        return order, order
    by_part = np.lexsort((label[order], bucket))
    order = order[by_part]
    runs = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (label[order][1:] != label[order][:-1])])
    lengths = np.diff(np.r_[runs, len(order)])
    ranked = np.lexsort((lengths, bucket[runs]))
    major = np.zeros(len(runs), bool)
    major[ranked[np.r_[_starts(bucket[runs])[1:], len(runs)] - 1]] = True
    last = np.repeat(major, lengths)
    place, ends = np.argsort(2 * bucket + last, kind="stable"), np.repeat(np.cumsum(sizes[spans]), sizes[spans])
    return order[place], np.where(last[place], 0, ends - np.arange(len(order)) - 1)


def _near(bits: np.ndarray, mask: int, label: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places at most threshold bits apart in the mask's buckets, but for those that both lie in a bucket's largest part."""
    order, behind = _spanning(bits & mask, label)
    total, low = np.cumsum(behind), 0
    while low < len(order):
        done = total[low] - behind[low]
        high = max(low + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        x = np.repeat(np.arange(low, high), behind[low:high])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[low:high] - behind[low:high] - done, behind[low:high])
        x, y, low = order[x], order[y], high
        near = np.bitwise_count(bits[x] ^ bits[y]) <= threshold
        yield x[near], y[near]


def parts(bits: np.ndarray, masks: list[int], threshold: int) -> np.ndarray:
    """For each place the smallest place that it reaches by links: between fingerprints that agree in all bits of a mask and differ in at
    most threshold bits. First each bucket's members are compared with its first, then across what these links leave apart."""
    label = np.arange(len(bits))
    for mask in np.array(masks, np.uint64):
        order = np.argsort(bits & mask, kind="stable")
        starts = _starts((bits & mask)[order])
        lead = np.repeat(order[starts], np.diff(np.r_[starts, len(order)]))
        near = np.bitwise_count(bits[order] ^ bits[lead]) <= threshold
        label = _merge(label, lead[near], order[near])
    for mask in np.array(masks, np.uint64):
        for x, y in _near(bits, mask, label, threshold):
            label = _merge(label, x, y)
    return label


def links(batches: Iterator[pa.RecordBatch], masks: dict[int, list[int]], threshold: int) -> Iterator[pa.RecordBatch]:
    """(a, b): of each group, links that join what links of its buckets join, at most one a row. masks: a prefix's buckets."""
    for t in whole_groups(batches):
        first = t["first"].combine_chunks()
        low = parts(t["bits"].to_numpy().view(np.uint64), masks[t["prefix"][0].as_py()], threshold)
        linked = np.flatnonzero(low != np.arange(len(low)))
        yield pa.RecordBatch.from_arrays([first.take(pa.array(low[linked])), first.take(pa.array(linked))], ["a", "b"])


def pairs(batches: Iterator[pa.RecordBatch], masks: dict[int, list[int]], threshold: int, bands: list[int]) -> Iterator[pa.RecordBatch]:
    """(a, b): all pairs at most threshold bits apart, each in the first bucket that it shares only: that of the first bands that agree."""
    bands = np.array(bands, np.uint64)
    for t in whole_groups(batches):
        first, bits = t["first"].combine_chunks(), t["bits"].to_numpy().view(np.uint64)
        for mask in masks[t["prefix"][0].as_py()]:
            upto = np.uint64((1 << mask.bit_length()) - 1)
            for x, y in _near(bits, np.uint64(mask), np.arange(len(bits)), threshold):
                agree = np.zeros(len(x), np.uint64)
                for band in bands:
                    agree |= np.where((bits[x] ^ bits[y]) & band == 0, band, np.uint64(0))
                own = agree & upto == mask
                if own.any():
                    yield pa.RecordBatch.from_arrays([first.take(pa.array(x[own])), first.take(pa.array(y[own]))], ["a", "b"])
