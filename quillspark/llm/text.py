"""Words of Arrow text columns as 64-bit hashes (twice, where 64 bits are too few), in numpy, block by block.

A word is a run of bytes other than 9-13 and 32 (in UTF-8 these bytes occur only as themselves). A-Z count
as a-z. Blocks hold about a megabyte of text, so that memory doesn't follow the longest text's temporaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


#: Places within a span whose numbers are tabulated; numbers of later places are computed by the same rule.
NEAR = 64
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


class Code:
    """A pseudo-random number for each byte at each place of a span: a span's hash is their sum.

    Numbers of different places have nothing in common (no powers of a base), so that texts with a repeating structure
    don't cancel out; codes of different seeds are independent of each other.
    """

    def __init__(self, seed: int, folded: bool):
        self.byte = stream(seed, 256)
        if folded:
            self.byte[65:91] = self.byte[97:123]
        self.near = self.at(np.repeat(np.arange(NEAR), 256), np.tile(np.arange(256), NEAR))

    def at(self, place: np.ndarray, raw: np.ndarray) -> np.ndarray:
        return mix(self.byte[raw] + place.astype(np.uint64) * _STRIDE)


#: Bytes with A-Z as a-z, twice, and bytes as they are, twice.
FOLDED, FOLDED_2, EXACT, EXACT_2 = Code(11, True), Code(17, True), Code(11, False), Code(71, False)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *codes: Code) -> list[np.ndarray]:
    """For each code a hash of each span's bytes, equal for equal bytes wherever they stand; spans are in order and apart."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in codes]
    first = np.zeros(len(raw), np.int64)
    first[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(first)
    far = np.flatnonzero(place >= NEAR)
    cell = np.minimum(place, NEAR - 1) * 256 + raw
    out = []
    for code in codes:
        value = code.near[cell]
        value[far] = code.at(place[far], raw[far])
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        out.append(mix(total[ends] - total[starts]))
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, A-Z as a-z."""
    return hashes(raw, starts, ends, FOLDED)[0]


def second_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another hash of each word, independent of the first."""
    return hashes(raw, starts, ends, FOLDED_2)[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values: by sorting, which is many times faster here than the hash tables of numpy's own."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


#: What a run of one kind of byte counts as in a word's shape; other marks stand for themselves.
_KIND = np.arange(256).astype(np.uint8)
_KIND[128:] = _KIND[97:123] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")


def shape_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's shape: runs of lower-case letters, capitals and digits count as one sign each, as do runs of one mark."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = _KIND[raw]
    turn = np.ones(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    run = np.cumsum(turn) - 1
    return hashes(kind[turn], run[starts], run[ends - 1] + 1, EXACT)[0]


def word_spans(raw: np.ndarray, firsts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; firsts: where texts begin in raw (a word doesn't run on into the next text)."""
    body = gaps[raw]
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:] = body[:-1]
    after[:-1] = body[1:]
    inner = firsts[(firsts > 0) & (firsts < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    return np.flatnonzero(before & ~body), np.flatnonzero(after & ~body) + 1


def _cut(raw: np.ndarray, low: int) -> int:
    """Where a block that begins at low ends: after a space, or at the end."""
    high = min(len(raw), low + BLOCK)
    while high < len(raw):
        back = np.flatnonzero(_SPACE[raw[low:high]])
        if len(back):
            return low + int(back[-1]) + 1
        high = min(len(raw), high + BLOCK)
    return high


class Texts:
    """The texts of an Arrow array (null: empty), in blocks of whole texts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
        data = column.buffers()[2] if n else None
        self.raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        if column.null_count:
            lengths = np.where(np.asarray(column.is_null()), 0, lengths)
        self.starts, self.ends = offsets[:-1], offsets[:-1] + lengths

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> np.ndarray:
        return self.raw[self.starts[i] : self.ends[i]]

    def raw_rows(self, width: int) -> np.ndarray:
        """Values that all have width bytes, as a matrix."""
        return self.raw[self.starts[0] : self.starts[0] + width * len(self)].reshape(-1, width) if len(self) else np.zeros((0, width), np.uint8)

    def blocks(self, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
        """(first, after the last) text of blocks with at most limit bytes, or with one text."""
        low = 0
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + limit, "right")))
            yield low, min(high, len(self))
            low = min(high, len(self))

    def words(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each block: first text, after the last, word hashes, and the texts' bounds in these."""
        for low, high, (found,), bounds in self.views(span_hashes):
            yield low, high, found, bounds

    def views(self, *views: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
        """As words(), with each view's number for every word; gaps: which bytes stand between words."""
        for low, high in self.blocks():
            base, end = int(self.starts[low]), int(self.ends[high - 1])
            raw, firsts = self.raw[base:end], self.starts[low:high] - base
            found, at, places = [[] for _ in views], 0, []
            while at < len(raw):
                cut = _cut(raw, at)
                part = raw[at:cut]
                starts, ends = word_spans(part, firsts[(firsts >= at) & (firsts < cut)] - at, gaps)
                for f, view in zip(found, views):
                    f.append(view(part, starts, ends))
                places.append(starts + at)
                at = cut
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            bounds = np.append(np.searchsorted(place, firsts), len(place))
            yield low, high, [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found], bounds


_STEPS = stream(23, 64) | np.uint64(1)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words; with fewer words, of all as one."""
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size if n >= size else 0):
        rolled += words[j : n - size + 1 + j] * _STEPS[j]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            yield distinct(rolled[a : b - size + 1])
        elif b > a:
            short = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(mix(np.array([short], np.uint64)))
        else:
            yield np.zeros(0, np.uint64)
