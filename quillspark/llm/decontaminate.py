"""Benchmark decontamination by greedy string tiling (operator 2).

Words are runs of letters, digits and non-ASCII bytes, A-Z as a-z. Every document's rolling hashes of SEED words are
looked up among the benchmark's; a document and an item that share a seed are tiled: Karp-Rabin matches of seeds grow
along their diagonals, the longest match that overlaps no marked word is marked, and so on until none of SEED words
is left. An item whose words are covered to a share of COVERAGE is contained, in whatever order its passages stand. An item
of fewer than SEED words is contained where it stands as a whole: all its words are its seed.

Hits are compared word by word before they count, and items whose seeds in a document can't cover enough of them aren't
tiled. The benchmark is looked up in blocks of at most BLOCK_CHARS characters, one job each (one in all, without a shuffle of
texts, for benchmarks of ordinary size), so that what the driver and a task hold has a fixed bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import _STEPS, Texts, mix, span_hashes
from quillspark.scratch import Scratch, ship_code

SEED, COVERAGE = 5, 0.5
BLOCK_CHARS = 16 << 20
FILTER_BITS = 22
_GAPS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin style hashes of every run of size words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        out += words[j : j + n] * _STEPS[j]
    return mix(out)


def runs_of(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Rows (place in doc, place in item, length) of the longest stretches along which seeds of size words agree."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i - j, prepend=(i[0] - j[0] - 1) if len(i) else 0).astype(bool) | (np.diff(i, prepend=-2) != 1)) if len(i) else np.zeros(0, np.int64)
    return np.stack([i[first], j[first], np.diff(first, append=len(i)) + size - 1], axis=1)


def joined_runs(parts: list[np.ndarray], size: int) -> np.ndarray:
    """Stretches from parts of the document, put together where one goes on in the next part."""
    if len(parts) == 1:
        return parts[0]
    rows = np.concatenate([*parts, np.zeros((0, 3), np.int64)])
    rows = rows[np.lexsort((rows[:, 0], rows[:, 0] - rows[:, 1]))]
    diagonal, end = rows[:, 0] - rows[:, 1], rows[:, 0] + rows[:, 2] - size + 1
    new = np.ones(len(rows), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (end[:-1] != rows[1:, 0])
    first = np.flatnonzero(new)
    return np.stack([rows[first, 0], rows[first, 1], np.add.reduceat(rows[:, 2] - size + 1, first) + size - 1], axis=1) if len(rows) else rows


def tile(doc_words: int, item_words: int, runs: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), longest first, from runs_of() or joined_runs()."""
    heap = [(-n, i, j) for i, j, n in runs.tolist()]
    heapq.heapify(heap)
    in_doc, in_item, tiles = np.zeros(doc_words, bool), np.zeros(item_words, bool), []
    room = True  # whether the item has size unmarked words in a row
    while heap and room:
        n, i, j = heapq.heappop(heap)
        free = ~(in_doc[i : i - n] | in_item[j : j - n])
        if free.all():
            in_doc[i : i - n] = in_item[j : j - n] = True
            tiles.append((i, j, -n))
            marks = np.flatnonzero(np.concatenate([[True], in_item, [True]]))
            room = bool(np.diff(marks).max() > size)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


#: Hits that are looked at together.
PAIRS = 1 << 20


class Seeds:
    """The seeds of some benchmark items: of size words, and of all words for shorter items."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, self.ids, words = size, [i for i, _ in items], []
        for _, _, (block,), bounds in Texts(pa.array([t or "" for _, t in items], pa.large_string())).views(span_hashes, gaps=_GAPS):
            words += [block[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.n = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.first = np.cumsum(self.n) - self.n
        self.kinds = []
        for length in range(1, size + 1):
            of = np.flatnonzero(self.n >= size if length == size else self.n == length)
            if not len(of):
                continue
            places = self.n[of] - length + 1
            owner = np.repeat(of, places)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
            hashes = rolling(self.words, length)[self.first[owner] + place]
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.kinds.append((length, hashes[order], owner[order], place[order], bits))

    def found(self, words: np.ndarray, bounds: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(text, item, seed length, tiles) for the texts with these bounds in words and the items that their seeds can cover enough of."""
        for length, hashes, owner, place, bits in self.kinds:
            rolled = rolling(words, length)
            at = np.flatnonzero(bits[(rolled >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(hashes, rolled[at], side) for side in ("left", "right"))
            text = np.searchsorted(bounds, at, "right") - 1
            real = (high > low) & (at + length <= bounds[text + 1])  # not across two texts
            at, low, high, text = at[real], low[real], high[real], text[real]
            edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
            for a, b in zip(edges[:-1], edges[1:]):
                t = int(text[a])
                own = words[bounds[t] : bounds[t + 1]]
                for item, tiles in self.tiled(own, at[a:b] - bounds[t], low[a:b], high[a:b], length, owner, place, coverage):
                    yield t, item, length, tiles

    def tiled(self, words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, owner: np.ndarray, place: np.ndarray, coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) for the items that the seeds found in a document may cover enough of."""
        # Each seed once: the places of an item that stand anywhere in the document.
        once = np.unique(low, return_index=True)[1]
        seed = spread(low[once], high[once])
        o, j = owner[seed], place[seed]
        order = np.lexsort((j, o))
        o, j = o[order], j[order]
        new = np.diff(o, prepend=-1) != 0
        reach = np.where(new, length, np.minimum(length, np.diff(j, prepend=0)))
        heads = np.flatnonzero(new)
        likely = o[heads[np.add.reduceat(reach, heads) >= coverage * self.n[o[heads]]]] if len(heads) else heads
        if not len(likely):
            return
        wanted = np.zeros(len(self.n), bool)
        wanted[likely] = True
        parts: dict[int, list[np.ndarray]] = {}
        size = high - low
        for a, b in slices(size, PAIRS):
            seed = spread(low[a:b], high[a:b])
            i, o, j = np.repeat(at[a:b], size[a:b]), owner[seed], place[seed]
            use = wanted[o]
            i, o, j = i[use], o[use], j[use]
            same = np.ones(len(i), bool)
            for k in range(length):  # word by word
                same &= words[i + k] == self.words[self.first[o] + j + k]
            i, o, j = i[same], o[same], j[same]
            order = np.argsort(o, kind="stable")
            i, o, j = i[order], o[order], j[order]
            heads = np.flatnonzero(np.diff(o, prepend=-1))
            for x, y in zip(heads, np.append(heads[1:], len(o))):
                parts.setdefault(int(o[x]), []).append(runs_of(i[x:y], j[x:y], length))
        for item in sorted(parts):
            yield item, tile(len(words), int(self.n[item]), joined_runs(parts[item], length), length)


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers low .. high - 1 of each range, one range after another."""
    n = high - low
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(low - (end - n), n)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices whose sizes add up to at most most, or that are one."""
    end, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


_SCHEMA = "doc_id long, item_id long, item_words int, covered int, tiles int, longest int, reordered boolean, coverage double"


def _contained(s: Seeds, column: pa.Array, coverage: float) -> Iterator[tuple]:
    """(row, item_id, item_words, covered, tiles, longest, reordered, coverage) for each text and item it contains."""
    for low, _, (words,), bounds in Texts(column).views(span_hashes, gaps=_GAPS):
        for text, item, length, tiles in s.found(words, bounds, coverage):
            covered, total = sum(t[2] for t in tiles), int(s.n[item])
            if tiles and covered >= coverage * total:
                turned = [t[1] for t in sorted(tiles)]
                yield low + text, s.ids[item], total, covered, len(tiles), max(t[2] for t in tiles), turned != sorted(turned), covered / total


def _report(seeds, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()]
        for batch in batches:
            columns = list(zip(*_contained(seeds.value, batch.column(1), coverage))) or [[] for _ in range(8)]
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns[1:], types))], [c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def _clean(seeds, coverage: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for found in _contained(seeds.value, batch.column(at), coverage):
                keep[found[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, size: int, block_chars: int) -> tuple[int, Iterator[Seeds]]:
    """How many blocks of about block_chars characters the benchmark has, and the seeds of each; null and empty texts are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    blocks = -(-(items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block_chars)

    def each() -> Iterator[Seeds]:
        for k in range(blocks):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
            yield Seeds(sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), size)

    return blocks, each()


def _by_block(docs: DataFrame, blocks: Iterator[Seeds], coverage: float, scratch: Scratch) -> DataFrame:
    """What each block's job finds, written; a block is forgotten before the next one is read."""
    found = []
    for seeds in blocks:
        held = docs.sparkSession.sparkContext.broadcast(seeds)
        found.append(scratch.table(docs.mapInArrow(_report(held, coverage), _SCHEMA), "found"))
        held.destroy()
    return reduce(DataFrame.union, found)


def contained_items(documents: DataFrame, benchmark: DataFrame, size: int = SEED, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, item_words, covered, tiles, longest, reordered, coverage: a row for each item a document contains.

    Null and empty texts of either table, and texts without words, contain nothing and are in nothing. Repeated documents give
    repeated rows; repeated items one row each. Null ids are carried. Empty tables give no rows. Of several longest
    matches the one that is first in the document, then in the item, is marked. Texts of any length are read whole. Other
    columns are not read.
    """
    spark = documents.sparkSession
    ship_code(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, blocks = _blocks(benchmark, size, block_chars)
    if n == 0:
        return spark.createDataFrame([], _SCHEMA)
    if n == 1:
        return docs.mapInArrow(_report(spark.sparkContext.broadcast(next(blocks)), coverage), _SCHEMA)
    return _by_block(docs, blocks, coverage, Scratch(spark, "tiles"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, size: int = SEED, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of documents that contain no item, with all their columns. Each row is judged by its own text; cases as above.

    With several blocks, the hashes of texts that contain an item are written by each block's job, and the rows that have them
    are left out by one join; with one block nothing is shuffled.
    """
    spark = documents.sparkSession
    ship_code(spark)
    n, blocks = _blocks(benchmark, size, block_chars)
    if n == 0:
        return documents
    if n == 1:
        return documents.mapInArrow(_clean(spark.sparkContext.broadcast(next(blocks)), coverage, documents.columns.index("text")), documents.schema)
    texts = documents.select(F.xxhash64("text").alias("doc_id"), "text")
    found = _by_block(texts, blocks, coverage, Scratch(spark, "tiles")).select(F.col("doc_id").alias("_found")).distinct()
    return documents.join(found, F.xxhash64(documents["text"]) == found["_found"], "left_anti")
