"""Token ids as Parquet list columns (operator 6).

Texts are range-partitioned and sorted by doc_id, encoded by a public tokenizer, and written as one file for each
range: a list column of ids, dictionary-encoded (or delta-encoded, format version 2, where asked for), with
controlled row groups and pages, and page indexes, so that readers fetch the metadata columns or some documents' ids
alone. Each row has its place in its shard; the few shard totals give global offsets, so no window spans the corpus.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import shards
from quillspark.llm.text import BLOCK, EXACT, EXACT_2, Texts, hashes, mix
from quillspark.scratch import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
#: Units whose ids a worker remembers (about 40 bytes each); beyond it, it forgets all and goes on.
REMEMBERED = 1_000_000
#: Bytes of a row group and of a page, before compression.
ROW_GROUP, PAGE = 16 << 20, 256 << 10


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEN = np.zeros(256, bool)
_SEEN[33:127] = _SEEN[128:] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _SEEN & ~_LETTER
_MARK[128:] = False
#: First bytes of the white space beyond ASCII, among others.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer that splits words before spaces.

    The tokenizer never keeps a visible character together with white space after it, nor a letter with a mark or digit
    after it, and it reads from left to right: between two such places a text is a unit of its own. Each unit is encoded
    once and remembered by two independent hashes of 64 bits; texts are then looked up unit by unit. Texts that may hold other white space,
    or what looks like a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(1 << 21, -1, np.int32)
        self.n, self.used = 0, 0
        self.one, self.two = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def find(self, one: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 for unknown ones."""
        out = np.full(len(one), -1, np.int64)
        left, at = np.arange(len(one)), (one >> np.uint64(43)).astype(np.int64)
        while len(left):
            entry = self.slots[at].astype(np.int64)
            hit = (entry >= 0) & (self.one[entry] == one[left])
            out[left[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember units; one: distinct unknown hashes."""
        end, used = self.n + len(one), self.used + len(ids)
        while end > len(self.one):
            self.one, self.two, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.one, self.two, self.start, self.size))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = slice(self.n, end)
        self.one[new], self.two[new], self.size[new] = one, two, sizes
        self.start[new] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = ids
        left, at = np.arange(self.n, end), (one >> np.uint64(43)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            on = self.slots[at] != left
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        self.n, self.used = end, used

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of units. Those of a space and visible characters go in one call, cut where ids begin with a space."""
        sizes, parts = np.zeros(len(units), np.int64), []
        joined = [i for i, u in enumerate(units) if u[0] == 32 and len(u) > 1 and _SEEN[u[1]] and u.count(b" ") == 1]
        single = sorted(set(range(len(units))).difference(joined))
        for low in range(0, len(joined), 4000):
            part = joined[low : low + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(units[i] for i in part).decode()], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) != len(part):
                raise ValueError("the tokenizer doesn't begin a word at each space")
            sizes[part] = np.diff(cuts, append=len(ids))
            parts.append(ids)
        for e in self.tokenizer.encode_batch_fast([units[i].decode() for i in single], add_special_tokens=False) if single else ():
            parts.append(np.array(e.ids, np.int32))
        sizes[single] = [len(p) for p in parts[len(parts) - len(single) :]] if single else []
        order = np.array(joined + single, np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.zeros(len(units), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return gathered(flat, at, sizes), sizes

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        parts, counts = [], []
        for low, high in texts.blocks():
            raw = texts.raw[int(texts.starts[low]) : int(texts.ends[high - 1])]
            firsts, lasts = (x[low:high] - texts.starts[low] for x in (texts.starts, texts.ends))
            odd = self.odd(raw, firsts, lasts)
            ids, n = self.looked_up(raw, firsts, lasts, odd)
            if odd.any():
                edges = np.append(0, np.cumsum(n))
                rows = [self.whole(raw[firsts[i] : lasts[i]].tobytes().decode()) if odd[i] else ids[edges[i] : edges[i + 1]] for i in range(high - low)]
                ids, n = np.concatenate(rows), np.array([len(x) for x in rows])
            parts.append(ids)
            counts.append(n)
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    @staticmethod
    def odd(raw: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """Which texts are encoded whole."""
        bad = _DOUBT[raw]
        bad[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        total = np.append(0, np.cumsum(bad))
        return total[lasts] > total[firsts]

    def looked_up(self, raw: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of the texts that aren't odd; odd ones have none here."""
        begins = np.zeros(len(raw), bool)
        before, here = raw[:-1], raw[1:]
        begins[1:] = (_SEEN[before] & _SPACE[here]) | (_LETTER[before] & _MARK[here])
        begins[firsts[lasts > firsts]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        if odd.any():
            full = np.flatnonzero(lasts > firsts)
            use = ~odd[full[np.searchsorted(firsts[full], starts, "right") - 1]]
            starts, ends = starts[use], ends[use]
        low, out, sizes = 0, [], []
        while low < len(starts):  # a very long text in parts
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK, "right")))
            base, end = int(starts[low]), int(ends[high - 1])
            part, s, e = raw[base:end], starts[low:high] - base, ends[low:high] - base
            entry = self.entries(part, s, e)
            size = self.size[entry]
            out.append(gathered(self.ids, self.start[entry], size))
            sizes.append(size)
            low = high
        total = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        n = total[np.searchsorted(starts, lasts)] - total[np.searchsorted(starts, firsts)]
        return np.concatenate(out) if out else np.zeros(0, np.int32), n

    def entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = hashes(raw, starts, ends, EXACT, EXACT_2)
        if self.n + len(one) > REMEMBERED and self.n:
            self.forget()
        return self.known(one, two, raw, starts, ends)

    def known(self, one: np.ndarray, two: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of units, new ones learned. Units that share the first hash only get another one from both hashes."""
        entry = self.find(one)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            new, first = np.unique(one[unknown], return_index=True)
            rows = unknown[first]
            ids, sizes = self.learn([raw[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())])
            self.add(new, two[rows], ids, sizes)
            entry[unknown] = self.find(one[unknown])
        other = np.flatnonzero(self.two[entry] != two)
        if len(other):
            entry[other] = self.known(mix(one[other] ^ two[other]), two[other], raw, starts[other], ends[other])
        return entry


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    end = np.cumsum(sizes)
    total = int(end[-1]) if len(end) else 0
    return values[np.arange(total) + np.repeat(starts - (end - sizes), sizes)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process: its tasks share what it remembers."""
    return Encoder(path)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard, offset = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.slice(low, 1024)
                flat, n = own.encode(Texts(part.column(1)))
                at = np.append(0, np.cumsum(n + 1))
                values = np.full(at[-1], end, np.int32)
                inner = np.ones(at[-1], bool)
                inner[at[1:] - 1] = False
                values[inner] = flat
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
                yield pa.record_batch([part.column(0), pa.array(np.full(len(part), shard, np.int32)), pa.array(offset + at[:-1]), pa.array(n + 1), lists], ["doc_id", "shard", "shard_offset", "n_tokens", "ids"])
                offset += int(at[-1])

    return run


#: Characters of a text by which rows of one id are dealt to shards.
BEGINNING = 256


def write_tokens(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, delta: bool = False) -> None:
    """Write doc_id, shard, shard_offset, n_tokens, ids of every whole text in ascending doc_id order.

    A null text is empty and has the end id alone; a null doc_id comes first; rows that share a doc_id stand together,
    in order of their texts, over several shards where they are many and differ in their first BEGINNING characters, or are shorter;
    an empty table gives an empty folder. Other columns are not written.
    delta: format version 2, whose ids and offsets are delta-packed, in place of dictionaries.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = shards(spark, docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0])
    begins = F.substring("text", 1, BEGINNING)
    # Equal rows have no order of their own, so that their number may part them.
    salt = F.when(F.length("text") < BEGINNING, F.monotonically_increasing_id()).otherwise(F.lit(0))
    ordered = docs.repartitionByRange(n, "doc_id", begins, salt).sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_encode(vocabulary, end), "doc_id long, shard int, shard_offset long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.enable.dictionary": not delta, "parquet.writer.version": "PARQUET_2_0" if delta else "PARQUET_1_0"}
    rows.write.options(**options).parquet(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = np.asarray(lists.offsets)
        raw = memoryview(np.ascontiguousarray(np.asarray(lists.values)).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_offset", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: start counts the ids of all documents before."""
    files = spark.read.schema("doc_id long, shard int, shard_offset long, n_tokens long, ids array<int>").parquet(path)
    # Only metadata columns are read for the totals; there is one row for each shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sums = files.select("doc_id", "shard", "shard_offset", "ids").mapInArrow(_checksums, "doc_id long, shard int, shard_offset long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(totals), "shard").select("doc_id", (F.col("base") + F.col("shard_offset")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(documents: DataFrame, vocabulary: str = VOCABULARY, end: int = END, delta: bool = False) -> DataFrame:
    """Write the files in the shared folder and read their digest back."""
    path = Scratch(documents.sparkSession, "tokens").path("ids")
    write_tokens(documents, path, vocabulary, end, delta)
    return read_tokens(documents.sparkSession, path)
