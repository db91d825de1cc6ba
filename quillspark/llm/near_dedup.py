"""Near-duplicates by HyperMinHash (operator 4).

Each text's distinct word shingles fall into BUCKETS buckets by their hash; a bucket keeps the leading-zero
count and the first mantissa bits of its smallest hash, one byte in all. Bands of ROWS registers propose
candidates; a collision-corrected estimate of the Jaccard similarity, with a margin of six deviations, thins
them out; full shingle sets decide, by hashes independent of those that proposed the pair. BANDS x ROWS loses a pair
at similarity 0.8 once in eight million.

Hot groups: equal sets become one class first. In each bucket only (smallest member, member) pairs are
proposed, then (most central member, member) pairs; what these join is one component. What then still shares
a bucket across components meets by its rarest shingles only, where length and place allow a link. A group of n near
copies costs about n pairs, texts that share a frequent passage cost none, and still no link is lost. What is looked up by
a key that may be hot is a written table, so that adaptive execution can split the key on both sides of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import Texts, mix, second_hashes, shingle_sets, span_hashes, stream
from quillspark.operators.components import connected_components
from quillspark.scratch import Scratch

BANDS, ROWS, MANTISSA = 40, 5, 4
BUCKETS = BANDS * ROWS
#: Order in which an empty bucket tries the others.
_TRIES = np.argsort(stream(41, BUCKETS * BUCKETS).reshape(BUCKETS, BUCKETS), axis=1).astype(np.int64)
_BAND = stream(43, BANDS)
_SET = stream(47, 2)


def registers(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of registers for each set, one byte a bucket; empty buckets borrow in their own order.

    shingles: the sets' sorted distinct hashes one set after another; sizes: how many each set has. Empty sets give zeros.
    """
    scaled = (shingles >> np.uint64(32)) * np.uint64(BUCKETS)
    cell = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + (scaled >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    rest = (scaled[first] & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
    fraction, exponent = np.frexp(np.maximum(rest, 2.0**-15))  # rest = fraction * 2**exponent, fraction in [0.5, 1)
    out, empty = np.zeros(len(sizes) * BUCKETS, np.uint8), np.ones(len(sizes) * BUCKETS, bool)
    out[cell[first]] = np.minimum(-exponent, 15) * (1 << MANTISSA) + ((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    empty[cell[first]] = False
    left = np.flatnonzero(empty & np.repeat(sizes > 0, BUCKETS))
    base, bucket, t = left - left % BUCKETS, left % BUCKETS, 0
    while len(left):
        tried = base + _TRIES[bucket, t]
        ok = ~empty[tried]
        out[left[ok]] = out[tried[ok]]
        left, base, bucket, t = left[~ok], base[~ok], bucket[~ok], t + 1
    return out.reshape(-1, BUCKETS)


def _collisions() -> np.ndarray:
    """How often registers of unrelated sets agree, by log2 of the hashes in a bucket (halves from 0 to 24)."""
    k = 2.0 ** (np.arange(49) / 2)
    zeros, mantissa = np.divmod(np.arange(16 << MANTISSA), 1 << MANTISSA)
    low = (1 + mantissa / (1 << MANTISSA)) * 2.0 ** -(zeros + 1)
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    low[low <= 2.0**-15 * 1.0001] = 0
    cells = np.exp(-np.outer(k, low)) - np.exp(-np.outer(k, high))
    return cells @ cells.T


_CHANCE = _collisions()


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketch rows: the share of agreeing registers, less what chance brings."""
    step = lambda n: np.clip(np.round(2 * np.log2(np.maximum(1, n / BUCKETS))), 0, 48).astype(np.int64)
    chance = _CHANCE[step(size_a), step(size_b)]
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n", "h1", "h2", "regs"]
        for batch in batches:
            for low, high, (one, two), bounds in Texts(batch.column(2)).views(span_hashes, second_hashes):
                first, second = (list(shingle_sets(view, bounds, size)) for view in (one, two))
                n = np.array([len(s) for s in first])
                flat = np.concatenate(first)
                h1, h2 = set_hashes(flat, n, 0), set_hashes(np.concatenate(second), np.array([len(s) for s in second]), 1)
                offsets = pa.py_buffer((np.append(0, np.cumsum(n > 0)) * BUCKETS).astype(np.int32))
                regs = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(registers(flat, n)[n > 0].tobytes())])
                yield pa.record_batch([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), regs], names)

    return run


def set_hashes(shingles: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """A hash of each set, zero for empty ones."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles ^ _SET[which]), out=total[1:])
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)
    for batch in batches:
        for low in range(0, len(batch), 2048):
            part = batch.slice(low, 2048)
            regs = Texts(part.column(2)).raw_rows(BUCKETS).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = mix((regs * weights).sum(axis=2, dtype=np.uint64) ^ _BAND)
            node, n = (np.repeat(np.asarray(part.column(i)), BANDS) for i in (0, 1))
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(n)], ["key", "node", "n"])


def _estimates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {k: batch.column(k) for k in batch.schema.names}
            na, nb = np.asarray(col["na"]), np.asarray(col["nb"])
            found = estimate(Texts(col["ra"]).raw_rows(BUCKETS), Texts(col["rb"]).raw_rows(BUCKETS), na, nb)
            margin = 6 * np.sqrt(threshold * (1 - threshold) / np.minimum(np.minimum(na, nb), BUCKETS))
            yield pa.record_batch([col["a"], col["b"]], ["a", "b"]).filter(pa.array(found >= threshold - margin))

    return run


def _sets(size: int):
    """(node, shingles) of the texts that have the node's set; a text that stands in several rows once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for low, high, (two,), bounds in Texts(batch.column(2)).views(second_hashes):
                sets = list(shingle_sets(two, bounds, size))
                same = set_hashes(np.concatenate(sets), np.array([len(s) for s in sets]), 1).view(np.int64) == np.asarray(batch.column(1).slice(low, high - low))
                nodes = batch.column(0).slice(low, high - low).to_pylist()
                use = [i for i, node in enumerate(nodes) if same[i] and node not in seen and not seen.add(node)]
                nodes, sets = [nodes[i] for i in use], [sets[i].tobytes() for i in use]
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Counters that rank shingles by frequency, few or many texts alike: any ranking keeps the third pass exact.
SLOTS = 1 << 20


def _flat(column: pa.Array) -> np.ndarray:
    """All hashes of a binary column."""
    texts = Texts(column)
    return texts.raw[texts.starts[0] : texts.ends[-1]].view(np.uint64) if len(texts) else np.zeros(0, np.uint64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        counts += np.bincount((_flat(batch.column(0)) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
    used = np.flatnonzero(counts)
    for low in range(0, len(used), 1 << 16):
        part = used[low : low + (1 << 16)]
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(counts[part])], ["slot", "count"])


def _prefixes(percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, few = [np.zeros(0, np.uint64)], np.zeros(len(batch), np.int64)
            for i, v in enumerate(batch.column("shingles")):
                s = np.frombuffer(v.as_buffer(), np.uint64)
                few[i] = len(s) - -(-percent * len(s) // 100) + 1
                found.append(s[np.lexsort((s, counts.value[(s >> np.uint64(44)).astype(np.int64)]))[: few[i]]])
            token, end = np.concatenate(found), np.cumsum(few)
            place = (np.arange(len(token)) - np.repeat(end - few, few)).astype(np.int32)
            same = [pa.array(np.repeat(np.asarray(batch.column(k)), few)) for k in ("node", "n", "part")]
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(place), *same], ["token", "place", "node", "n", "part"])

    return run


def _joined(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, part) two steps along links: enough for stars. What it leaves apart only costs more pairs to look at."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    near = scratch.table(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("low")), "near")
    far = near.select(F.col("node").alias("low"), F.col("low").alias("lower"))
    return scratch.table(near.join(far, "low", "left").select("node", F.coalesce("lower", "low").alias("part")), "parts")


#: Rows of a token that one task compares with what meets them.
SPLIT = 1024


def _met(prefix: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, na, nb) across parts that share a prefix token and whose lengths and places allow a link.

    Of a token's parts the most frequent one is only met by the others, never by itself. What lengths and places allow is found
    once for all rows that agree in them; rows then meet in groups of SPLIT, so that a token of many rows is many tasks.
    """
    close = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    # What two sets can have in common from their first common shingle on must reach the threshold.
    enough = f"least(x.n - x.place, y.n - y.place) * {100 + percent} >= {percent} * (x.n + y.n)"
    per_part = prefix.groupBy("token", "part").count()
    tokens = per_part.groupBy("token").agg(F.max(F.struct("count", "part"))["part"].alias("major"), F.count("*").alias("parts"), F.ceil(F.sum("count") / SPLIT).alias("groups")).where("parts > 1")
    shared = scratch.table(prefix.join(scratch.table(tokens, "tokens"), "token"), "shared")
    # Sets whose lengths allow a link stand in the same or in neighbouring length classes.
    length = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))) if percent < 100 else F.col("n")
    kinds = scratch.table(shared.groupBy("token", "n", "place", "groups").agg(F.count_if(F.col("part") != F.col("major")).alias("minors")).withColumn("length", length), "kinds")
    x = kinds.where("minors > 0").withColumn("length", F.explode(F.array(*(F.col("length") + i for i in (-1, 0, 1))))).alias("x")
    both = x.join(kinds.alias("y"), F.expr(f"x.token = y.token AND x.length = y.length AND {close} AND {enough}"))
    both = both.select("x.token", F.col("x.n").alias("na"), F.col("x.place").alias("pa"), F.col("y.n").alias("nb"), F.col("y.place").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("x.groups") - 1)).alias("group"))
    left = shared.where("part <> major").select("token", F.col("n").alias("na"), F.col("place").alias("pa"), F.col("node").alias("a"), F.col("part").alias("part_a"))
    right = shared.select("token", F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("node").alias("b"), F.col("part").alias("part_b"), F.pmod(F.xxhash64("node"), "groups").alias("group"))
    met = both.join(left, ["token", "na", "pa"]).join(right, ["token", "nb", "pb", "group"]).where("part_a <> part_b")
    low, high = (F.expr(f"{f}(struct(a AS node, na AS n), struct(b AS node, nb AS n))") for f in ("least", "greatest"))
    return met.select(low.alias("p"), high.alias("q")).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept, text_hash, chosen: one row for each input row.

    Two texts are linked when 100 * |common| >= percent * |union| of their distinct shingles of size words;
    component_id is the smallest doc_id that links reach; kept marks that document. text_hash is Spark's xxhash64 of the text;
    doc_id and text_hash name rows, and chosen marks one such name in each component.

    Texts that are null, empty or without words have no shingles and no links: component_id is their own id, and they are
    chosen. Equal sets (exact copies, repeated rows) are linked; repeated rows are chosen together. Rows with a null doc_id join a
    component but never name one: with none but such rows, component_id is null and kept is true. Rows that share a doc_id and
    differ in text are linked only by their texts; where that id names a component, kept holds for each that it has. Texts are
    read whole, however long. Other columns are not read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sketches = scratch.table(docs.mapInArrow(_sketch(size), "doc_id long, text_hash long, n long, h1 long, h2 long, regs binary"), "sketches")

    # Classes of equal sets; each is one node with one representative row, that of its smallest doc_id. Nodes are numbered in
    # order of that id, so that all buckets of a group tend to have the same smallest member, and with it few pairs.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n", "regs")).alias("m")
    classes = sketches.where("n > 0").groupBy("h1", "h2").agg(least).select("h1", "h2", *(F.col(f"m.{c}").alias(r) for c, r in (("doc_id", "rep"), ("text_hash", "rep_hash"), ("n", "n"), ("regs", "regs"))))
    order = [F.asc_nulls_last("rep"), F.asc("rep_hash")]
    nodes = scratch.table(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Members of the buckets that hold several nodes, and their full sets.
    bands = nodes.select("node", "n", "regs").mapInArrow(_bands, "key long, node long, n long")
    leads = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).where("lead.node < last").select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))
    leads = scratch.table(leads, "leads")
    members = scratch.table(bands.join(leads, "key"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "h2", "rep", F.col("rep_hash").alias("text_hash"))
    found = docs.join(wanted.hint("merge"), (docs["text_hash"] == wanted["text_hash"]) & docs["doc_id"].eqNullSafe(wanted["rep"]))
    sets = scratch.table(found.select("node", "h2", "text").mapInArrow(_sets(size), "node long, shingles binary"), "sets")

    def close(a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Which of the pairs (a, b, na, nb) are links: first by the sketches' estimate, then on full sets."""
        side = lambda k: nodes.select(F.col("node").alias(k), F.col("regs").alias(f"r{k}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimates(percent / 100), "a long, b long")
        full = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))
        return scratch.table(likely.join(full("a"), "a").join(full("b"), "b").mapInArrow(_verify(percent), "a long, b long").distinct(), f"{name}-links")

    def open_members(parts: DataFrame, name: str) -> DataFrame:
        """Members of buckets that still span several components."""
        placed = members.select("key", "node", "n").join(parts, "node", "left").select("key", "node", "n", F.coalesce("part", "node").alias("part"))
        keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("together")).where("low < high").select("key", "together")
        return scratch.table(placed.join(scratch.table(keys, f"{name}-keys"), "key"), name)

    # First pass: each bucket's smallest member with the others.
    star = members.where(f"node <> lead AND {close('n', 'lead_n')}").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead_n").alias("na"), F.col("n").alias("nb")).distinct()
    links = confirmed(star, "star")

    # Second pass: the member with most company in all its buckets, the original of scattered copies, with the others.
    rest = open_members(_joined(links, scratch), "open")
    company = rest.groupBy("node").agg(F.sum("together").alias("company"))
    middle = rest.join(company, "node").groupBy("key").agg(F.max(F.struct("company", F.negative("node").alias("minus"), "n", "part")).alias("m")).select("key", F.negative("m.minus").alias("a"), F.col("m.n").alias("na"), F.col("m.part").alias("pa"))
    hub = rest.join(scratch.table(middle, "middle"), "key").where(f"part <> pa AND {close('n', 'na')}").select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).distinct()
    links = links.union(confirmed(hub, "hub"))

    # Third pass, for what still shares a bucket across components: a pair at the threshold shares one of the
    # (100 - percent) % rarest shingles of both sets, so that common passages propose nothing.
    rest = open_members(_joined(links, scratch), "still-open").select("node", "n", "part").distinct()
    alone = scratch.table(rest.join(sets, "node").dropDuplicates(["node"]), "alone")
    counts = np.zeros(SLOTS, np.int64)
    met = alone.select("shingles").mapInArrow(_slot_counts, "slot int, count long").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()
    counts[met["slot"].to_numpy()] = met["count"].to_numpy()  # SLOTS rows at most
    prefix = scratch.table(alone.mapInArrow(_prefixes(percent, spark.sparkContext.broadcast(counts)), "token long, place int, node long, n long, part long"), "prefixes")
    links = links.union(confirmed(_met(prefix, percent, scratch), "across"))

    # Components take the smallest doc_id that they hold, and the row that has it.
    parts = connected_components(links, scratch, "a", "b")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_hash", "node")).alias("f")
    named = scratch.table(parts.join(nodes.select("node", "rep", "rep_hash"), "node").groupBy("component").agg(first).select("component", F.col("f.rep").alias("low"), F.col("f.node").alias("first")), "named")
    placed = nodes.select("node", "h1", "h2", "rep", "rep_hash").join(parts.join(named, "component"), "node", "left")
    placed = placed.select("h1", "h2", "rep", "rep_hash", F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("low")).alias("low"), (F.col("first").isNull() | (F.col("first") == F.col("node"))).alias("leads"))
    rows = sketches.select("doc_id", "text_hash", "n", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    chosen = (F.col("n") == 0) | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", chosen.alias("chosen"))
    result = scratch.table(out, "result")
    scratch.drop_all(but=result)
    return result
