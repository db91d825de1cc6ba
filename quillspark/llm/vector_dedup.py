"""Near-duplicate vectors (operator 13): a forest of random-projection trees.

Each tree splits vectors by their projection on a random direction, at the median; vectors within half a typical distance of two
linked vectors fall on both sides (spill). Vectors meet in the leaves of TREES trees, in blocks of about LEAF, as products of
matrices. The trees' tops are fitted on a bounded sample; leaves that still hold more than LEAF vectors are split in
further rounds, all at once, by medians of all their vectors, until spill makes a split useless.

A pair counts in the first leaf, by number, that it shares, so no pair is ever listed for its count; a block passes on each
vector's number of links, and a spanning forest of them. Vectors travel as 16-bit parts; where their products are too near the
threshold to tell, the pair is decided by the vectors themselves, in double precision.

Hot groups: equal vectors are one node. Where the sample is dense, the vectors within half the threshold's angle of a centre are a
cell: any two of them are linked for certain, so that a group of n near copies costs n comparisons. Vectors outside a cell, but
close enough to it to have links inside (its fringe), are compared with all its members, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.whitening import finite_matrices
from quillspark.operators.components import connected_components
from quillspark.scratch import Scratch, ship_code

COSINE, TREES, LEAF = 0.95, 6, 1024
#: Bounds of the sample that the trees' tops and the cells' centres are fitted on. Every vector is indexed.
SAMPLE, SAMPLE_BYTES, CENTRE_SAMPLE, CENTRES = 16384, 16 << 20, 4096, 256
#: Least sampled vectors in a leaf of a tree's top, and around a centre.
FEWEST, DENSE = 24, 8
#: A split is made at whichever of the middle marks of the projections has fewest marks within its spill, so that dense groups stay on one side;
#: it is useless where that is USELESS marks or more.
MARKS = tuple(k / 20 for k in range(1, 20))
MIDDLE, USELESS = (6, 14), 14
STEPS = 32767


def _units(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows aren't zero, and those rows at length one; scaled first, so that no square over- or underflows."""
    top = np.abs(entries).max(axis=1)
    rows = np.flatnonzero(top > 0)
    scaled = entries[rows] / top[rows, None]
    return rows, scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key: equal for equal vectors, null for those that link with nothing; parts: the vector at length one in 16-bit steps."""
    for batch in batches:
        key, parts = [None] * len(batch), [None] * len(batch)
        for _, rows, entries in finite_matrices(batch.column(1)):
            some, unit = _units(entries)
            short = np.round(unit * STEPS).astype(np.int16)
            for r, e, q in zip(rows[some], entries[some] + 0.0, short):
                key[r], parts[r] = md5(e.tobytes()).digest(), q.tobytes()
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(parts, pa.binary())], ["vec_id", "embedding", "key", "parts"])


@dataclass
class Geometry:
    """What the cosine and the vectors' length imply."""

    length: int
    cosine: float

    def __post_init__(self):
        angle = np.arccos(self.cosine)
        step = np.sqrt(self.length) / 2 / STEPS  # how far rounding moves a vector, at most
        slack = 4 * step + 1e-3
        #: Products of rounded vectors this close to the threshold don't tell.
        self.doubt = 2.2 * step + 1e-6 + 2e-7 * self.length
        self.half, self.reach = np.cos(max(0.0, angle / 2 - slack)), np.cos(min(np.pi, 1.5 * angle + slack))
        self.spill = 0.5 * np.sqrt(2 * (1 - self.cosine) / self.length)


def _direction(path: int, length: int) -> np.ndarray:
    v = np.random.Generator(np.random.PCG64(path & (2**63 - 1))).standard_normal(length)
    return (v / np.linalg.norm(v)).astype(np.float32)


def _child(path: int, side: int) -> int:
    """A 64-bit number for each place in a tree; signed, as Spark holds it."""
    return int.from_bytes(blake2b(f"{path}:{side}".encode(), digest_size=8).digest(), "big", signed=True)


class Forest:
    """Centres of cells and tops of trees for vectors of one length."""

    def __init__(self, sample: np.ndarray, geometry: Geometry, target: int, trees: int):
        self.geometry, length = geometry, geometry.length
        self.centres = _centres(sample[:CENTRE_SAMPLE], geometry)
        alone = sample[(sample @ self.centres.T).max(axis=1, initial=-1) < geometry.half]
        self.directions, self.cuts, self.next, self.roots = [], [], [], []
        for tree in range(trees):
            self.roots.append(self._grow(alone, _child(_child(tree, 0), length), max(target, FEWEST)))
        self.directions = np.array(self.directions, np.float32).reshape(-1, length)

    def _grow(self, rows: np.ndarray, path: int, target: int) -> tuple[bool, int]:
        """(is a leaf, its path) or (is none, place of the split)."""
        if len(rows) <= target:
            return True, path
        direction = _direction(path, self.geometry.length)
        at, w = rows @ direction, self.geometry.spill
        marks = np.quantile(at, MARKS)
        middle = marks[MIDDLE[0] - 1 : MIDDLE[1]]
        both = (np.abs(marks - middle[:, None]) <= w).sum(axis=1)
        if both.min() >= USELESS:
            return True, path
        cut = middle[both.argmin()]
        me = len(self.cuts)
        self.directions.append(direction)
        self.cuts.append(float(cut))
        self.next.append(None)
        self.next[me] = [self._grow(rows[at <= cut + w], _child(path, 0), target), self._grow(rows[at > cut - w], _child(path, 1), target)]
        return False, me

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf of each row."""
        rows, leaves, w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], self.geometry.spill
        open_ = [(root, np.arange(len(q))) for root in self.roots]
        while open_:
            (leaf, where), idx = open_.pop()
            if leaf:
                rows.append(idx)
                leaves.append(np.full(len(idx), where, np.int64))
            elif len(idx):
                at = q[idx] @ self.directions[where]
                open_ += [(self.next[where][0], idx[at <= self.cuts[where] + w]), (self.next[where][1], idx[at > self.cuts[where] - w])]
        return np.concatenate(rows), np.concatenate(leaves)


def _centres(sample: np.ndarray, geometry: Geometry) -> np.ndarray:
    """Means of dense groups of the sample, densest first."""
    near = sample @ sample.T >= geometry.cosine
    degree = near.sum(axis=1)
    open_, found = np.ones(len(sample), bool), []
    while len(found) < CENTRES and len(sample) and degree.max() >= DENSE:
        at = int(degree.argmax())
        centre = sample[near[at] & open_].mean(axis=0)
        centre /= np.linalg.norm(centre)
        inside = open_ & (sample @ centre >= geometry.half)
        if inside.sum() >= DENSE // 2:
            found.append(centre)
        inside[at] = True
        open_ &= ~inside
        degree = np.where(open_, degree - near[:, inside].sum(axis=1), 0)
    return np.array(found, np.float32).reshape(-1, geometry.length)


def _vectors(column: pa.Array, length: int, rows: np.ndarray) -> np.ndarray:
    """16-bit parts as single-precision vectors."""
    parts = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).take(pa.array(rows))
    start, end = (int(np.frombuffer(parts.buffers()[1], np.int32)[parts.offset + i]) for i in (0, len(parts)))
    return np.frombuffer(parts.buffers()[2], np.uint8)[start:end].view(np.int16).reshape(len(rows), length).astype(np.float32) / STEPS


def _routed(model, cosine: float, trees: int):
    """For each node its cell, the cells whose fringe it is in, and its leaves (none where it has a cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = dict(model.value)
        for batch in batches:
            lengths = np.asarray(batch.column(1))
            cell, fringe, leaves = np.full(len(batch), -1, np.int64), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for length in np.unique(lengths):
                length = int(length)
                if length not in forests:
                    forests[length] = Forest(np.zeros((0, length), np.float32), Geometry(length, cosine), 1, trees)
                f, rows = forests[length], np.flatnonzero(lengths == length)
                q = _vectors(batch.column(2), length, rows)
                if len(f.centres):
                    to = q @ f.centres.T
                    best = to.argmax(axis=1)
                    inside = to.max(axis=1) >= f.geometry.half
                    cell[rows[inside]] = length * CENTRES + best[inside]
                    own = np.where(inside, best, CENTRES)
                    for r, c in zip(*np.nonzero((to >= f.geometry.reach) & (np.arange(len(f.centres)) < own[:, None]))):
                        fringe[rows[r]].append(length * CENTRES + int(c))
                else:
                    inside = np.zeros(len(rows), bool)
                free = rows[~inside]
                for r, leaf in zip(*f.leaves(q[~inside])):
                    leaves[free[r]].append(int(leaf))
            yield pa.record_batch([batch.column(0), pa.array(cell, pa.int64(), mask=cell < 0), pa.array(fringe, pa.list_(pa.int64())), pa.array(leaves, pa.list_(pa.int64()))], ["node", "cell", "fringe", "leaves"])

    return run


def _projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf, length, at = np.asarray(batch.column(0)), np.asarray(batch.column(2)), np.zeros(len(batch))
        for one in np.unique(leaf):
            rows = np.flatnonzero(leaf == one)
            at[rows] = _vectors(batch.column(3), int(length[rows[0]]), rows) @ _direction(int(one), int(length[rows[0]]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at), batch.column(2)], ["leaf", "node", "at", "length"])


def _split_further(routed: DataFrame, nodes: DataFrame, leaf_rows: int, cosine: float, scratch: Scratch) -> DataFrame:
    """routed with leaves of at most leaf_rows nodes, where splits are of use: one level of all larger leaves a round."""
    at = routed.select("node", F.explode("leaves").alias("leaf"))
    large = at.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).select("leaf")
    large = scratch.table(large, "large")
    if large.isEmpty():
        return routed
    settled = scratch.table(at.join(large, "leaf", "left_anti"), "settled")
    open_ = scratch.table(at.join(large, "leaf"), "open")
    done = [settled]
    while not open_.isEmpty():
        seen = open_.join(nodes.select("node", "length", "parts"), "node").select("leaf", "node", "length", "parts")
        seen = scratch.table(seen.mapInArrow(_projections, "leaf long, node long, at double, length int"), "projections")
        spill = 0.5 * F.sqrt(F.lit(2 * (1 - cosine)) / F.first("length"))
        cuts = seen.groupBy("leaf").agg(F.percentile_approx("at", list(MARKS), 1000).alias("q"), spill.alias("w"))
        middle = F.slice("q", MIDDLE[0], MIDDLE[1] - MIDDLE[0] + 1)
        both = lambda c: F.size(F.filter("q", lambda m: F.abs(m - c) <= F.col("w")))
        best = F.array_min(F.transform(middle, lambda c: F.struct(both(c).alias("both"), c.alias("cut"))))
        cuts = cuts.select("leaf", F.when(best["both"] < USELESS, best["cut"]).alias("cut"), "w", F.xxhash64("leaf", F.lit(0)).alias("l"), F.xxhash64("leaf", F.lit(1)).alias("r"))  # a row a leaf
        cut = seen.join(scratch.table(cuts, "cuts"), "leaf")
        sides = F.array_compact(F.array(F.when(F.col("at") <= F.col("cut") + F.col("w"), F.col("l")), F.when(F.col("at") > F.col("cut") - F.col("w"), F.col("r"))))
        made = scratch.table(cut.where("cut IS NOT NULL").select("node", F.explode(sides).alias("leaf")), "halves")
        large = scratch.table(made.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).select("leaf"), "large")
        done += [scratch.table(cut.where("cut IS NULL").select("node", "leaf").union(made.join(large, "leaf", "left_anti").select("node", "leaf")), "settled")]
        open_ = scratch.table(made.join(large, "leaf").select("leaf", "node"), "open")
    every = done[0].select("node", "leaf")
    for more in done[1:]:
        every = every.union(more.select("node", "leaf"))
    lists = every.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # some leaves of each tree
    return scratch.table(routed.drop("leaves").join(lists, "node", "left").select("node", "cell", "fringe", F.coalesce("leaves", F.array().cast("array<long>")).alias("leaves")), "refined")


def _compared(cosine: float):
    """A block of rows, or two: numbers of links, a spanning forest of them, and pairs that rounding leaves open."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, w, side = (table[c].to_numpy() for c in ("node", "w", "side"))
        length, within = table["length"][0].as_py(), table["within"][0].as_py()
        geometry = Geometry(length, cosine)
        a = np.arange(len(node)) if within else np.flatnonzero(side == 0)
        b = a if within else np.flatnonzero(side == 1)
        earlier = _padded(table["earlier"].to_pylist())
        count, sure, open_ = np.zeros(len(node), np.int64), [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        qa, qb = _vectors(table["parts"], length, a), _vectors(table["parts"], length, b)
        for low in range(0, len(a), 256):
            product = qa[low : low + 256] @ qb.T
            i, j = np.nonzero(product >= cosine - geometry.doubt)
            value, i, j = product[i, j], a[i + low], b[j]
            if within:
                value, i, j = value[i < j], i[i < j], j[i < j]
            mine = ~_share(earlier, i, j)
            clear = value >= cosine + geometry.doubt
            for chosen, into in ((mine & clear, sure), (mine & ~clear, open_)):
                into.append(np.column_stack([i[chosen], j[chosen]]))
            np.add.at(count, i[mine & clear], w[j[mine & clear]])
            np.add.at(count, j[mine & clear], w[i[mine & clear]])
        sure, open_ = np.concatenate(sure), np.concatenate(open_)
        lead = _leads(len(node), sure)
        joined, counted = np.flatnonzero(lead != np.arange(len(node))), np.flatnonzero(count)
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(counted), len(joined), len(open_)])
        x = np.concatenate([node[counted], node[joined], node[open_[:, 0]]])
        y = np.concatenate([count[counted], node[lead[joined]], node[open_[:, 1]]])
        return pa.table({"kind": kinds.astype(np.int32), "x": x, "y": y})

    return run


def _padded(lists: list[list[int]]) -> np.ndarray:
    """Lists as rows of one width, filled up with noughts."""
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


def _share(earlier: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j have one of the earlier leaves in common."""
    shared = np.zeros(len(i), bool)
    for k in range(earlier.shape[1]):
        mine = earlier[i, k]
        for m in range(earlier.shape[1]):
            shared |= (mine != 0) & (mine == earlier[j, m])
    return shared


def _leads(n: int, pairs: np.ndarray) -> np.ndarray:
    """The first row that each row reaches by the pairs."""
    lead = np.arange(n)
    while len(pairs):
        before = lead.copy()
        low = np.minimum(lead[pairs[:, 0]], lead[pairs[:, 1]])
        np.minimum.at(lead, pairs[:, 0], low)
        np.minimum.at(lead, pairs[:, 1], low)
        lead = lead[lead]
        if (lead == before).all():
            break
    return lead


def _exact(cosine: float):
    """Pairs whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for _, rows, x in finite_matrices(batch.column(4)):
                y = np.array([v.as_py() for v in batch.column(5).take(pa.array(rows))], np.float64)
                keep[rows] = (_units(x)[1] * _units(y)[1]).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(keep))

    return run


def _fitted(nodes: DataFrame, cosine: float, trees: int, leaf_rows: int) -> dict[int, Forest]:
    """A forest for each length of vector in the sample: at most SAMPLE vectors of about SAMPLE_BYTES, those of the smallest hashes."""
    n, length = nodes.agg(F.count("*"), F.avg("length")).first()
    if not n:
        return {}
    limit = max(1, min(SAMPLE, int(SAMPLE_BYTES / 2 / length)))
    rows = nodes.where(F.col("length") <= 8 * length).orderBy(F.xxhash64("key"), "key").limit(limit).select("length", "parts").toArrow().combine_chunks()
    lengths = rows["length"].to_numpy()
    target = leaf_rows * len(rows) // n
    return {int(k): Forest(_vectors(rows["parts"], int(k), np.flatnonzero(lengths == k)), Geometry(int(k), cosine), target, trees) for k in np.unique(lengths)}


def _blocks(routed: DataFrame, nodes: DataFrame, leaf_rows: int) -> DataFrame:
    """Rows of each block of a leaf, or of a cell and its fringe: (place, cell, i, j) names it, side tells what meets what."""
    vector = nodes.select("node", "w", "length", "parts")
    piece = lambda n: F.ceil(F.col(n) / leaf_rows)
    chunk = lambda n: F.pmod(F.xxhash64("node"), piece(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), piece(n) - 1))
    sizes = routed.select(F.explode("leaves").alias("place")).groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    split = routed.select("node", F.sort_array("leaves").alias("leaves")).join(vector, "node").select("*", F.posexplode("leaves").alias("k", "place"))
    split = split.join(sizes, "place").select("*", chunk("n").alias("own"), each("n").alias("other"), F.slice("leaves", F.lit(1), F.col("k")).alias("earlier"))
    leaves = split.select("place", F.lit(False).alias("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("within"), "node", "w", "length", "parts", "earlier")
    inner = routed.where("cell IS NOT NULL").select("node", F.col("cell").alias("place"))
    outer = routed.select("node", F.explode("fringe").alias("place"))
    counts = inner.groupBy("place").agg(F.count("*").alias("n")).join(outer.groupBy("place").agg(F.count("*").alias("m")), "place")
    counts = F.broadcast(counts)  # CENTRES rows at most for a length in the sample

    def part(df: DataFrame, i: Column, j: Column, side: int) -> DataFrame:
        return df.join(counts, "place").join(vector, "node").select("place", F.lit(True).alias("cell"), i.alias("i"), "*").select("place", "cell", "i", j.alias("j"), F.lit(side).alias("side"), F.lit(False).alias("within"), "node", "w", "length", "parts", F.array().cast("array<long>").alias("earlier"))

    return leaves.union(part(inner, chunk("n"), each("m"), 0)).union(part(outer, each("n"), chunk("m"), 1))


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF) -> DataFrame:
    """embeddings -> vec_id, n_links, component_id, kept: one row for each input row.

    Two vectors of one length are linked where their cosine, in double precision, is at least cosine. n_links counts the other rows
    linked directly, rows with equal vectors among them; component_id is the smallest vec_id that links reach; kept marks that row.
    Vectors that are null, empty, zero or hold null or non-finite entries have no links. Vectors of different lengths are never linked.
    Rows with a null vec_id join a component and never name one: with none but such rows, component_id is null and kept is true.
    Different vectors with one vec_id are linked by what they hold. Other columns are not read. An empty table gives no rows.

    Links inside cells and between a cell and its fringe are all found; elsewhere a pair just at the threshold is lost in one of a tree's
    splits once in about 50, and then has to be lost in every tree.
    """
    spark = embeddings.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "vectors")
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    source = embeddings.select("vec_id", "embedding")
    made = source.mapInArrow(_classes, f"vec_id {kind}, embedding {source.schema['embedding'].dataType.simpleString()}, key binary, parts binary")
    rows = scratch.table(made.select("vec_id", "key"), "rows")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("rep"), "parts", "embedding")).alias("f")
    classes = made.where("key IS NOT NULL").groupBy("key").agg(first, F.count("*").alias("w")).select("key", "w", "f.rep", "f.parts", "f.embedding", F.size("f.embedding").alias("length"))
    order = [F.asc_nulls_last("rep"), F.asc("key")]
    nodes = scratch.table(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")

    model = spark.sparkContext.broadcast(_fitted(nodes, cosine, trees, leaf_rows))
    routed = nodes.select("node", "length", "parts").mapInArrow(_routed(model, cosine, trees), "node long, cell long, fringe array<long>, leaves array<long>")
    routed = _split_further(scratch.table(routed, "routed"), nodes, leaf_rows, cosine, scratch)
    blocks = _blocks(routed, nodes, leaf_rows).groupBy("place", "cell", "i", "j").applyInArrow(_compared(cosine), "kind int, x long, y long")
    found = scratch.table(blocks, "found")

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("w").alias(f"w{k}"), F.col("embedding").alias(f"e{k}"))
    open_ = found.where("kind = 2").select(F.col("x").alias("a"), F.col("y").alias("b")).join(side("a"), "a").join(side("b"), "b")
    exact = scratch.table(open_.select("a", "b", "wa", "wb", "ea", "eb").mapInArrow(_exact(cosine), "a long, b long, wa long, wb long"), "exact")
    members = routed.where("cell IS NOT NULL").select("node", "cell").join(nodes.select("node", "w"), "node")
    cells = members.groupBy("cell").agg(F.min("node").alias("lead"), F.sum("w").alias("all"))
    members = members.join(F.broadcast(cells), "cell")  # CENTRES rows at most for a length in the sample
    links = found.where("kind = 1").select("x", "y").union(exact.select("a", "b")).union(members.where("node <> lead").select("node", "lead"))
    parts = connected_components(links, scratch, "x", "y")
    counts = found.where("kind = 0").select(F.col("x").alias("node"), F.col("y").alias("n"))
    counts = counts.union(exact.select("a", "wb")).union(exact.select("b", "wa")).union(members.select("node", F.col("all") - F.col("w"))).groupBy("node").agg(F.sum("n").alias("n"))
    named = parts.join(nodes.select(F.col("node").alias("component"), F.col("rep").alias("name")), "component").select("node", "name", F.lit(True).alias("linked"))
    answers = nodes.select("node", "key", "rep", "w").join(counts, "node", "left").join(named, "node", "left")
    answers = answers.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.when(F.col("linked"), F.col("name")).otherwise(F.col("rep")).alias("component_id"))
    answers = scratch.table(answers, "answers")
    joined = rows.where("key IS NOT NULL").join(answers, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id")
    result = scratch.table(joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result")
    scratch.drop_all(but=result)
    return result
