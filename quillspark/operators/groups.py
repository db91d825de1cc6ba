"""Near-duplicate pairs of 64-bit fingerprints and row groups.

Joins are merged, never broadcast: both sides grow with the rows, and Spark's estimate of a side, the size of its files, doesn't count
what explode makes of a row or how well sorted ids pack. A side taken for small by it goes through the driver whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillspark.operators import buckets
from quillspark.operators.components import connected_components
from quillspark.scratch import Scratch


def band_parts(rows: int, threshold: int, width: int) -> int:
    """The fewest parts whose keys tell so many rows apart: with n rows, a key of log2(n) bits meets few others by chance."""
    wanted = min(max(8, rows.bit_length()), width // 2)
    return next(k for k in range(threshold + 2, width + 1) if (k - threshold) * width // k >= wanted)


#: A comparison of two rows of a bucket, as a part of what a key costs a row. Only how the work is spread hangs on it, never a result.
COMPARISON = 0.05


def cheapest_parts(rows: int, threshold: int, width: int, information: float = 1.0) -> int:
    """The number of parts whose keys are cheapest: more parts make more keys to sort, but longer ones, that fewer rows share.
    information is how much of a bit a bit tells: 1 where half of the rows have it, less where most or few do."""
    choices = range(max(2, threshold + 1), max(2, threshold + 1, min(width, threshold + 7)) + 1)
    return min(choices, key=lambda k: comb(k, threshold) * (1 + COMPARISON * rows / 2 ** ((k - threshold) * width // k * information)))


def _rows_and_information(classes: DataFrame, width: int) -> tuple[int, float]:
    """How many rows there are, and the mean over the bits of -log2(chance that two rows agree in it)."""
    shares = (F.avg(F.shiftrightunsigned("bits", b).bitwiseAND(F.lit(1))) for b in range(width))
    n, *p = classes.agg(F.count("*"), *shares).first()
    return n, sum(-log2(x * x + (1 - x) * (1 - x)) for x in p) / width if n else 1.0


def _edges(parts: int, width: int) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


#: Rows of a group of fingerprints above which it is dealt into smaller ones, by one part more.
GROUP_ROWS = 1 << 18


def _dealt(classes: DataFrame, threshold: int, edges: Sequence[tuple[int, int]]) -> tuple[DataFrame, dict[int, list[int]]]:
    """Each row of classes in groups (prefix, value) that hold the buckets of its keys, and the masks of each prefix's buckets.

    Keys that begin with the same part are one group: so a row is shuffled threshold + 1 times, not once a key. Groups above GROUP_ROWS
    rows are dealt by the first two parts, and so on; one by all parts of a key is a bucket. Which groups are large, fewer than the
    rows' copies by GROUP_ROWS, is all that comes to the driver.
    """
    count, size = len(edges), len(edges) - threshold
    bits_of = lambda chosen: sum(1 << b for i in chosen for b in range(*edges[i]))
    signed = lambda mask: F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
    dealt, masks, large = [], {}, []
    for depth in range(1, size + 1):
        begun = [c for c in combinations(range(count), depth) if c[-1] < threshold + depth]
        masks |= {bits_of(c): [bits_of(c + rest) for rest in combinations(range(c[-1] + 1, count), size - depth)] for c in begun}
        group = lambda c: F.struct(signed(bits_of(c)).alias("prefix"), F.col("bits").bitwiseAND(signed(bits_of(c))).alias("value"))
        keys = F.explode(F.array(*(F.struct(group(c).alias("own"), group(c[:-1]).alias("above")) for c in begun))).alias("key")
        rows = classes.select("first", "bits", keys).where(F.xxhash64("key.above.prefix", "key.above.value").isin(large) if depth > 1 else F.lit(True)).select("key.own.*", "first", "bits")
        hashed = F.xxhash64("prefix", "value")
        large = [] if depth == size else [r["h"] for r in rows.groupBy(hashed.alias("h")).count().where(F.col("count") > GROUP_ROWS).select("h").toLocalIterator()]
        dealt.append(rows.where(~hashed.isin(large)) if large else rows)
        if not large:
            break
    return reduce(DataFrame.union, dealt), {k - (1 << 64) if k >> 63 else k: m for k, m in masks.items()}


def _in_groups(dealt: DataFrame, found: Callable[..., Iterator]) -> DataFrame:
    """(a, b): what found makes of each group, in tasks that hold whole groups."""
    kind = dealt.schema["first"].dataType
    return dealt.repartition("prefix", "value").sortWithinPartitions("prefix", "value").mapInArrow(found, StructType([StructField("a", kind), StructField("b", kind)]))


def _near_classes(classes: DataFrame, threshold: int, width: int) -> DataFrame:
    """(a, b), a < b: every pair of classes (first, bits) at most threshold bits apart, once. A pair that shares several buckets is listed
    in the first alone, which is the one whose key is their first parts that agree: so no shuffle is needed to make pairs distinct."""
    n, information = _rows_and_information(classes, width)
    edges = _edges(cheapest_parts(n, threshold, width, information), width)
    dealt, masks = _dealt(classes, threshold, edges)
    bands = [sum(1 << b for b in range(*e)) for e in edges]
    return _in_groups(dealt, partial(buckets.pairs, masks=masks, threshold=threshold, bands=bands)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_pairs(df: DataFrame, node: str, bits: str, threshold: int, width: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b: the short form of all_near_pairs, for callers that unfold copies themselves. Equal fingerprints are one class: pairs
    of classes, named by their first rows, and each further row of a class with its first."""
    scratch = scratch or Scratch(df.sparkSession, "near_pairs")
    rows = df.select(F.col(node).alias("node"), F.col(bits).alias("bits")).where("node IS NOT NULL AND bits IS NOT NULL")
    classes = scratch.table(rows.groupBy("bits").agg(F.min("node").alias("first")), "classes")
    within = rows.join(classes.hint("merge"), "bits").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return _near_classes(classes, threshold, width).union(within)


#: Rows of a class that are paired at once.
BLOCK_ROWS = 1024


def all_near_pairs(df: DataFrame, node: str, bits: str, threshold: int, width: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b: every pair of rows whose fingerprints, of width bits, differ in at most threshold bits (J4). node names a row.

    Fingerprints are compared once, however many rows have them; then each pair of classes, and each class with itself, is unfolded to
    the pairs of their rows. Large classes are unfolded block by block, so that no task has to pair a class whole.
    """
    scratch = scratch or Scratch(df.sparkSession, "near_pairs")
    rows = df.select(F.col(node).alias("node"), F.col(bits).alias("bits")).where("node IS NOT NULL AND bits IS NOT NULL")
    blocks = F.ceil(F.count("*") / BLOCK_ROWS).cast("int")
    classes = scratch.table(rows.groupBy("bits").agg(F.struct(F.min("node").alias("name"), blocks.alias("blocks")).alias("first"), F.count("*").alias("n")), "classes")
    block = F.pmod(F.xxhash64("node"), F.col("first.blocks")).cast("int")
    members = scratch.table(rows.join(classes.hint("merge"), "bits").select(F.col("first.name").alias("name"), block.alias("block"), "node"), "members")
    met = _near_classes(classes, threshold, width).union(classes.where("n > 1").select(F.col("first").alias("a"), F.col("first").alias("b")))
    some = met.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.explode(F.expr("sequence(0, a.blocks - 1)")).alias("i"), F.col("b.blocks").alias("blocks"))
    units = scratch.table(some.select("a", "b", "i", F.explode(F.expr("sequence(if(a = b, i, 0), blocks - 1)")).alias("j")), "units")
    x, y = (members.select(F.col("name").alias(c), F.col("block").alias(k), F.col("node").alias(v)) for c, k, v in (("a", "i", "x"), ("b", "j", "y")))
    found = units.join(x.hint("merge"), ["a", "i"]).join(y.hint("merge"), ["b", "j"]).where("a <> b OR i <> j OR x < y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cluster_links(df: DataFrame, node: str, bits: str, threshold: int, scratch: Scratch, width: int = 64) -> DataFrame:
    """(a, b): links that join what near_pairs joins, but about as many as there are fingerprints, not all pairs.

    In each bucket of a key the members are compared with the bucket's first only; what these links join is one part. Then, in buckets
    that span several parts, members of different ones are compared with each other, but the largest one's never among themselves: a
    group of n near variants costs about n comparisons a key, and no link between parts is lost. Both are done in tasks that hold the
    buckets of many keys (buckets.links), so that keys themselves are never shuffled, nor what is found in their buckets.
    """
    rows = df.select(F.col(node).alias("node"), F.col(bits).alias("bits")).where("node IS NOT NULL AND bits IS NOT NULL")
    classes = scratch.table(rows.groupBy("bits").agg(F.min("node").alias("first")), "classes")
    within = rows.join(classes.hint("merge"), "bits").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    n, information = _rows_and_information(classes, width)
    dealt, masks = _dealt(classes, threshold, _edges(cheapest_parts(n, threshold, width, information), width))
    found = _in_groups(dealt, partial(buckets.links, masks=masks, threshold=threshold))
    return within.union(scratch.table(found.distinct(), "links"))


def _with_component(df: DataFrame, node: str, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """df with the smallest node that links reach from a row; a row without links is alone."""
    found = connected_components(links, scratch, "a", "b").withColumnRenamed("node", "_node")
    return df.join(found.hint("merge"), df[node] == found["_node"], "left").select(*df.columns, F.coalesce("component", F.col(node)).alias(name))


def clusters(df: DataFrame, node: str, bits: str, threshold: int, scratch: Scratch, width: int = 64) -> DataFrame:
    """df with cluster: the smallest node that links reach; a row without a fingerprint is alone."""
    return _with_component(df, node, cluster_links(df, node, bits, threshold, scratch, width), scratch, "cluster")


def partition_intersection(df: DataFrame, labels: Sequence[str], node: str, name: str = "cluster") -> DataFrame:
    """The common refinement of partitions: rows that agree in all labels; named by the smallest node."""
    low = df.groupBy(*(F.col(c).alias(f"_l{i}") for i, c in enumerate(labels))).agg(F.min(node).alias("_low"))
    same = F.expr(" AND ".join(f"`{c}` <=> _l{i}" for i, c in enumerate(labels)))
    return df.join(low.hint("merge"), same).select(*df.columns, F.col("_low").alias(name))


def dual_clusters(df: DataFrame, node: str, one: str, two: str, threshold: int, scratch: Scratch, width: int = 64) -> DataFrame:
    """The intersection of both fingerprints' transitive closures, not the closure of their agreement."""
    links = [cluster_links(df, node, c, threshold, scratch, width) for c in (one, two)]
    both = _with_component(_with_component(df, node, links[0], scratch, "_one"), node, links[1], scratch, "_two")
    return partition_intersection(both, ["_one", "_two"], node).drop("_one", "_two")


def merged_groups(df: DataFrame, node: str, keys: Sequence[str], scratch: Scratch, name: str = "group") -> DataFrame:
    """Groups of rows that share a value in any key column, transitively; '' and null share nothing.

    The first row of each value links to the others: as many links as rows, however many share a value.
    """
    links = []
    for k in keys:
        rows = df.select(F.col(node).alias("node"), F.col(k).cast("string").alias("value")).where("value <> ''")
        first = rows.groupBy("value").agg(F.min("node").alias("first"))
        links.append(rows.join(first.hint("merge"), "value").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    return _with_component(df, node, reduce(DataFrame.union, links), scratch, name)


def group_key(df: DataFrame, node: str, policy: str, scratch: Scratch) -> DataFrame:
    """df with group by policy none, md5 or content_cluster (md5 and cluster merged)."""
    keys = {"none": [], "md5": ["md5"], "content_cluster": ["md5", "content_cluster"]}
    if policy not in keys:
        raise ValueError(f"unknown group policy {policy}")
    return merged_groups(df, node, keys[policy], scratch) if keys[policy] else df.withColumn("group", F.col(node))


def cluster_summary(df: DataFrame, cluster: str) -> DataFrame:
    """size, splits and cross-split mark of each cluster (A22), from pre-aggregated counts."""
    per_split = df.groupBy(cluster, "split").count()
    return per_split.groupBy(cluster).agg(F.sum("count").alias("size"), F.count("*").alias("splits")).withColumn("cross_split", F.col("splits") > 1)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")
