"""Clusters of near fingerprints by spanning links, against all pairs."""

import random
from math import comb

import numpy as np
import pytest

from quillspark.operators import buckets, groups
from quillspark.operators.groups import cluster_links, clusters, near_pairs
from quillspark.scratch import Scratch


def components(n, pairs):
    low = {i: i for i in n}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def fingerprints(seed, n=400):
    """Lone ones, chains, tight groups and copies."""
    rng = random.Random(seed)
    out = [rng.getrandbits(60) for _ in range(n)]
    for _ in range(6):
        x = rng.getrandbits(60)
        for _ in range(25):
            out.append(x)
            x ^= (1 << rng.randrange(60)) | (1 << rng.randrange(60))
    return [*out, *out[:20], None, None]


@pytest.mark.parametrize("threshold, seed", [(2, 1), (4, 2), (0, 3)])
def test_same_clusters_as_all_pairs(spark, threshold, seed):
    bits = fingerprints(seed)
    df = spark.createDataFrame(list(enumerate(bits)), "id long, bits long").repartition(3)
    pairs = [(i, j) for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) if a is not None and b is not None and bin(a ^ b).count("1") <= threshold]
    want = components(range(len(bits)), pairs)
    scratch = Scratch(spark, "test")
    assert {r["id"]: r["cluster"] for r in clusters(df, "id", "bits", threshold, scratch, 60).collect()} == want


def test_a_large_cluster_has_few_links(spark):
    rng = random.Random(5)
    middle = rng.getrandbits(60)
    near = {middle}
    while len(near) < 5000:
        near.add(middle ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)))
    df = spark.createDataFrame(list(enumerate(sorted(near))), "id long, bits long")
    links = cluster_links(df, "id", "bits", 6, Scratch(spark, "test"), 60)
    assert links.count() < 60_000  # of 12 million pairs
    found = clusters(df, "id", "bits", 6, Scratch(spark, "test"), 60)
    assert found.where("cluster = 0").count() == len(near)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id long, bits long")
    assert {(r["id"], r["cluster"]) for r in clusters(df, "id", "bits", 2, Scratch(spark, "test"), 60).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert clusters(df.limit(0), "id", "bits", 2, Scratch(spark, "test"), 60).count() == 0
    assert near_pairs(df, "id", "bits", 2, 60).count() == 1


@pytest.mark.parametrize("comparison", [0.001, 0.05, 5.0])
def test_crowded_buckets_lose_no_pair(spark, monkeypatch, comparison):
    """A third of the fingerprints agree in their low half, others are near copies; each pair is listed once, however many keys it shares."""
    monkeypatch.setattr(groups, "COMPARISON", comparison)
    rng = random.Random(7)
    low = rng.getrandbits(30)
    crowd = [low | rng.getrandbits(30) << 30 for _ in range(400)]
    bits = [*crowd, *(x ^ sum(1 << k for k in rng.sample(range(60), rng.randint(0, 7))) for x in crowd[:150]), *(rng.getrandbits(60) for _ in range(400)), None]
    first = {}
    for i, x in enumerate(bits):
        first.setdefault(x, i)
    first.pop(None)
    want = {(first[x], i) for i, x in enumerate(bits) if x is not None and first[x] != i}
    want |= {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= 6}
    df = spark.createDataFrame(list(enumerate(bits)), "id long, bits long").repartition(3)
    got = [tuple(r) for r in near_pairs(df, "id", "bits", 6, 60, Scratch(spark, "test")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_grow_slowly():
    """Of 60 bits with 6 apart, in keys a row: not every bucket need be a row's own. Bits that tell less make more keys."""
    keys = lambda n, information=1.0: comb(groups.cheapest_parts(n, 6, 60, information), 6)
    assert [keys(n) for n in (10**3, 10**4, 10**6, 10**8, 10**9)] == [7, 7, 28, 210, 462]
    assert keys(10**6, 0.7) > keys(10**6)


@pytest.fixture
def no_broadcast(spark):
    """Whatever Spark would broadcast fails, however small."""
    key = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(key, "1b")
    yield
    spark.conf.unset(key)


def test_pairs_are_not_joined_in_the_driver(spark, no_broadcast):
    df = spark.createDataFrame(list(enumerate(fingerprints(5))), "id long, bits long")
    assert near_pairs(df, "id", "bits", 6, 60, Scratch(spark, "test")).count() > 0


def test_clusters_are_not_joined_in_the_driver(spark, no_broadcast):
    df = spark.createDataFrame(list(enumerate(fingerprints(5))), "id long, bits long")
    assert clusters(df, "id", "bits", 6, Scratch(spark, "test"), 60).groupBy("cluster").count().count() < df.count()


def test_dual_clusters_and_merged_groups_are_not_joined_in_the_driver(spark, no_broadcast):
    bits = fingerprints(5)
    df = spark.createDataFrame([(i, x, None if x is None else x ^ 1, str(x)) for i, x in enumerate(bits)], "id long, one long, two long, text string")
    assert groups.dual_clusters(df, "id", "one", "two", 6, Scratch(spark, "test"), 60).count() == len(bits)
    assert groups.merged_groups(df, "id", ["text"], Scratch(spark, "test")).count() == len(bits)


@pytest.mark.parametrize("group_rows", [1, 60, 1 << 18])
def test_large_groups_are_dealt_further(spark, monkeypatch, group_rows):
    """Fingerprints of all 64 bits under text ids; groups above the limit are dealt by more parts, down to single buckets, and lose no link."""
    monkeypatch.setattr(groups, "GROUP_ROWS", group_rows)
    rng = random.Random(8)
    low = rng.getrandbits(32)
    base = [low | rng.getrandbits(32) << 32 for _ in range(150)]
    bits = [*base, *(x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 8))) for x in base * 2), *(rng.getrandbits(64) for _ in range(150))]
    want = components(range(len(bits)), [(i, j) for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) if (a ^ b).bit_count() <= 6])
    df = spark.createDataFrame([(f"{i:04}", x - (1 << 64) if x >> 63 else x) for i, x in enumerate(bits)], "id string, bits long").repartition(3)
    found = clusters(df, "id", "bits", 6, Scratch(spark, "test")).collect()
    assert {int(r["id"]): int(r["cluster"]) for r in found} == want and len(set(want.values())) > 150


def test_keys_are_not_shuffled(spark):
    """Of 84 keys a row, the 7 groups that hold their buckets are dealt out."""
    classes = spark.createDataFrame([(i, x) for i, x in enumerate(fingerprints(6)) if x is not None], "first long, bits long")
    dealt, masks = groups._dealt(classes, 6, [(i * 60 // 9, (i + 1) * 60 // 9) for i in range(9)])
    assert dealt.count() == 7 * classes.count() and sum(map(len, masks.values())) == comb(9, 6)


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_a_crowded_bucket_is_not_compared_all_with_all(monkeypatch, at_once):
    """20,000 near variants and lone ones in shared buckets: parts as brute force has them on a share, and few comparisons."""
    monkeypatch.setattr(buckets, "PAIRS", at_once)
    rng = random.Random(9)
    middle = rng.getrandbits(60)
    size = 300 if at_once < 100 else 20_000
    bits = list({middle ^ sum(1 << k for k in rng.sample(range(60), 3)) for _ in range(size)} | {middle ^ rng.getrandbits(30) << 30 for _ in range(100)})
    rng.shuffle(bits)
    masks = [(1 << 30) - 1, ((1 << 30) - 1) << 30]
    made = []
    spanning = buckets._spanning
    monkeypatch.setattr(buckets, "_spanning", lambda *a: made.append(spanning(*a)) or made[-1])
    low = buckets.parts(np.array(bits, np.uint64), masks, 6)
    assert sum(int(behind.sum()) for _, behind in made) < 300 * len(bits)
    some = rng.sample(range(len(bits)), 250)
    for i in some:
        for j in some:
            if (bits[i] ^ bits[j]).bit_count() <= 6 and any(bits[i] & m == bits[j] & m for m in masks):
                assert low[i] == low[j]


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_every_near_pair_is_listed(spark, no_broadcast, monkeypatch, block_rows):
    """Rows of equal fingerprints are paired with each other and with all that is near, each pair once; large classes block by block."""
    monkeypatch.setattr(groups, "BLOCK_ROWS", block_rows)
    bits = [*fingerprints(11, 150), *(fingerprints(11, 150)[150:170] * 4)]
    want = {(i, j) for j, b in enumerate(bits) for i, a in enumerate(bits[:j]) if a is not None and b is not None and (a ^ b).bit_count() <= 6}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bits)] + [(None, bits[0])], "id long, bits long").repartition(3)
    got = [tuple(r) for r in groups.all_near_pairs(df, "id", "bits", 6, 60, Scratch(spark, "test")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_query_lists_pairs_of_copies_and_what_is_near_them(spark, tmp_path):
    """Three texts of the same words in other orders: every pair of them, and of their copies, is one of J4's."""
    from quillspark.plans.queries import QUERIES

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[::-1]), " ".join(words), "another text altogether", " ".join(words[5:] + words[:5])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["J4"](spark, str(tmp_path)).select("a", "b").collect()}
    assert got == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}
