import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quillspark.llm.near_dedup import _TRIES, BUCKETS, estimate, near_duplicates, registers
from quillspark.llm.text import Texts, shingle_sets


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_matches_brute_force_on_edited_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 25, 120]))] for _ in range(25)]
    rows = []
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 15))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4, 5):
        assert found(near_duplicates(df, size)) == brute.near_components(rows, size)


def test_scattered_copies_of_one_original_are_one_component(spark):
    """Copies that are too far from each other but near the original, and a passage that many share."""
    rng = random.Random(8)
    original = [f"o{i}" for i in range(150)]
    rows = [(500, " ".join(original))]
    for i in range(120):
        words = list(original)
        for k in rng.sample(range(150), 4):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(600 + i, passage + " " + " ".join(f"u{i}v{k}" for k in range(60))) for i in range(80)]
    got = found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    assert got == brute.near_components(rows, 4)
    assert {c for i, (_, c) in got.items() if i <= 500} == {0}


def test_supplied_table(spark, data):
    docs = spark.read.parquet(f"{data()}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for size in (4, 5):
        assert found(near_duplicates(docs, size)) == brute.near_components(rows, size)


def test_edges(edge):
    rows = near_duplicates(edge, 4).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in (1, 2, 3):
        assert (by[i]["n_shingles"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == 1 and by[4]["kept"] and by[5]["kept"]
    assert by[7]["component_id"] == 6 and not by[7]["kept"]
    assert by[9]["component_id"] == 8
    assert all(r["kept"] for r in rows if r["doc_id"] is None)


def test_empty(nothing):
    assert near_duplicates(nothing, 5).collect() == []


def test_estimates_follow_similarity():
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (30, 400, 5000):
        for share in (0.3, 0.8, 1.0):
            both = rng.integers(0, 2**63, n * 2).astype(np.uint64)
            common = int(round(2 * n * share / (1 + share)))  # of n each
            a, b = np.unique(both[:n]), np.unique(both[n - common : 2 * n - common])
            got = estimate(registers(a, np.array([len(a)])), registers(b, np.array([len(b)])), np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(got - share) < 6 * (0.25 / min(n, BUCKETS)) ** 0.5


def test_sets_are_those_of_the_whole_text():
    texts = ["a b c d e", "A B\tC  d E", "a b", None, ""]
    sets = [s for _, _, h, b in Texts(pa.array(texts, pa.string())).words() for s in shingle_sets(h, b, 4)]
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0]
    assert (sets[0] == sets[1]).all()


def test_registers_of_many_sets_are_those_of_each():
    rng = np.random.Generator(np.random.PCG64(9))
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (0, 1, 2, 30, 0, 500, 5000, 0)]
    sizes = np.array([len(s) for s in sets])
    together = registers(np.concatenate(sets), sizes)
    for row, s in zip(together, sets):
        assert (row == registers(s, np.array([len(s)]))[0]).all()
        # By its definition: the bucket's smallest hash, or what the first filled bucket of its own order has.
        bucket = [int(x) >> 32 for x in (s >> np.uint64(32)) * np.uint64(BUCKETS)]
        assert len(s) == 0 or all(row[b] == row[_TRIES[b][[t in set(bucket) for t in _TRIES[b]].index(True)]] for b in range(BUCKETS) if b not in set(bucket))
