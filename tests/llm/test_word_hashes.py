import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quillspark.llm.near_dedup import near_duplicates
from quillspark.llm.text import EXACT, EXACT_2, Texts, distinct, hashes, second_hashes, shape_hashes, span_hashes


def thue_morse(n, a="a", b="b"):
    """A word of n letters and its complement, on which sums along powers of any odd base agree modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_structured_words_have_different_hashes():
    for n in (64, 1024, 4096):
        for one, two in (thue_morse(n), thue_morse(n, "0", "1")):
            raw = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
            starts = np.array([0, n + 1, 2 * n + 2])
            for view in (span_hashes, second_hashes, lambda *x: hashes(*x, EXACT)[0], lambda *x: hashes(*x, EXACT_2)[0]):
                h = view(raw, starts, starts + n)
                assert h[0] == h[2] != h[1]
    one, two = thue_morse(1024, "aA", "a0")
    raw = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    ends = np.array([len(one), len(raw)])
    h = shape_hashes(raw, np.array([0, len(one) + 1]), ends)
    assert h[0] != h[1]


def test_hashes_of_a_sum_are_independent():
    words = [f"w{i}x{i * i % 97}" for i in range(20_000)]
    (_, _, (one, two), _), = Texts(pa.array([" ".join(words)])).views(span_hashes, second_hashes)
    assert len(distinct(one)) == len(distinct(two)) == len(set(words)) and not set(one.tolist()) & set(two.tolist())
    assert abs(np.corrcoef(one.astype(float), two.astype(float))[0, 1]) < 0.03


def test_structured_texts_are_not_linked(spark):
    rows = [(i, w) for i, w in enumerate([*thue_morse(1024), *thue_morse(4096), thue_morse(1024)[0]])]
    rows += [(10 + i, " ".join(w)) for i, w in enumerate(thue_morse(1024))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute.near_components(rows, 4)
    assert [got[i][1] for i in range(5)] == [0, 1, 2, 3, 0]


def test_rows_that_share_an_id(spark):
    """Rows are named by id and text: each is linked by its own text, and one row of a group is chosen."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(50)}" for _ in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (None, b + " too"), (None, c), (None, c + " more"), (4, ""), (4, ""), (None, None), (3, b)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    seen = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["chosen"]) for r in out)
    assert len(out) == len(rows)
    group = [r for r in seen if r[0] == "1"]
    assert [r[2:] for r in group] == [("1", True), ("1", True)]
    assert [r[2:] for r in seen if r[0] in ("2", "3")] == [("1", False)] * 3
    loose = [r for r in seen if r[0] == "None" and r[1] > 0]
    assert sorted(r[2:] for r in loose) == [("1", False), ("None", False), ("None", True)]
    assert all(r[3] for r in seen if r[1] == 0)


def test_templates_with_own_words(spark):
    """Thousands of texts share all but two words: one token for all, no link between most."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(13)]
    rows = [(i, " ".join([*common, f"own{rng.randrange(4000)}", f"more{i % 2500}"])) for i in range(5000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute.near_components(rows, 4)
