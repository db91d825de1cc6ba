"""Operator 11 against brute force, and its SQL."""

import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import divergence
from quillspark.llm.divergence import ORACLE, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top=50):
    """docs: (lang, source, text)."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in held.items()}
    price = lambda c, n, v: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
    p, q = {}, {}
    for (lang, source), c in counts.items():
        n = sum(c[t] for t in kept[lang])
        p[lang, source] = {t: price(c[t], n, len(kept[lang])) for t in kept[lang]}
    for lang, terms in kept.items():
        total = {t: sum(c[t] for (other, _), c in counts.items() if other == lang) for t in terms}
        q[lang] = {t: price(total[t], sum(total.values()), len(terms)) for t in terms}
    rows = set()
    for lang, source in p:
        mine = p[lang, source]
        pairs = [(sum(abs(mine[t] - p[lang, o][t]) for t in mine), o) for other, o in p if other == lang and o != source]
        terms = [(mine[t] - q[lang][t], t) for t in mine if counts[lang, source][t] > 0 and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                rows.add((lang, source, part, item, value, rank))
    return rows


def rows(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()}


DOCS = [
    (None, None, "Alpha beta, beta; gamma"), ("", "a", "alpha beta"), ("en", "a", None), ("en", "b", ""), ("en", "b", "Émigré émigré ÉMIGRÉ x2y"), ("en", "c", "x1y émigré e\x7fmigré"),
    ("en", "a", "one two TWO three"), ("en", "a", "one two TWO three"), ("de", "a", "nur hier"), ("en", "c", "one " * 50 + "three"), ("en", None, "!!! 123 _^"), ("fr", "z", "1 2 3"),
]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_against_brute_force(spark, least):
    """Null and empty cells, ties, repeated rows, sources without terms, a language without kept terms, characters beyond ASCII."""
    df = spark.createDataFrame(DOCS * 2, "lang string, source string, text string")
    assert rows(source_divergence(df, least)) == brute(DOCS * 2, least)


def test_blocks_and_levels(spark, monkeypatch):
    """More sources than a block holds, and several blocks of terms."""
    for name, value in (("SOURCES", 3), ("TERMS", 4), ("PIECE", 16), ("MOST_COUNTERS", 5)):
        monkeypatch.setattr(divergence, name, value)
    docs = [("en", f"s{k % 11}", " ".join("w" + chr(97 + (k * i + i * i) % 26) for i in range(k % 40))) for k in range(200)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    assert rows(source_divergence(df, 30, 5)) == brute(docs, 30, 5)


def test_pieces_cut_no_term():
    for raw in (b"", b" ", b"abc", b"ab cd " * 9, b"x" * 40 + b" y", b" " * 50):
        parts = list(divergence._pieces(raw))
        assert [t for p in parts for t in p.split()] == raw.split()


def test_edge_tables(spark, edge, nothing):
    assert source_divergence(nothing).count() == 0
    docs = [(r.lang, r.source, r.text) for r in edge.collect()]
    assert rows(source_divergence(edge, 2)) == brute(docs, 2)


def test_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data()}/documents.parquet'")
    want = set(c.sql(ORACLE).fetchall())
    assert rows(source_divergence(spark.read.parquet(f"{data()}/documents.parquet"))) == want and want
