"""Source divergence audit (operator 11): one-hot level products.

For each language and term that enough of its documents hold, each source has a count; equal counts of a source are a level.
A matrix of indicator columns, one for each (source, level), times its transpose holds the joint table of every two sources:
how many terms stand at level a in the one and at level b in the other. A joint table priced with |p(a) - p(b)| is the
divergence of the two sources.

The product is blocked both ways: TERMS terms by SOURCES sources are a row, rows of one block of terms meet by a join, and
since prices are sums over terms, each partial joint table is priced where it is made. All of it is whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.scratch import Scratch, ship_code

TERMS, SOURCES = 512, 16
LEAST_DOCUMENTS, TOP, SMOOTH = 30, 50, 5
SCALE = 1_000_000_000

#: Bytes that separate terms become spaces; only A-Z are lowered. All bytes of other characters are 0x80 or more.
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE, MOST_COUNTERS = 1 << 20, 200_000


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, none of which cuts a term."""
    low = 0
    while low < len(raw):
        high = len(raw) if len(raw) - low <= PIECE else raw.rfind(b" ", low, low + PIECE)
        if high <= low:
            high = raw.find(b" ", low + PIECE)
        high = len(raw) if high < 0 else high
        yield raw[low:high]
        low = high + (high == low)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, held) in groups.items():
            n = len(count) + 1  # the row without a term names the group
            columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([None, *count], pa.binary()).cast(pa.string()), pa.array([0, *count.values()], pa.int64()), pa.array([0, *(held[t] for t in count)], pa.int64())]
            yield pa.record_batch(columns, ["lang", "source", "term", "count", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
            count, held = groups.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in _pieces(text.as_py().translate(_PLAIN)):
                terms = piece.split()
                count.update(terms)
                fresh = set(terms) - seen
                held.update(fresh)
                seen |= fresh
        if sum(len(count) for count, _ in groups.values()) > MOST_COUNTERS:
            yield from flushed()
    yield from flushed()


def _level_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two blocks of sources: the priced joint tables of their sources over this block of terms."""
    for batch in batches:
        col = {k: batch.column(k) for k in batch.schema.names}
        out: dict[str, list] = {"lang": [], "a": [], "b": [], "value": []}
        for i in range(len(batch)):
            lang, terms, same = col["lang"][i].as_py(), col["terms"][i].as_py(), col["ga"][i].as_py() == col["gb"][i].as_py()
            left, right = (_block(col[f"sources_{k}"][i].as_py(), np.asarray(col[f"zero_{k}"][i].values), col[f"cells_{k}"][i].values, terms) for k in "ab")
            levels, starts, hot = _one_hot(right[1])
            for g, source in enumerate(left[0]):
                own, _, mine = _one_hot(left[1][:, g : g + 1])
                joint = (mine.T @ hot).astype(np.int64)  # counts of at most TERMS: exact in single precision
                priced = (joint * np.abs(own[:, None] - levels)).sum(axis=0)
                value = np.add.reduceat(priced, starts) if terms else np.zeros(len(right[0]), np.int64)
                for h in range(g + 1 if same else 0, len(right[0])):
                    for row in (source, right[0][h]), (right[0][h], source):
                        for k, v in zip(out, (lang, *row, int(value[h]))):
                            out[k].append(v)
        yield pa.record_batch([pa.array(out["lang"], pa.string()), pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string()), pa.array(out["value"], pa.int64())], list(out))


def _block(sources: list[str], zero: np.ndarray, cells: pa.StructArray, terms: int) -> tuple[list[str], np.ndarray]:
    """Prices of terms by sources; a term that a source doesn't hold is at its level of zero."""
    price = np.tile(zero, (terms, 1))
    if cells is not None and len(cells):
        price[np.asarray(cells.field("place")), np.asarray(cells.field("slot"))] = np.asarray(cells.field("p"))
    return sources, price


def _one_hot(price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of all columns one after another, where each column's begin, and the indicator columns."""
    each = [np.unique(price[:, g], return_inverse=True) for g in range(price.shape[1])]
    starts = np.cumsum([0, *(len(levels) for levels, _ in each)])
    hot = np.zeros((len(price), starts[-1]), np.float32)
    for (_, at), start in zip(each, starts):
        hot[np.arange(len(price)), start + at] = 1
    return np.concatenate([levels for levels, _ in each]), starts[:-1], hot


def _smoothed(count: str, total: str) -> str:
    """A smoothed share of a term in whole parts of SCALE, by exact decimal division."""
    return f"1 + (cast({SCALE} AS decimal(10,0)) * cast({count} + {SMOOTH} AS decimal(19,0))) div cast({total} + {SMOOTH} * vocabulary AS decimal(20,0))"


def source_divergence(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """documents -> lang, source, part, item, value, rank.

    Null text, lang and source count as ''. A language keeps the terms that at least least_documents of its documents hold.
    Part `pair`: every other source of the language with its divergence; part `term`: the terms that a source uses more than its
    language does, the first top of them. Ranks go by value, then by item in order of bytes, so ties have a fixed order. Sources
    without terms are at zero everywhere; a language without kept terms has pairs of value 0. Empty texts hold no term; long texts
    are read whole; repeated rows are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "divergence")
    read = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    counts = scratch.table(counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")

    # Kept terms with their place in blocks of about TERMS terms of one language.
    used = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
    used = scratch.table(used.select("lang", "term", "total"), "used")
    # Written, so that its size is known: a join that is a shuffle by language alone would leave one task a language.
    langs = scratch.table(used.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_size")), "langs")
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("vocabulary") / TERMS)).alias("block")
    kept = used.join(langs, "lang").select("*", block)
    places = Window.partitionBy("lang", "block")
    kept = scratch.table(kept.select("*", (F.row_number().over(places.orderBy("term")) - 1).alias("place")), "kept")

    # What each source has: its size over kept terms, its place among the sources of its language.
    cells = scratch.table(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("n"))
    groups = groups.select("*", (F.col("n") % SOURCES).alias("slot"), F.floor(F.col("n") / SOURCES).alias("g"), F.expr(f"CASE WHEN vocabulary > 0 THEN {_smoothed('0', 'size')} ELSE 0 END").alias("zero"))
    groups = scratch.table(groups, "groups")
    priced = cells.join(groups.drop("vocabulary"), ["lang", "source"]).withColumns({"p": F.expr(_smoothed("count", "size")), "q": F.expr(_smoothed("total", "lang_size"))})

    # Blocks of the matrix. A block without terms stands for each language, so that all its pairs are there.
    inside = F.sort_array(F.collect_list(F.struct("slot", "source", "zero")))
    columns = groups.groupBy("lang", "g").agg(inside.alias("i")).select("lang", "g", F.col("i.source").alias("sources"), F.col("i.zero").alias("zero"))
    rows = kept.groupBy("lang", "block").agg(F.count("*").alias("terms")).union(groups.groupBy("lang").agg(F.lit(-1), F.lit(0)))
    filled = priced.groupBy("lang", "block", "g").agg(F.collect_list(F.struct("place", "slot", "p")).alias("cells"))  # TERMS x SOURCES at most, about
    blocks = scratch.table(rows.join(columns, "lang").join(filled, ["lang", "block", "g"], "left"), "blocks")
    named = lambda k: blocks.select("lang", "block", "terms", *(F.col(c).alias(f"{c}_{k}") for c in ("sources", "zero", "cells")), F.col("g").alias(f"g{k}"))
    met = named("a").join(named("b").drop("terms"), ["lang", "block"]).where("ga <= gb")
    pairs = met.mapInArrow(_level_products, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")).alias("rank"))
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    result = scratch.table(pairs.union(over), "result")
    scratch.drop_all(but=result)
    return result


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (SELECT n, lang, source, unnest(terms) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT n) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, coalesce(sum(c), 0) AS size FROM groups LEFT JOIN cells USING (lang, source) GROUP BY lang, source),
prices AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
    (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (s.size + 5 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 5)) // (l.size + 5 * l.v))::BIGINT AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), apart AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM prices x JOIN prices y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), both_parts AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, p - q FROM prices WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
