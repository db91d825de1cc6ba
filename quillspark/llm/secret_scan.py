"""Secret scans (operator 8), in DataFrame functions only.

Base spans come from three patterns. The method adds spans: long tokens of an encoding's alphabet are put to a
battery of randomness tests (chi-squared uniformity over 4, 8 or 16 equal parts of the alphabet, as many as leave five
expected symbols in each, runs about its middle, and lag-one serial correlation), combined by Fisher's method into one statistic, low for random-looking tokens. A token's
p-value comes from a fixed null: statistics of plain tokens (words and structured digits) of the same family and length
class, so that it doesn't depend on what else the table holds. Benjamini-Hochberg over the candidates of a family,
letters-only ones too, then bounds the share of false finds. A find must also pass for random by itself: the battery's
own p is PLAUSIBLE at least. What is collected is a table of (family, class, bin) with a fixed number of rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KEYWORD = "(?i)password|passwd|secret|token|api_?key"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in the order in which they are tried; a token has the first that holds all its characters.
ALPHABETS = (("^[0-9a-f]+$", "0123456789abcdef"), ("^[0-9A-F]+$", "0123456789ABCDEF"), ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
URL_SAFE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
#: Lower ends of the length classes.
CLASSES = (20, 24, 32, 48, 64)
#: Least expected symbols in a part of the alphabet, where there are more than four parts; all alphabets divide by 16.
EXPECTED = 5
#: Bins of the statistic, half a unit wide; the last is open.
BINS = 160
FALSE_SHARE = 0.01
FAMILIES = ("hex", "base32, letters only", "base32", "base64, letters only", "base64 or url-safe")
#: By family and class, the statistics that one in a hundred, one in a thousand and one in 5000 plain tokens are
#: at or under, made by tests/llm/null_tokens.py. Between them log p is a straight line, and goes on as it was last; above the first p is one.
NULL = (
    ((11.8, 7.9, 5.5), (15.6, 10.5, 7.9), (24.2, 16.9, 13.6), (42.6, 31.1, 25.6), (59.2, 53.1, 43.8)),
    ((4.4, 3.0, 2.3), (5.6, 3.8, 2.7), (7.7, 5.8, 5.2), (10.9, 8.5, 7.4), (18.0, 14.0, 12.4)),
    ((2.3, 1.3, 0.8), (3.0, 1.9, 1.4), (4.4, 2.9, 2.1), (6.6, 4.5, 3.4), (11.8, 8.0, 6.2)),
    ((7.8, 5.6, 4.0), (10.4, 7.7, 6.5), (15.6, 12.1, 9.9), (28.9, 24.1, 21.2), (48.0, 40.3, 37.3)),
    ((5.5, 2.9, 2.0), (7.0, 3.7, 2.4), (10.4, 5.8, 4.1), (18.3, 12.5, 10.4), (32.6, 22.3, 18.9)),
)
#: Least distance of the last two of these statistics that p is continued by.
LEAST_STEP = 0.3
#: Least p of the battery, as the statistic's quantile: chi-squared with 6 degrees of freedom exceeds 22.46 once in 1000.
PLAUSIBLE = 22.46
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches that are put to one list before the list joins those of the text: appending one by one copies all before it.
CHUNK = 256


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has at least so many characters, in code points.

    A match begins where the pieces between matches and the matches before it end.
    """
    parts = [F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    none = F.array().cast(_SPANS)

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["0"])
        end = start + F.coalesce(F.length(x["1"]), F.lit(0))
        ok = x["1"].isNotNull() & (F.length(x[str(len(parts) - 1)]) >= least)
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(ok, F.concat(so_far["spans"], one)).otherwise(so_far["spans"]).alias("spans"))

    def walked(pieces: Column) -> Column:
        def chunk(so_far: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK)), F.struct(so_far["at"].alias("at"), none.alias("spans")), step)
            return let(own, lambda p: F.struct(p["at"].alias("at"), F.concat(so_far["spans"], p["spans"]).alias("spans")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("spans")), chunk)

    return let(F.arrays_zip(*parts), walked)["spans"]


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic approximation (error under 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(500.0), 0.07056 * z * z * z + 1.5976 * z)))


def _both_tails(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def statistic(token: Column) -> Column:
    """Fisher's -2 * sum(log p) of the battery under the hypothesis that the token is random in its alphabet.

    Padding signs (=) are left out. Where all symbols lie on one side of the alphabet's middle, or all are equal, the
    runs or correlation test has the smallest p. (x < 20 symbols don't occur: tokens have 20 characters at least.)
    """
    alphabet = reduce(lambda rest, a: F.when(token.rlike(a[0]), F.lit(a[1])).otherwise(rest), reversed(ALPHABETS), F.lit(URL_SAFE))
    tiny = 1e-12

    def battery(s: Column, size: Column) -> Column:
        n = F.size(s).cast("double")
        parts = F.when(n < 2 * 4 * EXPECTED, 4.0).when(n < 4 * 4 * EXPECTED, 8.0).otherwise(16.0)
        within = lambda k: F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda b: F.size(F.filter(s, lambda x: F.floor(x * k / size) == b)).cast("double"))
        chi = let(parts, lambda k: F.aggregate(within(k), F.lit(0.0), lambda a, c: a + c * c) * k / n - n)
        free = parts - 1
        uniform = _upper_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        high = F.transform(s, lambda x: (x * 2 >= size).cast("int"))
        up = F.aggregate(high, F.lit(0.0), lambda a, x: a + x)
        down = n - up
        later, sooner = F.slice(s, F.lit(2), F.size(s)), F.slice(s, F.lit(1), F.size(s) - 1)
        turns = F.aggregate(F.zip_with(F.slice(high, F.lit(2), F.size(s)), F.slice(high, F.lit(1), F.size(s) - 1), lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda a, x: a + x)
        mean = 2 * up * down / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(spread > 0, _both_tails((turns + 1 - mean) / F.sqrt(F.greatest(spread, F.lit(tiny))))).otherwise(F.lit(tiny))
        level = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
        power = let(level, lambda m: F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        along = let(level, lambda m: F.aggregate(F.zip_with(later, sooner, lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda a, x: a + x))
        serial = F.when(power > 0, _both_tails((along / F.greatest(power, F.lit(tiny)) + 1 / n) * F.sqrt(n))).otherwise(F.lit(tiny))
        return -2 * (F.log(F.greatest(uniform, F.lit(tiny))) + F.log(F.greatest(runs, F.lit(tiny))) + F.log(F.greatest(serial, F.lit(tiny))))

    def indexed(a: Column) -> Column:
        symbols = F.transform(F.split(F.regexp_replace(token, "=", ""), ""), lambda c: (F.instr(a, c) - 1).cast("double"))
        return let(F.filter(symbols, lambda x: x >= 0), lambda s: F.when(F.size(s) >= 8, battery(s, F.length(a).cast("double"))).otherwise(F.lit(1000.0)))

    return let(alphabet, indexed)


def _family(token: Column) -> Column:
    """Place in FAMILIES."""
    mixed = (~token.rlike("^[A-Za-z]+=*$")).cast("int")
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0).when(token.rlike("^[A-Z2-7]+=*$"), 1 + mixed).otherwise(3 + mixed)


def _class(length: Column) -> Column:
    return F.array_max(F.array(*(F.when(length >= low, i).otherwise(0) for i, low in enumerate(CLASSES))))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, base (spans) and tokens (start, end, inside, family, class, bin) of every whole text.

    inside: the token holds an access or hex span, which lie in one token each. A token is the whole run of its characters.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(_SPANS)
    found = lambda test, pattern, *more: F.when(text.rlike(test), spans(text, pattern, *more)).otherwise(none)
    base = F.concat(found(KEYWORD, ASSIGN, 0, 2, 6), found("AKIA", ACCESS, 1), found(HEX, HEX, 2))
    long = found(TOKEN, TOKEN, 3)
    written = F.when(text.rlike(TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    tokens = F.zip_with(long, written, lambda x, w: F.struct(x["start"].alias("start"), x["end"].alias("end"), w.alias("token")))
    measured = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].rlike(f"{ACCESS}|{HEX}").alias("inside"), _family(x["token"]).alias("family"), _class(F.length(x["token"])).alias("class"), F.least(F.lit(BINS - 1), F.floor(2 * statistic(x["token"]))).cast("int").alias("bin")))
    return documents.select("doc_id", F.array_sort(base).alias("base"), measured.alias("tokens"))


def p_value(family: int, length_class: int, bin: int) -> float:
    """Share of plain tokens whose statistic is at or under the bin's upper end."""
    one, ten, last = NULL[family][length_class]
    top = (bin + 1) / 2
    if top > one:
        return 1.0
    if top > ten:
        return 10 ** (-2 - (one - top) / (one - ten))
    return 10 ** (-3 - math.log10(5) * (ten - top) / max(ten - last, LEAST_STEP))


def cutoffs(tokens: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[int, int], int]:
    """Highest bin accepted in each family and class. tokens: (family, class, bin); at most families * classes * BINS rows are collected."""
    counts = {(r["family"], r["class"], r["bin"]): r["count"] for r in tokens.groupBy("family", "class", "bin").count().collect()}
    limits: dict[tuple[int, int], int] = {}
    for family in range(len(FAMILIES)):
        tested = sorted((p_value(*k), n) for k, n in counts.items() if k[0] == family)
        total, rank, accepted = sum(n for _, n in tested), 0, 0.0
        for value, n in tested:
            rank += n
            if value * total <= false_share * rank:
                accepted = value
        for c in range(len(CLASSES)):
            limits[family, c] = max((b for b in range(BINS) if p_value(family, c, b) <= accepted and b <= 2 * PLAUSIBLE), default=-1)
    return limits


def _written(sorted_spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(sorted_spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_spans(documents: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row for each row of documents.

    A null text is empty and has no spans (base_sha256 is then the hash of the empty text). An added span overlaps no base
    span. Repeated rows give repeated rows, null ids are carried, an empty table gives no rows. Very long texts, and those with
    very many matches, are read whole, in time that grows with their length. A table in which few or no tokens are tested has
    the same null as any other. Tokens of one bin are accepted together. Other columns are not read.
    """
    table = Scratch(documents.sparkSession, "secrets").table(candidates(documents), "candidates")
    limits = cutoffs(table.select(F.explode("tokens").alias("t")).select("t.family", "t.class", "t.bin"), false_share)
    limit = F.array(*(F.lit(limits[f, c]) for f in range(len(FAMILIES)) for c in range(len(CLASSES))))

    def accepted(assigned: Column) -> Column:
        def ok(x: Column) -> Column:
            apart = ~F.exists(assigned, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            return (x["bin"] <= F.element_at(limit, x["family"] * len(CLASSES) + x["class"] + 1)) & ~x["inside"] & apart

        return F.filter("tokens", ok)

    found = let(F.filter("base", lambda b: b["kind"] == 0), accepted)
    added = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return table.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )
