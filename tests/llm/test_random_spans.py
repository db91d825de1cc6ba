import math
import random
import re
import string
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import null_tokens

from quillspark.llm.secret_scan import ACCESS, ALPHABETS, ASSIGN, BINS, CLASSES, FAMILIES, HEX, KINDS, NULL, PLAUSIBLE, TOKEN, URL_SAFE, p_value, secret_spans


def test_random_tokens_need_no_null_tokens_in_the_table(spark):
    rng = random.Random(11)
    base64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [(i, "see " + word(base64, 64) + " there") for i in range(3)]
    rows += [(100 + i, "see " + word("0123456789ABCDEF", 64) + " there") for i in range(3)]
    rows += [(200 + i, "see " + word(string.ascii_letters, 80) + " there") for i in range(3)]
    rows.append((300, "no long token"))
    got = {r["doc_id"]: r["n_random"] for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(sum(got[k + i] for i in range(3)) >= 2 for k in (0, 100, 200)) and got[300] == 0


def test_null_values(spark):
    """A sample of other plain tokens gives about the fixed values."""
    got = null_tokens.quantiles(spark, 2000, 5)
    assert all(abs(a[0] - b[0]) <= max(1.0, 0.25 * b[0]) for x, y in zip(got, NULL) for a, b in zip(x, y))


def test_plain_tokens_are_no_finds(spark):
    rows = [(i, t) for i, (_, _, t) in enumerate(null_tokens.rows(100, 9))]
    got = secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).agg({"n_random": "sum"}).first()[0]
    assert got <= 25


def upper(z):
    return 1 / (1 + math.exp(min(500.0, 0.07056 * z**3 + 1.5976 * z)))


def statistic(token):
    """The battery by its definition, on the symbols' places in the alphabet."""
    alphabet = next((a for test, a in ALPHABETS if re.fullmatch(test.strip("^$"), token)), URL_SAFE)
    s = [alphabet.index(c) for c in token.replace("=", "") if c in alphabet]
    n, size, tiny = len(s), len(alphabet), 1e-12
    if n < 8:
        return 1000.0
    k = 4 if n < 40 else 8 if n < 80 else 16
    counts, tail = [sum(x * k // size == b for x in s) for b in range(k)], 2 / (9 * (k - 1))
    chi = sum((c - n / k) ** 2 / (n / k) for c in counts)
    uniform = upper(((max(chi, 0.0) / (k - 1)) ** (1 / 3) - (1 - tail)) / tail**0.5)
    high = [2 * x >= size for x in s]
    up = sum(high)
    runs, mean = 1 + sum(a != b for a, b in zip(high, high[1:])), 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    level = sum(s) / n
    power, along = sum((x - level) ** 2 for x in s), sum((a - level) * (b - level) for a, b in zip(s, s[1:]))
    p = [uniform, min(1.0, 2 * upper(abs(runs - mean) / spread**0.5)) if spread > 0 else tiny, min(1.0, 2 * upper(abs(along / power + 1 / n) * n**0.5)) if power > 0 else tiny]
    return -2 * sum(math.log(max(x, tiny)) for x in p)


def family(token):
    mixed = re.fullmatch("[A-Za-z]+=*", token) is None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        return 0
    return 1 + mixed if re.fullmatch("[A-Z2-7]+=*", token) else 3 + mixed


def brute_spans(texts, share=0.01):
    """Spans of all texts, base ones and those added: Benjamini-Hochberg over every token of a family, one p at a time."""
    base, tested = {}, []
    for i, t in texts.items():
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN.replace("\\x20", " ").replace("(?i:", "(?i:"), t, re.A) if len(m[2]) >= 6]
        found += [(m.start(), k, m.end()) for k, pattern in ((1, ACCESS), (2, HEX)) for m in re.finditer(pattern, t)]
        base[i] = sorted(found)
        for m in re.finditer(TOKEN, t):
            length_class = max(k for k, low in enumerate(CLASSES) if len(m[0]) >= low)
            bin_ = min(BINS - 1, math.floor(2 * statistic(m[0])))
            tested.append((p_value(family(m[0]), length_class, bin_), family(m[0]), bin_, i, m.start(), m.end()))
    added = {i: [] for i in texts}
    for f in range(len(FAMILIES)):
        own = sorted(x for x in tested if x[1] == f)
        rank = max((k for k, x in enumerate(own, 1) if x[0] * len(own) <= share * k), default=0)
        for _, _, bin_, i, a, b in (x for x in own if rank and x[0] <= own[rank - 1][0]):
            if bin_ <= 2 * PLAUSIBLE and all(b <= s or e <= a for s, _, e in base[i]):
                added[i].append((a, 3, b))
    return {i: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base[i] + added[i])) for i in texts}


def test_spans_match_brute_force(spark, data):
    rng = random.Random(21)
    signs = {"base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789ABCDEF", "low": "0123456789abcdef", "b32": string.ascii_uppercase + "234567", "url": string.ascii_letters + string.digits + "-_"}
    made = []
    for i in range(240):
        words = [rng.choice(["plain", "antidisestablishmentarianism", "a-very-plain-name-of-many-parts", "x" * 30, "secret_of_the_longest_name_ever"]) for _ in range(rng.randint(1, 5))]
        if i % 3:
            words.append("".join(rng.choice(signs[rng.choice(list(signs))]) for _ in range(1)) + "".join(rng.choice(signs[k]) for k in [rng.choice(list(signs))] for _ in range(rng.choice([19, 23, 31, 43, 63, 90]))))
        if i % 7 == 0:
            words.append("token=" + "".join(rng.choice(signs["base64"]) for _ in range(40)))
        made.append((i, " ".join(words)))
    stored = [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data()}/documents.parquet").select("doc_id", "text").collect()]
    texts = dict(made + stored + [(900, None), (901, "")])
    got = {r["doc_id"]: r["spans"] for r in secret_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_spans(texts)
    assert sum("random" in x for x in got.values()) > 30


def test_a_planted_secret_among_ten_texts(spark):
    rng = random.Random(5)
    found = 0
    for _ in range(8):
        secret = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(44))
        rows = [(i, "plain words, and anotherratherlongwordhere too") for i in range(9)] + [(9, f"key {secret} end")]
        found += {r["doc_id"]: r["n_random"] for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[9]
    assert found >= 5


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i:032x}" for i in range(20_000))
    row = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_hex"] == 20_000 and row["n_random"] == 0 and row["spans"].endswith(f"hex:{len(text) - 32}:{len(text)}")
