"""The plain tokens whose statistics are the fixed null of operator 8: python tests/llm/null_tokens.py prints secret_scan.NULL,
with the argument power the table of its power."""

import random
import re
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

WORDS = """the and for with from that this have value name count index table field column record number string token
user group order item page list time date year month day hour version release update create delete insert select
result error message request response server client session account address service system process thread worker
network package module class object method function parameter variable config option default example internal external
country language people world history science music water island station village river church school family company
der und die nicht eine werden haus zeit arbeit einheit strasse gesellschaft para como pero tiempo ciudad trabajo
nacional gobierno dans pour avec sont cette ville temps monde maison travail quality width height length address""".split()
#: Lower ends of the length classes and the longest token of the last.
ENDS = (20, 24, 32, 48, 64, 129)


def _digits(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}{rng.randrange(24):02}{rng.randrange(60):02}{rng.randrange(60):02}"
    if kind == 1:
        return str(rng.randrange(10 ** rng.randint(1, 5))).zfill(rng.choice((6, 8, 10, 12)))
    if kind == 2:
        return rng.choice("0123456789abcdef") * rng.randint(4, 16)
    return rng.choice(("deadbeef", "cafebabe", "0123456789", "abcdef", "facade", "decade", "12345678"))


def family(token):
    """Place in secret_scan.FAMILIES."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        return 0
    return (1 if re.fullmatch("[A-Z2-7]+", token) else 3) + (not re.fullmatch("[A-Za-z]+", token))


def plain(kind, low, high, rng):
    """A token of structured digits (hex), of upper-case words (base32), or of words in common styles (base64 and url-safe)."""
    n, style, out = rng.randrange(low, high), rng.randrange(6), ""
    while len(out) < n:
        word = rng.choice(WORDS)
        if kind == 0:
            out += _digits(rng)
        elif kind < 3:
            out += word.upper() + (str(rng.randint(2, 7)) if kind == 2 and rng.random() < 0.2 else "")
        elif kind == 3:
            out += word.capitalize() if style % 2 else word
        else:
            number = str(rng.randrange(10 ** rng.randint(1, 4))) if rng.random() < 0.15 else ""
            out += (word, word.capitalize(), ("_" if out else "") + word, ("-" if out else "") + word, ("/" if out else "") + word, "_" * bool(out) + word.upper())[style] + number
    out = out[:n]
    out = out.upper() if kind == 0 and rng.random() < 0.5 else out
    return out if family(out) == kind else plain(kind, low, high, rng)


def rows(each, seed=1):
    """(family, class, token)."""
    rng = random.Random(seed)
    return [(k, c, plain(k, ENDS[c], ENDS[c + 1], rng)) for k in range(5) for c in range(5) for _ in range(each)]


def quantiles(spark, each=50_000, seed=1):
    """By family and class: the statistics that one in a hundred, one in a thousand and one in 5000 tokens are at or under."""
    from pyspark.sql import functions as F

    from quillspark.llm.secret_scan import statistic

    df = spark.createDataFrame(rows(each, seed), "k int, c int, token string").repartition(64)
    got = df.select("k", "c", statistic(F.col("token")).alias("s")).groupBy("k", "c").agg(F.percentile("s", F.array(F.lit(0.01), F.lit(0.001), F.lit(0.0002))).alias("q")).collect()
    found = {(r["k"], r["c"]): tuple(round(x, 1) for x in r["q"]) for r in got}
    return tuple(tuple(found[k, c] for c in range(5)) for k in range(5))


def power(spark, draws=300, tested=(10, 1000, 100_000), seed=3):
    """Share of random tokens that are found where they are the only ones among so many tested: {(encoding, length): shares}."""
    from pyspark.sql import functions as F

    from quillspark.llm.secret_scan import CLASSES, FALSE_SHARE, PLAUSIBLE, p_value, statistic

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    signs = {"hex, upper case": "0123456789ABCDEF", "base32": letters + "234567", "base64": letters + letters.lower() + "0123456789+/"}
    rng = random.Random(seed)
    made = [(name, n, "".join(rng.choices(s, k=n))) for name, s in signs.items() for n in (24, 32, 44, 64, 88) for _ in range(draws)]
    got = spark.createDataFrame(made, "name string, n int, token string").repartition(8).select("name", "n", "token", F.floor(2 * statistic(F.col("token"))).cast("int").alias("bin")).collect()
    found = {}
    for r in got:
        p = p_value(family(r["token"]), max(i for i, low in enumerate(CLASSES) if len(r["token"]) >= low), r["bin"])
        hits = found.setdefault((r["name"], r["n"]), [0] * len(tested))
        for k, m in enumerate(tested):
            hits[k] += p * m <= FALSE_SHARE and r["bin"] <= 2 * PLAUSIBLE
    return {k: [round(h / draws, 2) for h in v] for k, v in sorted(found.items())}


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    print(power(spark) if sys.argv[1:] == ["power"] else quantiles(spark))
