"""Profiles of a manifest: totals, distributions, class imbalance, homogeneity, weights, channel moments."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import ratio
from quillspark.scratch import Scratch


def totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows, readable, missing, zero_byte, unreadable and bytes, over all or by group (A1, A2)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if("readable").alias("readable"),
        F.count_if(~F.col("exists")).alias("missing"),
        F.count_if(F.col("exists") & (F.col("size_bytes") == 0)).alias("zero_byte"),
        F.count_if(F.col("exists") & (F.col("size_bytes") > 0) & ~F.col("readable")).alias("unreadable"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
    )


def class_counts(df: DataFrame, classes: int, by: str = "split", label: str = "label") -> DataFrame:
    """count for every group and class of the grid, zeros included."""
    grid = df.select(by).distinct().crossJoin(df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label)))
    found = df.where(F.col(label).between(0, classes - 1)).groupBy(by, label).count()
    return grid.join(found, [by, label], "left").select(by, label, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def value_counts(df: DataFrame, column: str, unknown: str = "<unknown>") -> DataFrame:
    """Values and their counts, most frequent first; '' and null count as unknown (A4)."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(unknown)).alias("value")
    return df.groupBy(value).count().orderBy(F.desc("count"), "value")


#: Bins that a range of values is cut into where a rank is looked for.
PERCENTILE_BINS = 1024


def summaries(df: DataFrame, shares: Mapping[str, Sequence[float]], bins: int = PERCENTILE_BINS) -> dict[str, dict]:
    """For each column n, mean, std (of a sample; 0 for one value), lo, hi, and exact percentiles `at` with linear interpolation (T4).

    Nulls, NaN and infinite values aren't measured; without any other, n is 0 and all else null. The columns are written once, as doubles,
    and the same job makes the moments and a sketch that brackets each wanted rank between two values. Rows below are counted, those
    inside fall into bins, and the bin that holds the rank is the next bracket, until it holds one value: a job a round for
    all columns together. A bracket's ends fall into its first and last bin, so that each round leaves fewer values; what is collected
    has a fixed number of rows a rank, however many rows there are.
    """
    if not shares:
        return {}
    names = {c: f"x{i}" for i, c in enumerate(shares)}
    value = {c: F.col(c).cast("double") for c in shares}
    measured = df.select(*(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(names[c]) for c, x in value.items()))
    ends = {c: [e for p in ps for e in (max(0.0, p - 4e-4), min(1.0, p + 4e-4))] for c, ps in shares.items()}
    # The sketch's error is 1 in 10000 of the rows; a slack of four times that, and the extremes, hold each rank.
    seen, metrics = Observation(), []
    for c, x in names.items():
        metrics += [F.count(x).alias(f"n_{x}"), F.avg(x).alias(f"mean_{x}"), F.stddev_samp(x).alias(f"std_{x}"), F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}")]
        metrics += [F.percentile_approx(x, F.array(*map(F.lit, ends[c])), 10_000).alias(f"e_{x}")] if ends[c] else []
    scratch = Scratch(df.sparkSession, "percentiles")
    table, sketch = scratch.table(measured.observe(seen, *metrics), "columns"), seen.get
    out: dict[str, dict] = {}
    open_: dict[tuple[str, int], tuple[float, float, int | None]] = {}  # (column, rank) -> low, high, rows below (None: not counted yet)
    for c, x in names.items():
        s = out[c] = {k: sketch[f"{k}_{x}"] for k in ("n", "mean", "std", "lo", "hi")}
        s["std"] = 0.0 if s["n"] == 1 else s["std"]
        for j, p in enumerate(shares[c] if s["n"] else []):
            place, e = p * (s["n"] - 1), sketch[f"e_{x}"]
            low = s["lo"] if s["n"] <= 10_000 or ends[c][2 * j] == 0 else e[2 * j]
            high = s["hi"] if s["n"] <= 10_000 or ends[c][2 * j + 1] == 1 else e[2 * j + 1]
            for rank in {int(place), min(int(place) + 1, s["n"] - 1)}:
                open_[c, rank] = (low, high, 0 if low == s["lo"] else None)
    found: dict[tuple[str, int], float] = {}
    while open_:
        asked = list(open_.items())
        cells = []
        for k, ((c, _), (low, high, below)) in enumerate(asked):
            x = F.col(names[c])
            width, half = (high - low, 1.0) if high - low < float("inf") else (high / 2 - low / 2, 0.5)
            bin_ = F.least(F.lit(bins - 1), F.floor((x * half - low * half) / width * bins)) if high > low else F.lit(0)
            inside = F.when(x.between(low, high), bin_.cast("int"))
            if below is None:
                inside = F.when(x < low, F.lit(-1)).otherwise(inside)
            cells.append(F.struct(F.lit(k).alias("k"), inside.alias("bin"), x.alias("x")))
        counted = table.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bin IS NOT NULL").groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by: dict[int, list] = {}
        for r in counted.collect():  # at most bins + 1 rows a rank
            by.setdefault(r["k"], []).append(r)
        open_ = {}
        for k, ((c, rank), (_, _, below)) in enumerate(asked):
            upto = below or 0
            for r in sorted(by[k], key=lambda r: r["bin"]):
                if r["bin"] >= 0 and upto + r["n"] > rank:
                    if r["lo"] == r["hi"]:
                        found[c, rank] = r["lo"]
                    else:
                        open_[c, rank] = (r["lo"], r["hi"], upto)
                    break
                upto += r["n"]
    scratch.drop(table)
    for c, ps in shares.items():
        n, out[c]["at"] = out[c]["n"], []
        for p in ps:
            low = int(p * (n - 1)) if n else 0
            part = p * (n - 1) - low
            out[c]["at"].append((1 - part) * found[c, low] + part * found[c, min(low + 1, n - 1)] if n and abs(found[c, low]) > 1e300 else found[c, low] + part * (found[c, min(low + 1, n - 1)] - found[c, low]) if n else None)
    return out


def percentiles(df: DataFrame, shares: Mapping[str, Sequence[float]], bins: int = PERCENTILE_BINS) -> dict[str, list[float | None]]:
    """Exact percentiles of columns; cases as in summaries()."""
    return {c: s["at"] for c, s in summaries(df, shares, bins).items()}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, std, min, p25, median, p75, max of each column that has measured values; cases as in summaries() (A5)."""
    rows = [(c, s["n"], s["mean"], s["std"], s["lo"], *s["at"], s["hi"]) for c, s in summaries(df, {c: (0.25, 0.5, 0.75) for c in columns}).items() if s["n"]]
    names = "metric string, n long, mean double, std double, min double, p25 double, median double, p75 double, max double"
    return df.sparkSession.createDataFrame(rows, names)


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(F.nullif(F.col(column), F.lit(""))).alias("distinct"))


def repeated_ids(df: DataFrame, by: str = "split", key: str = "id_code") -> DataFrame:
    """Rows beyond the first of their id, by group."""
    return df.groupBy(by).agg((F.count("*") - F.count_distinct(key)).alias("repeated"))


def top_pairs(df: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    return df.groupBy(a, b).count().orderBy(F.desc("count"), a, b).limit(n)


def contingency(df: DataFrame, classes: int, by: str = "split", label: str = "label") -> DataFrame:
    """One column a class, total, and an overall row (A9, T22). The pivot's values are given, so the data isn't read for them."""
    counted = [F.count(F.when(F.col(label) == k, F.col("id_code"))).alias(str(k)) for k in range(classes)]
    rolled = df.where(F.col(label).between(0, classes - 1)).rollup(by).agg(F.grouping(by).alias("_all"), *counted, F.count("id_code").alias("total"))
    return rolled.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(by)).alias(by), *map(str, range(classes)), "total")


def imbalance(counts: DataFrame, classes: int, count: str = "count") -> DataFrame:
    """Ratio to the rarest present class, entropy in bits, its share of log2(classes), Gini and effective classes."""
    n = F.sum(count).cast("double")
    p = F.col("c") / F.col("n")
    rows = counts.crossJoin(counts.agg(n.alias("n"))).select(F.col(count).cast("double").alias("c"), "n")
    entropy = -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    out = rows.agg(F.max("c").alias("most"), F.min(F.when(F.col("c") > 0, F.col("c"))).alias("least"), entropy.alias("entropy"), (1 - F.sum(p * p)).alias("gini"), (1 / F.sum(p * p)).alias("simpson"))
    most_bits = F.log2(F.lit(float(classes)))
    return out.select(ratio(F.col("most"), F.col("least")).alias("ratio"), "entropy", most_bits.alias("max_entropy"), (1 - F.col("entropy") / most_bits).alias("imbalance_index"), "gini", F.pow(F.lit(2.0), F.col("entropy")).alias("effective_classes"))


def chi_square(counts: DataFrame, row: str = "split", column: str = "label", count: str = "count") -> DataFrame:
    """statistic, dof and p of homogeneity (A11). Rows and columns without counts take no part; without degrees of freedom p is null."""
    c = F.col(count).cast("double")
    everything = Window.partitionBy()
    cells = counts.withColumns({"r": F.sum(c).over(Window.partitionBy(row)), "k": F.sum(c).over(Window.partitionBy(column)), "n": F.sum(c).over(everything)}).where("r > 0 AND k > 0")
    expected = F.col("r") * F.col("k") / F.col("n")
    out = cells.agg(F.sum((c - expected) * (c - expected) / expected).alias("statistic"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).cast("long").alias("dof"))
    return out.withColumn("p_value", F.when(F.col("dof") > 0, upper_gamma(F.col("dof"), F.col("statistic") / 2)))


def upper_gamma(dof: Column, x: Column) -> Column:
    """Q(dof / 2, x), the regularised upper incomplete gamma function: a chi-squared variable's chance to exceed 2 * x.

    One less the series of the lower function, in logarithms: x**a * exp(-x) / gamma(a + 1) * (1 + x/(a+1) + x**2/((a+1)(a+2)) + ..).
    """
    a = dof / 2
    # log gamma(a + 1): from gamma(1) = 1 or gamma(1/2) = sqrt(pi) up, by whole steps.
    odd = (dof % 2).cast("int")
    first = F.when(odd == 1, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0))
    steps = F.sequence(F.lit(1), F.floor((dof + odd) / 2).cast("int"))
    log_gamma = first + F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.log(k - odd / 2.0))
    lead = a * F.log(x) - x - log_gamma
    # Terms grow until a + k exceeds x and then fall; ten deviations beyond that they don't count.
    terms = F.sequence(F.lit(1), F.ceil(F.greatest(F.lit(0.0), x - a) + 60 + 10 * F.sqrt(x + a)).cast("int"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.log(x) - F.log(a + k)
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    lower = F.aggregate(terms, F.struct(lead.alias("log"), F.exp(lead).alias("sum")), step)["sum"]
    return F.when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def class_weights(counts: DataFrame, strategy: str, label: str = "label", count: str = "count", beta: float = 0.9999) -> DataFrame:
    """Weights whose positive values have mean one; a class without rows has weight 0."""
    return class_weight_table(counts, [strategy], label, count, beta).drop("strategy")


def class_weight_table(counts: DataFrame, strategies: Sequence[str], label: str = "label", count: str = "count", beta: float = 0.9999) -> DataFrame:
    """(strategy, label, weight) of several strategies, from one pass over the counts."""
    everything, each = Window.partitionBy(), Window.partitionBy("strategy")
    c = F.col("c")
    raw: dict[str, Column] = {
        "inverse": 1 / c,
        "inverse_sqrt": 1 / F.sqrt(c),
        "effective_number": (1 - beta) / (1 - F.pow(F.lit(beta), c)),
        "balanced": F.col("n") / (F.col("k") * c),
    }
    if unknown := set(strategies) - set(raw):
        raise ValueError(f"unknown weight strategy {', '.join(sorted(unknown))}")
    counted = F.col(count).cast("double")
    rows = counts.select(label, counted.alias("c"), F.sum(counted).over(everything).alias("n"), F.count("*").over(everything).alias("k"))
    weighed = F.array(*(F.struct(F.lit(s).alias("strategy"), F.when(c > 0, raw[s]).otherwise(0.0).alias("w")) for s in strategies))
    weights = rows.select(label, F.explode(weighed).alias("s")).select("s.strategy", label, "s.w")
    mean = F.avg(F.when(F.col("w") > 0, F.col("w"))).over(each)
    return weights.select("strategy", label, F.when(F.col("w") > 0, F.col("w") / mean).otherwise(0.0).alias("weight"))


def channel_moments(df: DataFrame, values: str) -> DataFrame:
    """Mean and population deviation of each place of an array column: partial sums before one small shuffle."""
    return df.select(F.posexplode(values).alias("channel", "x")).groupBy("channel").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def moment_states(df: DataFrame, values: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, channel, n, mean, m2) of each place of an array column: what merge_moments adds up (A13). Null and NaN entries don't count."""
    x = F.when(~F.isnan("x"), F.col("x"))
    each = df.select(*by, F.posexplode(values).alias("channel", "v")).withColumn("x", F.col("v").cast("double")).withColumn("x", x)
    return each.groupBy(*by, "channel").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))


def merge_moments(parts: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    """n, mean and population deviation from (n, mean, m2) parts, for any split of the data, however large the means.

    Spread between parts is added up about the grand mean itself, which a first grouping finds; squares of means aren't subtracted.
    Parts without values take no part.
    """
    held = parts.where("n > 0")
    grand = held.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    apart = F.col("mean") - F.col("grand")
    about = held.join(grand, list(by)).groupBy(*by).agg(F.sum("n").alias("n"), F.first("grand").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"))
    return about.select(*by, "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))


#: The usual means and deviations of colour images.
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))


def normalization(df: DataFrame | None, mode: str, values: str = "", given: tuple[Sequence[float], Sequence[float]] | None = None, cached: dict | None = None, key: str = "") -> tuple[list[float], list[float]]:
    """Constants, the configuration's values, or measured ones, from a cache of the same key where there is one."""
    if mode == "imagenet":
        return list(IMAGENET[0]), list(IMAGENET[1])
    if mode == "config":
        if given is None:
            raise ValueError("mode config needs values")
        return list(given[0]), list(given[1])
    if mode != "auto":
        raise ValueError(f"unknown normalization {mode}")
    if cached and cached.get("key") == key:
        return cached["mean"], cached["std"]
    rows = channel_moments(df, values).orderBy("channel").collect()  # a row for each channel
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(label), F.lit(-1)).alias("label")).count()
