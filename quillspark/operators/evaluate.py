"""Ordinal evaluation and calibration.

The predictions are read once into a K x K table (and once into bins); every confusion metric follows from that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import ratio, referable_probability
from quillspark.scratch import Scratch


def confusion(df: DataFrame, classes: int, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(truth, predicted, n) on the whole grid."""
    spark = df.sparkSession
    axis = lambda name: spark.range(classes).select(F.col("id").cast("int").alias(name))
    found = df.groupBy(F.col(label).cast("int").alias("truth"), F.col(prediction).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return axis("truth").crossJoin(axis("predicted")).join(F.broadcast(found), ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(table: DataFrame, classes: int) -> DataFrame:
    return table.groupBy(F.col("truth").alias("true_grade")).agg(*(F.sum(F.when(F.col("predicted") == k, F.col("n")).otherwise(0)).alias(f"pred_{k}") for k in range(classes)))


def row_normalized(table: DataFrame) -> DataFrame:
    n = F.sum("n").over(Window.partitionBy("truth"))
    return table.select("truth", "predicted", ratio(F.col("n"), n, 0.0).alias("share"))


def quadratic_kappa(table: DataFrame) -> DataFrame:
    """1 - sum(w * observed) / sum(w * expected), w = (i - j)**2 (A25); null where nothing is expected."""
    everything = Window.partitionBy()
    cells = table.withColumns({"r": F.sum("n").over(Window.partitionBy("truth")), "c": F.sum("n").over(Window.partitionBy("predicted")), "all": F.sum("n").over(everything)})
    w = F.pow((F.col("truth") - F.col("predicted")).cast("double"), 2)
    return cells.agg(F.sum(w * F.col("n")).alias("o"), F.sum(w * F.col("r") * F.col("c") / F.col("all")).alias("e")).select((1 - ratio(F.col("o"), F.col("e"))).alias("qwk"))


def agreement(table: DataFrame) -> DataFrame:
    """accuracy, mae and within_one."""
    n, d = F.sum("n"), F.abs(F.col("truth") - F.col("predicted"))
    share = lambda test: ratio(F.sum(F.when(test, F.col("n")).otherwise(0)), n)
    return table.agg(share(d == 0).alias("accuracy"), ratio(F.sum(d * F.col("n")), n).alias("mae"), share(d <= 1).alias("within_one"))


def per_class(table: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of every class; 0 where undefined."""
    both = table.select(F.col("truth").alias("grade"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_n"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).union(
        table.select(F.col("predicted"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long"))
    )
    sums = both.groupBy("grade").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n"))
    return sums.select("grade", ratio(F.col("hit"), F.col("predicted_n"), 0).alias("precision"), ratio(F.col("hit"), F.col("support"), 0).alias("recall"), ratio(2 * F.col("hit"), F.col("predicted_n") + F.col("support"), 0).alias("f1"), "support")


def macro_f1(table: DataFrame) -> DataFrame:
    return per_class(table).agg(F.avg("f1").alias("macro_f1"))


def referable_miss_rate(table: DataFrame, first: int = 2) -> DataFrame:
    """Share of referable truths that are predicted below first; null without any."""
    high = F.col("truth") >= first
    return table.agg(ratio(F.sum(F.when(high & (F.col("predicted") < first), F.col("n")).otherwise(0)), F.sum(F.when(high, F.col("n")).otherwise(0))).alias("fnr"))


def auc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with ties at half; null where one class is missing.

    Rows first shrink to counts by distinct score. The running counts over those are made in slices between 1023 approximate
    quantiles, whatever the scores' range, whose few totals are added, so no task orders all scores.
    """
    by_score = df.select(score.cast("double").alias("s"), positive.cast("int").alias("y")).where("s IS NOT NULL AND y IS NOT NULL").groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    edges_ = by_score.agg(F.percentile_approx("s", F.array(*(F.lit(i / 1024) for i in range(1, 1024))), 10_000).alias("edges"))
    # How many edges are at or under the score, by halving.
    under = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(10)))), F.lit(0), lambda n, step: F.when(F.get("edges", n + step - 1) <= F.col("s"), n + step).otherwise(n))
    cut = by_score.crossJoin(F.broadcast(edges_)).select("s", "p", "q", under.alias("slice"))  # one row of edges
    per = cut.groupBy("slice").agg(F.sum("q").alias("sq"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("slice", F.coalesce(F.sum("sq").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("inner", F.coalesce(F.sum("q").over(inside), F.lit(0))).join(F.broadcast(base), "slice")
    wins = F.sum(F.col("p") * (F.col("base") + F.col("inner") + F.col("q") / 2.0))
    return placed.agg(ratio(wins, F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def referable_auc(df: DataFrame, first: int = 2, probs: str = "probs", label: str = "label") -> DataFrame:
    return auc(df, referable_probability(F.col(probs), first), F.col(label) >= first)


def bin_of(confidence: Column, edges: Sequence[float]) -> Column:
    """Which (lo, hi] interval holds the confidence; null for one on or under the first edge."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        out = F.when((confidence > low) & (confidence <= high), i).otherwise(out)
    return out


def edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def reliability(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """bin, center, n, accuracy, confidence of every bin; null means for empty ones."""
    e = edges(bins)
    found = df.select(bin_of(confidence, e).alias("bin"), confidence.alias("c"), correct.cast("double").alias("k")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg("k").alias("accuracy"), F.avg("c").alias("confidence"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ((F.col("id") + 0.5) / bins).alias("center"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", "center", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy", "confidence")


def calibration_error(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected calibration error: bins weighted by their share of all rows (A30); rows: one column n."""
    gaps = table.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.lit(0.0)).alias("gap"))
    return gaps.crossJoin(rows).select(ratio(F.col("gap"), F.col("n")).alias("ece"))


def metric_bundle(df: DataFrame, classes: int, bins: int = 10, first: int = 2, label: str = "label", probs: str = "probs", prediction: str = "prediction") -> DataFrame:
    """One row with all metrics (A32). df is read once: what the metrics need of it, four numbers a row, and the K x K table are written."""
    scratch = Scratch(df.sparkSession, "metrics")
    slim = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"), referable_probability(F.col(probs), first).alias("score"), F.array_max(probs).alias("confidence"))
    slim = scratch.table(slim, "predictions")
    table = scratch.table(confusion(slim, classes).coalesce(1), "confusion")
    parts = [quadratic_kappa(table), agreement(table), macro_f1(table), auc(slim, F.col("score"), F.col("label") >= first), referable_miss_rate(table, first)]
    calibrated = reliability(slim, F.col("confidence"), F.col("prediction") == F.col("label"), bins)
    parts += [calibration_error(calibrated, slim.agg(F.count("*").alias("n"))), slim.agg(F.count("*").alias("rows"))]
    result = scratch.table(reduce(DataFrame.crossJoin, parts), "bundle")
    scratch.drop_all(but=result)
    return result


def with_class_names(df: DataFrame, column: str, names: Sequence[str], out: str = "class_name") -> DataFrame:
    """Display names, class_{i} where there is none."""
    listed = F.get(F.array(*map(F.lit, names)), F.col(column))
    return df.withColumn(out, F.coalesce(listed, F.concat(F.lit("class_"), F.col(column).cast("string"))))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))
