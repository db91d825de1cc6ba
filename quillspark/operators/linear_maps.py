"""Linear layers over rows: products with weights of any size as a join of blocks, and heads fitted from a Gram matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot

BLOCK = 16


def weight_blocks(spark: SparkSession, matrix: Sequence[Sequence[float]], bias: Sequence[float] | None = None, block: int = BLOCK) -> DataFrame:
    """(block, unit, w, bias): a row for each unit and each run of block inputs. A matrix may as well come from a table of such rows."""
    rows = [(b // block, u, [float(x) for x in row[b : b + block]], float(bias[u]) if bias is not None and b == 0 else 0.0) for u, row in enumerate(matrix) for b in range(0, len(row), block)]
    return spark.createDataFrame(rows, "block int, unit int, w array<double>, bias double")


def linear(df: DataFrame, key: str, vector: str, weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, unit, value): weights times each row's vector plus bias, as a join on the block of inputs and a sum.

    key must name rows. Rows whose vector is null or empty have no values; entries beyond the weights' inputs and missing ones count
    as nought; a null entry makes its row's values null.
    """
    runs = F.sequence(F.lit(0), F.ceil(F.size(vector) / block).cast("int") - 1)
    cut = df.where(F.size(vector) > 0).select(key, F.col(vector).cast("array<double>").alias("_v"), F.explode(runs).alias("block"))
    parts = cut.select(key, "block", F.slice("_v", F.col("block") * block + 1, F.lit(block)).alias("_x"))
    short = F.least(F.size("_x"), F.size("w"))
    part = dot(F.slice("_x", F.lit(1), short), F.slice("w", F.lit(1), short)) + F.col("bias")
    met = parts.join(weights, "block").select(key, "unit", part.alias("_part"))
    whole = F.when(F.count("*") == F.count("_part"), F.sum("_part"))
    return met.groupBy(key, "unit").agg(whole.alias("value"))


def gram(df: DataFrame, inputs: Column, targets: Column, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'Y over all rows: products of entries, added up by place before the shuffle. (n + m) * n numbers reach the driver."""
    places = lambda low: F.sequence(low, F.lit(n + m - 1))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(places(i), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("z", i) * F.get("z", j)).alias("p")))))
    sums = df.select(F.concat(inputs, targets).alias("z")).select(F.inline(cells)).groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    xx, xy = np.zeros((n, n)), np.zeros((n, m))
    for r in sums:
        if r["j"] < n:
            xx[r["i"], r["j"]] = xx[r["j"], r["i"]] = r["p"]
        else:
            xy[r["i"], r["j"] - n] = r["p"]
    return xx, xy


def fitted_heads(df: DataFrame, vector: str, label: str, n: int, classes: int, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of both heads, classes units and then classes - 1 thresholds, by ridge regression in closed form.

    Targets are 1 for the row's class, else 0, and 1 for each threshold below it. Rows without a label in range, or whose vector isn't of n
    measured entries, take no part; without any rows all weights are nought.
    """
    used = df.where(F.col(label).between(0, classes - 1) & (F.size(vector) == n) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    y = F.transform(F.sequence(F.lit(0), F.lit(2 * classes - 2)), lambda k: F.when(k < classes, (k == F.col(label)).cast("double")).otherwise((F.col(label) > k - classes).cast("double")))
    xx, xy = gram(used, F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))), y, n + 1, 2 * classes - 1)
    solved = np.linalg.solve(xx + ridge * np.eye(n + 1), xy)
    return solved[:n].T, solved[n]


def head_logits(df: DataFrame, key: str, vector: str, weights: DataFrame, classes: int) -> DataFrame:
    """(key, classification_logits, ordinal_logits) of rows that have a vector."""
    values = linear(df, key, vector, weights)
    each = lambda k: F.max(F.when(F.col("unit") == k, F.col("value")))
    return values.groupBy(key).agg(F.array(*map(each, range(classes))).alias("classification_logits"), F.array(*map(each, range(classes, 2 * classes - 1))).alias("ordinal_logits"))
