"""Affine recurrences x(t) = a(t) * x(t-1) + b(t) over series of any length, as a parallel scan, and optimiser steps made of them.

A series is cut into slices of its order. Steps compose: after several of them x is still A * x + B. A first pass makes each slice's
(A, B), the few slice totals are folded, and a second pass runs within slices from the state that each begins with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import cosine_rate
from quillspark.scratch import Scratch

SLICE = 4096


def _run(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    out = np.empty(len(a))
    for i in range(len(a)):
        x = a[i] * x + b[i]
        out[i] = x
    return out


def affine_scan(df: DataFrame, series: str, step: str, a: str, b: str, name: str, start: float = 0.0, size: int = SLICE) -> DataFrame:
    """df with name: the value after each step, from start. Steps are whole numbers from 0 on, each once in a series; gaps are
    allowed. A null a or b is an error of the caller's."""
    cut = df.withColumn("_slice", F.floor(F.col(step) / size))
    columns = ["_series", "_slice", "_step", "_a", "_b"]
    plain = cut.select(F.col(series).alias("_series"), "_slice", F.col(step).alias("_step"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))

    def total(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_step")
        end = _run(part["_a"].to_numpy(), part["_b"].to_numpy(), 0.0)
        return pd.DataFrame({"_series": part["_series"].iloc[:1], "_slice": part["_slice"].iloc[:1], "_a": [part["_a"].prod()], "_b": end[-1:]})

    def fold(slices: pd.DataFrame) -> pd.DataFrame:
        slices = slices.sort_values("_slice")
        after = _run(slices["_a"].to_numpy(), slices["_b"].to_numpy(), start)
        return pd.DataFrame({"_series": slices["_series"], "_slice": slices["_slice"], "_from": np.concatenate([[start], after[:-1]])})

    def apply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_step")
        return pd.DataFrame({"_series": part["_series"], "_step": part["_step"], name: _run(part["_a"].to_numpy(), part["_b"].to_numpy(), part["_from"].iloc[0])})

    kind = df.schema[series].dataType.simpleString()
    totals = plain.groupBy("_series", "_slice").applyInPandas(total, f"_series {kind}, _slice long, _a double, _b double")  # size rows at most
    starts = totals.groupBy("_series").applyInPandas(fold, f"_series {kind}, _slice long, _from double")  # a row a slice
    states = plain.join(starts, ["_series", "_slice"]).select(*columns, "_from").groupBy("_series", "_slice").applyInPandas(apply, f"_series {kind}, _step {df.schema[step].dataType.simpleString()}, {name} double")
    return df.join(states, (df[series] == states["_series"]) & (df[step] == states["_step"])).drop("_series", "_step")


def accumulated(df: DataFrame, series: str, place: str, gradient: str, every: int) -> DataFrame:
    """(series, step, gradient): the mean of every consecutive gradients; a last, shorter run is averaged over what it has."""
    return df.groupBy(series, F.floor(F.col(place) / every).alias("step")).agg(F.avg(gradient).alias("gradient"))


def clipped(df: DataFrame, step: str, gradient: str, most: float) -> DataFrame:
    """Gradients scaled down at each step where their norm over all series exceeds most."""
    norms = df.groupBy(step).agg(F.sqrt(F.sum(F.col(gradient) * F.col(gradient))).alias("norm"))
    return df.join(norms, step).withColumn(gradient, F.col(gradient) * F.least(F.lit(1.0), most / (F.col("norm") + 1e-6)))


def adamw(df: DataFrame, series: str, step: str, gradient: str, rate: Column, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), epsilon: float = 1e-8, start: float = 0.0) -> DataFrame:
    """df with m, v and value: both moments and the parameter after each step, decoupled decay, bias corrected, steps numbered from 0."""
    scratch = Scratch(df.sparkSession, "adamw")
    one, two = betas
    g = F.col(gradient)
    first = df.withColumns({"_a1": F.lit(one), "_b1": (1 - one) * g, "_a2": F.lit(two), "_b2": (1 - two) * g * g})
    m = scratch.table(affine_scan(first, series, step, "_a1", "_b1", "m"), "m")
    v = scratch.table(affine_scan(m, series, step, "_a2", "_b2", "v"), "v")
    n = F.col(step) + 1
    change = (F.col("m") / (1 - F.pow(F.lit(one), n))) / (F.sqrt(F.col("v") / (1 - F.pow(F.lit(two), n))) + epsilon)
    moved = v.drop("_a1", "_b1", "_a2", "_b2").withColumns({"_a": 1 - rate * decay, "_b": -rate * change})
    out = scratch.table(affine_scan(moved, series, step, "_a", "_b", "value", start).drop("_a", "_b"), "value")
    scratch.drop_all(but=out)
    return out


def trained(df: DataFrame, series: str, order: list[str], gradient: str, every: int = 4, most: float = 1.0, base: float = 0.1, period: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(series, step, gradient, m, v, value) of each parameter over its ordered gradients: accumulation, clipping by the global norm, AdamW
    under a cosine rate. Null gradients are left out; places within a series are made by slices of its first order column, so that no
    task holds a whole series."""
    scratch = scratch or Scratch(df.sparkSession, "training")
    rows = df.where(F.col(gradient).isNotNull() & F.col(series).isNotNull())
    slices = rows.groupBy(series, _slice_of(order[0]).alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(series).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base_of = scratch.table(slices.select(series, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "slices")
    inside = Window.partitionBy(series, "_s").orderBy(*order)
    placed = rows.withColumn("_s", _slice_of(order[0])).withColumn("_k", F.row_number().over(inside) - 1).join(base_of, [series, "_s"])
    placed = placed.withColumn("place", F.col("_base") + F.col("_k"))
    steps = scratch.table(clipped(accumulated(placed, series, "place", gradient, every), "step", "gradient", most).select(series, "step", "gradient"), "steps")
    rate = cosine_rate(F.col("step") % period, period, base)
    return adamw(steps, series, "step", "gradient", rate)


def _slice_of(time: str) -> Column:
    """The hour that a timestamp lies in: what a series' order is cut into."""
    return F.date_trunc("hour", time)
