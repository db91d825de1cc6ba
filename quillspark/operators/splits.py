"""Split verification and regeneration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.profile import chi_square, class_counts
from quillspark.scratch import Scratch
from quillspark.sources.sinks import write_splits

STATUS = ("pass", "warn", "fail")


class LeakageError(ValueError):
    """Groups span splits in strict mode."""


def spanning_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of a key that stand in several splits, with their rows and splits (A14, A15); '' and null don't count.

    Counts are pre-aggregated by (key, split), so a hot value is a few rows by the time its splits meet.
    """
    per_split = df.where(F.col(key).cast("string") != "").groupBy(key, "split").count()
    return per_split.groupBy(key).agg(F.count("*").alias("splits"), F.sum("count").alias("rows")).where("splits > 1")


def offenders(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in several splits."""
    return df.join(spanning_keys(df, key).select(key), key, "left_semi")


def overlap_check(df: DataFrame, key: str, severity: str = "fail", examples: int = 20) -> DataFrame:
    bad = spanning_keys(df, key)
    return bad.agg(F.count("*").alias("values"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit(f"overlap:{key}").alias("check"), F.when(F.col("values") > 0, severity).otherwise("pass").alias("status"), "values", "rows")


def overlap_examples(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    return spanning_keys(df, key).orderBy(key).limit(n)


def coverage_shortfalls(df: DataFrame, classes: int, minimum: int) -> DataFrame:
    """Split and class pairs of the grid with fewer than minimum rows."""
    return class_counts(df, classes).where(F.col("count") < minimum)


def homogeneity_check(df: DataFrame, classes: int, alpha: float = 0.05) -> DataFrame:
    out = chi_square(class_counts(df, classes))
    return out.withColumn("status", F.when(F.col("p_value") < alpha, "warn").otherwise("pass"))


def proportions(df: DataFrame, classes: int) -> DataFrame:
    """Share of each class in its split, to four decimals, halves to even."""
    counts = class_counts(df, classes)
    sums = counts.groupBy("split").agg(F.sum("count").alias("n"))
    return counts.join(sums, "split").select("split", "label", F.bround(F.try_divide(F.col("count").cast("double"), F.col("n").cast("double")), 4).alias("share"))


def fold_status(checks: DataFrame) -> DataFrame:
    """The worst status: fail over warn over pass."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    return checks.agg(F.element_at(F.array(*map(F.lit, STATUS)), F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("status"))


def require_disjoint(df: DataFrame, key: str) -> None:
    """Raise where a key spans splits."""
    bad = spanning_keys(df, key).limit(3).collect()
    if bad:
        raise LeakageError(f"{key} spans splits, for example {[r[0] for r in bad]}")


def assign_groups(groups: DataFrame, ratios: Mapping[str, float], seed: int = 0, largest: int = 1000) -> DataFrame:
    """Stratified assignment of (group, label, n) to splits.

    The largest groups of several rows, a fixed number, go largest first (ties by sha256 of seed and group) to the split with
    the largest weighted deficit, first split on ties. All others are laid end to end in the order of that hash, by
    their commonest label, and cut where the label's rows still to be placed are shared out: exact but for the group at a cut.
    Rows before a group are summed within slices of the order, and over the slices' totals.
    """
    spark = groups.sparkSession
    names = list(ratios)
    share = [r / sum(ratios.values()) for r in ratios.values()]
    labels = {r["label"]: r["n"] for r in groups.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    deficit = [{k: n * s for k, n in labels.items()} for s in share]
    tie = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string")).cast("binary"), 256)
    counts = F.map_from_entries(F.collect_list(F.struct("label", "n")))
    per_group = groups.where("`group` IS NOT NULL").groupBy("group").agg(F.sum("n").alias("size"), counts.alias("counts"), F.max(F.struct("n", "label"))["label"].alias("most")).withColumn("tie", tie)
    placed = []
    for row in per_group.where("size > 1").orderBy(F.desc("size"), "tie").limit(largest).collect():
        gain = [sum(deficit[i][k] * n for k, n in row["counts"].items()) / max(share[i], 1e-12) for i in range(len(names))]
        best = max(range(len(names)), key=lambda i: (gain[i], -i))
        for k, n in row["counts"].items():
            deficit[best][k] -= n
        placed.append((row["group"], names[best]))
    kind = groups.schema["group"].dataType.simpleString()
    big = spark.createDataFrame(placed, f"`group` {kind}, new_split string")
    rest = per_group.join(F.broadcast(big.select("group")), "group", "left_anti").select("group", "size", "most", "tie", F.substring("tie", 1, 3).alias("slice"))
    of_label = Window.partitionBy("most")
    sums = rest.groupBy("most", "slice").agg(F.sum("size").alias("rows"))
    before = F.sum("rows").over(of_label.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("most", "slice", F.coalesce(before, F.lit(0)).alias("base"), F.sum("rows").over(of_label).alias("all"))
    inner = F.sum("size").over(Window.partitionBy("most", "slice").orderBy("tie").rowsBetween(Window.unboundedPreceding, 0))
    laid = rest.withColumn("inner", inner).join(F.broadcast(base), ["most", "slice"])
    place = (F.col("base") + F.col("inner") - F.col("size") / 2) / F.col("all")
    choice = F.lit(names[-1])
    for k in labels:
        room = [max(0.0, d[k]) for d in deficit]
        room = room if sum(room) else share
        pick = F.lit(names[-1])
        for i in reversed(range(len(names) - 1)):
            pick = F.when(place < sum(room[: i + 1]) / sum(room), names[i]).otherwise(pick)
        choice = F.when(F.col("most").eqNullSafe(F.lit(k)), pick).otherwise(choice)
    return big.union(laid.select("group", choice.alias("new_split")))


def _rank(load: Sequence, share: Sequence[int], step, b: int, k):
    """How many placements of a run come before split b's k-th (both from 0): those with a smaller load for their share, on ties those
    of earlier splits. Whole numbers, or arrays of them."""
    at, out = load[b] + k * step, k
    for other in range(len(share)):
        if other != b:
            ahead = at * share[other] - load[other] * share[b]
            unit = step * share[b]
            # Placements k' of the other split with load' + k' * step (times share[b]) below, or up to, at * share[other].
            before = ahead // unit + 1 if other < b else -((-ahead) // unit)
            out = out + (np.maximum(0, before) if isinstance(before, np.ndarray) else max(0, before))
    return out


def _taken(load: Sequence[int], share: Sequence[int], step: int, b: int, m: int) -> int:
    """How many of a run's first m placements are split b's."""
    low, high = 0, m
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if _rank(load, share, step, b, middle) < m else (low, middle)
    return low


def _choices(share: Sequence[int]):
    """The split of each row, from its place in its run and the loads that the run begins with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            load, step, j = np.array([list(map(int, x)) for x in part["load"]], object).reshape(len(part), len(share)), np.array(list(map(int, part["step"])), object), part["place"].to_numpy()
            if len(part) and int(load.max(initial=0) + step.max() * (int(j.max()) + 1)) * max(share) < 2**62:
                load, step = load.astype(np.int64), step.astype(np.int64)
            chosen = np.zeros(len(part), np.int32)
            for b in range(len(share)):
                low, high = np.zeros(len(part), np.int64), j.astype(np.int64) + 1
                while (low < high).any():  # the first k whose rank is j or more
                    middle = (low + high) // 2
                    less = (_rank(load.T, share, step, b, middle) < j) & (low < high)
                    low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
                chosen[_rank(load.T, share, step, b, low) == j] = b
            yield pd.DataFrame({"group": part["group"], "b": chosen})

    return run


#: Runs that the driver holds before it writes them.
RUNS = 50_000


def greedy_assignment(groups: DataFrame, ratios: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(group, new_split) by the greedy rule for every group, from (group, label, n).

    Groups go largest first, each to the split with the largest deficit in the labels that it has, for the split's ratio, first split on
    ties. That is the split with the smallest load for its ratio: rows that it has of each label, times the group's. Groups of a size
    with equal label counts stand together, as a run, by sha256 of the seed and those counts; within a run they are ordered by
    sha256 of the seed and the group. Within a run each placement adds the same to a split's load, so that how many go to each split, and
    which, has a closed form: the driver folds runs (a row for each distinct label count, streamed, RUNS at a time), never groups. All
    comparisons are of whole numbers; ratios are taken as the decimal fractions that they print as.

    Rows with a null group or label take no part, nor do counts under 1; a split of ratio 0 gets nothing. An empty table gives no rows.
    """
    spark = groups.sparkSession
    scratch = Scratch(spark, "greedy")
    names = [k for k, r in ratios.items() if r > 0]
    if not names:
        raise ValueError("no split has a ratio above 0")
    parts = [Fraction(str(ratios[k])) for k in names]
    share = [int(p * math.lcm(*(q.denominator for q in parts))) for p in parts]
    kind = groups.schema["group"].dataType.simpleString()
    each = groups.where("`group` IS NOT NULL AND label IS NOT NULL AND n > 0").groupBy("group", "label").agg(F.sum("n").cast("long").alias("n"))
    counts = each.groupBy("group").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("counts"))  # a row a label
    text = F.array_join(F.transform("counts", lambda c: F.concat(c["label"].cast("string"), F.lit(":"), c["n"].cast("string"))), ",")
    run = F.concat(F.lpad((F.lit(2**62) - F.col("size")).cast("string"), 19, "0"), F.lit(":"), F.sha2(F.concat(F.lit(f"{seed}:"), text), 256))
    grouped = scratch.table(counts.select("group", run.alias("run"), "counts"), "groups")
    runs = grouped.groupBy("run").agg(F.count("*").alias("m"), F.first("counts").alias("counts")).orderBy("run")

    schema, held, tables = "run string, load array<decimal(38,0)>, step decimal(38,0)", [], []
    current: list[Counter] = [Counter() for _ in names]

    def keep() -> None:
        tables.append(scratch.table(spark.createDataFrame(held, schema), "runs"))
        held.clear()

    for row in runs.toLocalIterator():
        own = {c["label"]: c["n"] for c in row["counts"]}
        load = [sum(now[k] * n for k, n in own.items()) for now in current]
        step = sum(n * n for n in own.values())
        held.append((row["run"], list(map(Decimal, load)), Decimal(step)))
        for b, now in enumerate(current):
            taken = _taken(load, share, step, b, row["m"])
            now.update({k: taken * n for k, n in own.items()})
        if len(held) >= RUNS:
            keep()
    keep()
    begun = reduce(DataFrame.union, tables)
    tie = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string")), 256)
    # Places within a run: numbers within slices of the hashes, after the counts of the slices before.
    sliced = scratch.table(grouped.select("group", "run", tie.alias("tie")).withColumn("slice", F.substring("tie", 1, 3)), "sliced")
    before = Window.partitionBy("run").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("run", "slice").agg(F.count("*").alias("n"))
    base = scratch.table(sizes.select("run", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    inner = F.row_number().over(Window.partitionBy("run", "slice").orderBy("tie", "group")) - 1
    placed = sliced.withColumn("inner", inner).join(base, ["run", "slice"]).select("group", "run", (F.col("base") + F.col("inner")).alias("place"))
    chosen = placed.join(begun, "run").select("group", "place", "load", "step").mapInPandas(_choices(share), f"`group` {kind}, b int")
    named = F.array(*map(F.lit, names))
    result = scratch.table(chosen.select("group", F.get(named, F.col("b")).alias("new_split")), "assigned")
    scratch.drop_all(but=result)
    return result


def regenerate(df: DataFrame, ratios: Mapping[str, float], group: str = "group", seed: int = 0) -> DataFrame:
    """df's labelled rows with new_split; groups stay together (G6, G7). Raises where nothing is labelled."""
    labelled = df.where("label IS NOT NULL")
    if labelled.isEmpty():
        raise ValueError("no labelled rows to split")
    counted = labelled.groupBy(F.col(group).alias("group"), "label").agg(F.count("*").alias("n"))
    chosen = greedy_assignment(counted, ratios, seed)
    return labelled.join(chosen, labelled[group] == chosen["group"]).select(*(labelled[c] for c in labelled.columns), "new_split")


def regeneration(df: DataFrame, ratios: Mapping[str, float], path: str | None = None, group: str = "group", seed: int = 0) -> DataFrame:
    """The plan of new splits of df's included, labelled rows; with a path it is also written there, never over an earlier one.

    Without a path it is a dry run: nothing is written. What is written is what the plan, computed once, says.
    """
    plan = regenerate(df.where("included") if "included" in df.columns else df, ratios, group, seed)
    if path is None:
        return plan
    write_splits(plan, path, {"seed": seed, "ratios": dict(ratios), "group": group})
    return plan


def achieved(df: DataFrame, group: str = "group") -> DataFrame:
    """Rows, groups and share of each new split."""
    counted = df.groupBy("new_split").agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))
    return counted.crossJoin(counted.agg(F.sum("rows").alias("all"))).select("new_split", "rows", "groups", (F.col("rows") / F.col("all")).alias("share"))
