"""Nested values as rows: every node of a JSON document at any depth, its leaves by dotted path, guards on names and on settings.

Documents are held as VARIANT and unfolded a level at a time, so that no depth and no set of names has to be known. Several levels
are one projection of one job, and only documents that go deeper take part in the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Scratch


#: Levels that are unfolded in one job.
LEVELS = 8


def _node(path: Column, name: Column, text: Column, leaf: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), name.alias("name"), text.alias("text"), leaf.alias("leaf"), v.alias("v"))


def _unfolded(level: DataFrame) -> DataFrame:
    """Rows whose v is open become a leaf, or their children, the first of which carries the node above; others stay, one row each."""
    opened = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
    stays, path, name = F.col("pos").isNull(), F.col("path"), F.col("name")
    found = {
        "path": F.when(stays, path).otherwise(F.concat(path, step)),
        "name": F.when(stays, name).otherwise(F.col("key")),
        "text": F.when(stays & F.col("v").isNotNull(), F.try_variant_get("v", "$", "string")).otherwise(F.col("text")),
        "v": F.col("value"),
    }
    if "above" in level.columns:
        inner = F.array(_node(path, name, F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("variant")))
        first = F.when(path == "$", F.col("above")).otherwise(F.concat("above", inner))
        found["above"] = F.when(stays, F.col("above")).when(F.col("pos") == 0, first).otherwise(F.slice("above", 1, 0))
    return opened.select("k", *(found[c].alias(c) for c in level.columns if c != "k"))


def _found(df: DataFrame, key: str, document: str, inner: bool) -> DataFrame:
    """nodes(), or their leaves alone, without names."""
    spark = df.sparkSession
    scratch = Scratch(spark, "nested")
    none = F.lit(None).cast("string")
    # exploded, as the optimizer would move a filter below a plain column and parse each document twice
    parsed = F.explode(F.array(F.try_parse_json(F.col(document))))
    level = df.select(F.col(key).alias("k"), F.lit("$").alias("path"), none.alias("text"), parsed.alias("v")).where("v IS NOT NULL")
    if inner:
        nothing = F.slice(F.array(_node(none, none, none, F.lit(False), F.lit(None).cast("variant"))), 1, 0)
        level = level.select("*", none.alias("name"), nothing.alias("above"))
    columns = ["path", "name", "value", "leaf"] if inner else ["path", "value"]
    rounds: list[DataFrame] = []
    while True:
        ahead = level
        for _ in range(LEVELS):
            ahead = _unfolded(ahead)
        if inner:
            own = _node(F.col("path"), F.col("name"), F.col("text"), F.col("v").isNull(), F.col("v"))
            ahead = ahead.select("k", F.inline(F.concat("above", F.array(own))))
        rounds.append(scratch.table(ahead.withColumn("open", F.col("v").isNotNull()).withColumnRenamed("text", "value"), f"levels-{len(rounds)}"))
        rest = rounds[-1].where("open")
        if rest.isEmpty():
            break
        level = rest.select(*(F.col("value").alias("text") if c == "text" else nothing.alias("above") if c == "above" else F.col(c) for c in level.columns))
    done = [t.where("NOT open").select(F.col("k").alias(key), *columns) for t in rounds]
    if len(rounds) == 1:
        done[0]._scratch_path = rounds[0]._scratch_path
        return done[0]
    result = scratch.table(reduce(DataFrame.union, done), "nodes")
    scratch.drop_all(but=result)
    return result


def nodes(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, name, value, leaf) of all nodes under each document's root.

    path is `$` with `.name` or `[place]` for each step; name is the step's name, null for places. value is a leaf's text as JSON holds
    it, without quotes, and null for a null leaf and for objects and arrays that hold something; empty ones are leaves, `{}` and `[]`. A
    document that is a plain value is one node, `$`; one that is null or can't be parsed has none. Repeated rows and keys are like others.
    The result is a written table, which belongs to the caller.
    """
    return _found(df, key, document, inner=True)


def flattened(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of every leaf (F7), as nodes() has them; a written table, which belongs to the caller."""
    return _found(df, key, document, inner=False)


def forbidden_names(df: DataFrame, key: str, document: str, names: Iterable[str]) -> DataFrame:
    """(key, path) wherever one of the names stands, at any depth, whatever its case (X11)."""
    banned = sorted({n.lower() for n in names})
    return nodes(df, key, document).where(F.lower("name").isin(banned)).select(key, "path")


def assert_none_forbidden(df: DataFrame, key: str, document: str, names: Iterable[str]) -> None:
    """ValueError with the first few offending paths."""
    found = forbidden_names(df, key, document, names).groupBy("path").agg(F.count("*").alias("n")).orderBy("path").limit(10).collect()
    if found:
        raise ValueError("forbidden names: " + ", ".join(f"{r['path']} ({r['n']})" for r in found))


def changed_settings(df: DataFrame, key: str, document: str, fixed: Mapping[str, str]) -> DataFrame:
    """(key, path, value) wherever a document sets one of the fixed paths to something else than its text.

    A path that a document doesn't set keeps what is fixed and is no row. A null, an object or an array in its place is a
    change; its value is null, or `{}` or `[]` where it holds nothing.
    """
    allowed = df.sparkSession.createDataFrame(list(fixed.items()), "path string, allowed string")
    found = nodes(df, key, document).join(F.broadcast(allowed), "path")  # as many rows as the caller fixes
    return found.where(~F.col("value").eqNullSafe(F.col("allowed"))).select(key, "path", "value")
