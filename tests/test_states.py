"""Malformed rows, nested documents, and what is kept between runs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators import nested, profile
from quillspark.sources import records, states

# ---- percentiles and moments ----


def test_percentiles_of_values_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, nan, None, 5.0, 1.7e308), (2.0, nan, None, inf, -1.7e308), (nan, nan, None, -inf, 0.0)], "a double, b double, c double, d double, e double")
    got = profile.percentiles(df, {c: [0.0, 0.25, 0.5, 1.0] for c in "abcde"})
    assert got["a"] == [1.0, 1.25, 1.5, 2.0] and got["b"] == got["c"] == [None] * 4 and got["d"] == [5.0] * 4
    assert got["e"][0] == -1.7e308 and got["e"][2] == 0.0 and got["e"][3] == 1.7e308
    rows = {r["metric"]: r for r in profile.describe(df, ["a", "b", "d"]).collect()}
    assert set(rows) == {"a", "d"} and rows["a"]["n"] == 2 and rows["a"]["mean"] == 1.5 and rows["d"]["std"] == 0.0


def test_moments_of_large_means(spark):
    r = np.random.default_rng(1)
    parts = [r.normal(0, 0.05, 1000) + 1e9 + 0.1, r.normal(0, 0.05, 1000) + 1e9 + 0.3, np.array([1e9 + 5.0])]
    rows = [(0, len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())) for x in parts] + [(1, 0, None, None), (1, 1, 2.0, 0.0)]
    got = {x["channel"]: x for x in profile.merge_moments(spark.createDataFrame(rows, "channel int, n long, mean double, m2 double")).collect()}
    assert math.isclose(got[0]["std"], np.concatenate(parts).std(), rel_tol=1e-6) and got[0]["n"] == 2001
    assert got[1]["n"] == 1 and got[1]["std"] == 0.0
    two = spark.createDataFrame([(0, 1000, 1e9 + 0.1, 0.0), (0, 1000, 1e9 + 0.3, 0.0)], "channel int, n long, mean double, m2 double")
    assert math.isclose(profile.merge_moments(two).first()["std"], 0.1, rel_tol=1e-6)


def moments(df):
    return {r["channel"]: (r["n"], round(r["mean"], 9), round(r["std"], 9)) for r in df.collect()}


def test_moments_by_file(spark, tmp_path):
    folder, state = f"file://{tmp_path}/data", f"file://{tmp_path}/state"
    make = lambda low, high: spark.range(low, high).select(F.array(F.col("id").cast("double"), F.sin("id"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") * 0.5)).alias("x"))
    make(0, 50).coalesce(2).write.parquet(folder)
    first, read = states.updated_moments(spark, folder, "x", state)
    assert len(read) == 2 and moments(first) == moments(profile.merge_moments(profile.moment_states(make(0, 50), "x")))
    again, read = states.updated_moments(spark, folder, "x", state)
    assert read == [] and moments(again) == moments(first)
    make(50, 80).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([], "x array<double>").coalesce(1).write.mode("append").parquet(folder)
    more, read = states.updated_moments(spark, folder, "x", state)
    assert 1 <= len(read) <= 2 and moments(more) == moments(profile.merge_moments(profile.moment_states(make(0, 80), "x")))
    assert states.updated_moments(spark, folder, "x", state)[1] == []
    gone = next(p for p in (tmp_path / "data").glob("part-*.parquet") if spark.read.parquet(f"file://{p}").where("x[0] = 60").count())
    gone.unlink()
    fewer, read = states.updated_moments(spark, folder, "x", state)
    assert read == [] and moments(fewer) == moments(first)


# ---- processed rows ----


def manifest(spark, rows):
    return spark.createDataFrame(rows, "path string, size_bytes long, modified_ms long, note string")


def test_processed_rows(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    seen = spark.sparkContext.accumulator(0)

    def process(df):
        def note(rows):
            for r in rows:
                seen.add(1)
                yield (*r, r["size_bytes"] * 2)
        return df.sparkSession.createDataFrame(df.rdd.mapPartitions(note), "path string, size_bytes long, modified_ms long, note string, made long") if df.schema and df.limit(1).count() else df.withColumn("made", F.col("size_bytes") * 2)

    rows = [(f"p{i}", i, 1, "n") for i in range(40)]
    out = lambda x: {r["path"]: (r["made"], r["reused"]) for r in x.collect()}
    first = out(states.processed(manifest(spark, rows), {"size": 512}, process, cache, 8))
    assert first == {f"p{i}": (2 * i, False) for i in range(40)} and seen.value >= 40
    before = seen.value
    changed = [(p, s + (100 if p == "p3" else 0), m + (p == "p4"), n) for p, s, m, n in rows if p != "p5"] + [("new", 7, 1, "n")]
    second = out(states.processed(manifest(spark, changed), {"size": 512}, process, cache, 8))
    assert second == {p: (2 * s, p not in ("p3", "p4", "new")) for p, s, _, _ in changed} and seen.value - before <= 6
    third = out(states.processed(manifest(spark, changed), {"size": 512}, process, cache, 8))
    assert all(reused for _, reused in third.values()) and "p5" not in third and len(third) == 40
    other = out(states.processed(manifest(spark, changed), {"size": 256}, process, cache, 8))
    assert not any(reused for _, reused in other.values())
    assert all(reused for _, reused in out(states.processed(manifest(spark, changed), {"size": 512}, process, cache, 8)).values())
    assert states.processed(manifest(spark, []), {"size": 512}, process, cache, 8).count() == 0
    assert not any(reused for _, reused in out(states.processed(manifest(spark, rows[:3]), {"size": 512}, process, cache, 8)).values())


# ---- malformed rows ----


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,score,name\n1,0.5,x\n2,bad,y\n3,1.5\n\n4,2.5,"a, b"\n5,,\n6,1,z,extra\n')
    (tmp_path / "b.csv").write_text("name,of,columns\n7,7.5,w\nseven,1.0,v\n")
    rows, bad = records.checked_rows(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"], StructType.fromDDL("id int, score double, name string"), f"file://{tmp_path}/out", header=True)
    assert sorted(map(tuple, rows.collect())) == [(1, 0.5, "x"), (4, 2.5, "a, b"), (5, None, None), (7, 7.5, "w")]
    got = {r["text"]: (r["reason"], r["file"].rsplit("/", 1)[1]) for r in bad.collect()}
    assert got == {"2,bad,y": (records.TYPES, "a.csv"), "3,1.5": (records.FIELDS, "a.csv"), "6,1,z,extra": (records.FIELDS, "a.csv"), "seven,1.0,v": (records.TYPES, "b.csv")}


# ---- nested documents ----


def plain_nodes(v, path="$", name=None):
    if isinstance(v, (dict, list)) and v:
        if path != "$":
            yield path, name, None, False
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from plain_nodes(x, path + (f".{k}" if isinstance(v, dict) else f"[{k}]"), k if isinstance(v, dict) else None)
    else:
        yield path, name, (json.dumps(v) if isinstance(v, (dict, list)) else None if v is None else str(v).lower() if isinstance(v, bool) else str(v)), True


DOCS = ['{"a":{"B":[1,{"c":true},[]],"d":{}},"e":null}', "[1,[2,[3,[4]]]]", '"x"', "5", "{}", "null", '{"k":{"K":{"k":1}}}']


def test_nodes_at_any_depth(spark):
    deep = '{"x":' * 40 + "1" + "}" * 40
    rows = [(i, d) for i, d in enumerate([*DOCS, deep])] + [(90, None), (91, "{broken"), (0, DOCS[0])]
    df = spark.createDataFrame(rows, "id long, doc string")
    got = sorted(map(tuple, nested.nodes(df, "id", "doc").collect()), key=repr)
    want = sorted(((i, *n) for i, d in rows if d and d != "{broken" for n in plain_nodes(json.loads(d))), key=repr)
    assert got == want
    assert nested.nodes(df.limit(0), "id", "doc").count() == 0


def test_levels_are_unfolded_together(spark, monkeypatch):
    """A table of whole documents for each level was most of the time."""
    written, table = [], nested.Scratch.table
    monkeypatch.setattr(nested.Scratch, "table", lambda self, df, name: written.append(name) or table(self, df, name))
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, doc string")
    got = sorted(map(tuple, nested.nodes(df, "id", "doc").collect()), key=repr)
    assert got == sorted(((i, *n) for i, d in enumerate(DOCS) for n in plain_nodes(json.loads(d))), key=repr)
    assert len(written) == 1


def test_leaves_write_no_inner_nodes(spark, monkeypatch):
    """Inner nodes were written with the leaves, each level had a second generator to make them, and documents were parsed twice."""
    written, table = [], nested.Scratch.table

    def noted(self, df, name):
        out = table(self, df, name)
        written.append((out.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(nested.Scratch, "table", noted)
    deep = '{"x":' * 20 + "[1,{}]" + "}" * 20
    for more, tables in ([DOCS[0], '{"a":[{},{"$":"$"}]}', "{broken", None], 1), ([deep, f"[{deep},2,{deep}]"], 4):
        written.clear()
        rows = [(i % 9, d) for i, d in enumerate([*DOCS, *more])]
        got = sorted(map(tuple, nested.flattened(spark.createDataFrame(rows, "id long, doc string"), "id", "doc").collect()), key=repr)
        want = [(i, *n) for i, d in rows if d and d != "{broken" for n in plain_nodes(json.loads(d))]
        assert got == sorted(((i, path, value) for i, path, _, value, leaf in want if leaf), key=repr)
        assert len(written) == tables and written[-1][0] == len(got)
        plan = written[0][1]
        assert plan.count("variant_explode") == nested.LEVELS and "inline" not in plan and plan.lower().count("parsejson") == 1


def test_guard(spark):
    df = spark.createDataFrame([(1, '{"steps":[{"name":1,"CoarseDropout":{"p":1}}]}'), (2, '{"fine":1}')], "id long, doc string")
    assert [tuple(r) for r in nested.forbidden_names(df, "id", "doc", ["coarsedropout"]).collect()] == [(1, "$.steps[0].CoarseDropout")]
    with pytest.raises(ValueError, match=r"CoarseDropout \(1\)"):
        nested.assert_none_forbidden(df, "id", "doc", ["COARSEDROPOUT"])
    nested.assert_none_forbidden(df, "id", "doc", ["mixup"])
