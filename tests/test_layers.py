"""Layers, fitted heads, affine scans and optimiser steps against numpy and plain loops."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import pixels
from quillspark.functions import vectors as V
from quillspark.operators import linear_maps, nested, recurrences

RNG = np.random.default_rng(7)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x] if x is not None else None) for i, x in enumerate(rows)], "id long, x array<double>")


def column(df, expr):
    return [r["v"] for r in df.select("id", expr.alias("v")).orderBy("id").collect()]


def test_pooled_and_products(spark):
    x, w = RNG.standard_normal((5, 12)), RNG.standard_normal((3, 4))
    df = frame(spark, [*x, None])
    got = column(df, V.matvec(w.tolist(), V.pooled(F.col("x"), 4), [1.0, 2.0, 3.0]))
    assert np.allclose(got[:5], x.reshape(5, 4, 3).mean(axis=2) @ w.T + [1, 2, 3]) and got[5] is None


@pytest.mark.parametrize("block", [1, 5, 16, 64])
def test_linear_in_blocks(spark, block):
    x, w, b = RNG.standard_normal((6, 37)), RNG.standard_normal((4, 37)), RNG.standard_normal(4)
    df = frame(spark, [*x, None, []])
    got = linear_maps.linear(df, "id", "x", linear_maps.weight_blocks(spark, w.tolist(), b.tolist(), block), block).collect()
    assert len(got) == 24
    want = x @ w.T + b
    assert all(abs(r["value"] - want[r["id"], r["unit"]]) < 1e-9 for r in got)


def test_linear_with_odd_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, None, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])], "id long, x array<double>")
    got = {r["id"]: r["value"] for r in linear_maps.linear(df, "id", "x", linear_maps.weight_blocks(spark, [[1.0, 10.0, 100.0]], block=2), 2).collect()}
    assert got == {0: 21.0, 1: None, 2: 321.0}


def test_fitted_heads(spark):
    x, y = RNG.standard_normal((200, 6)), RNG.integers(0, 4, 200)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(200)] + [(200, None, 1), (201, [1.0] * 6, None), (202, [1.0] * 6, 9), (203, [float("nan")] * 6, 1), (204, [1.0], 2)]
    weights, bias = linear_maps.fitted_heads(spark.createDataFrame(rows, "id long, x array<double>, label int"), "x", "label", 6, 4)
    a = np.column_stack([x, np.ones(200)])
    t = np.column_stack([(y[:, None] == np.arange(4)), (y[:, None] > np.arange(3))]).astype(float)
    want = np.linalg.solve(a.T @ a + 1e-3 * np.eye(7), a.T @ t)
    assert np.allclose(weights.T, want[:6]) and np.allclose(bias, want[6])
    empty = linear_maps.fitted_heads(spark.createDataFrame([], "id long, x array<double>, label int"), "x", "label", 6, 4)
    assert not np.any(empty[0])


def test_dilated_edges(spark):
    df = frame(spark, [[1, 2, 3, 4], [5], []])
    assert column(df, V.dilated(F.col("x"), [1.0, 10.0, 100.0], 1)) == [[210, 321, 432, 43], [50], []]
    assert column(df, V.dilated(F.col("x"), [1.0, 10.0, 100.0], 2)) == [[310, 420, 31, 42], [50], []]
    assert column(df, V.dilated(F.col("x"), [1.0, 10.0, 100.0], 9)) == [[10, 20, 30, 40], [50], []]


def test_branch_attention(spark):
    x, k, inner, outer = RNG.standard_normal((4, 20)), RNG.standard_normal((3, 3)), RNG.standard_normal((2, 3)), RNG.standard_normal((3, 2))
    got = column(frame(spark, [*x, []]), V.branch_attention(F.col("x"), k.tolist(), (1, 2, 4), inner.tolist(), outer.tolist()))
    for row, out in zip(x, got):
        wide = np.pad(row, 8)
        b = np.maximum(0, [[sum(k[n, j] * wide[8 + i + (j - 1) * d] for j in range(3)) for i in range(20)] for n, d in enumerate((1, 2, 4))])
        z = outer @ np.maximum(0, inner @ b.mean(axis=1))
        w = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(out, w @ b)
    assert got[4] == []


def test_text_embeddings(spark):
    texts = [None, "", "a", "b" * 100_000, *(f"text {i}" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = np.array(column(df, V.text_embedding(F.col("t"), 24)))
    assert np.allclose((got**2).sum(axis=1), 1) and (got[0] == got[1]).all() and not np.allclose(got[1], got[2])
    assert not np.allclose(got, np.array(column(df, V.text_embedding(F.col("t"), 24, seed=1))))
    z = np.array(column(df, V.normals(F.col("t"), 25))[4:])
    assert z.shape == (400, 25) and abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.05 and abs(np.corrcoef(z.T) - np.eye(25)).max() < 0.25
    repeat = column(df.repartition(3), V.text_embedding(F.col("t"), 24))
    assert (np.array(repeat) == got).all()


def test_gate_and_mean_vectors(spark):
    v, own, prior = RNG.standard_normal((6, 4)), RNG.standard_normal((4, 4)), RNG.standard_normal((4, 4))
    df = frame(spark, v).withColumn("g", F.col("id") % 2)
    means = V.mean_vectors(df.union(frame(spark, [None]).withColumn("g", F.lit(0))), ["g"], "x", 4)
    got = column(df.join(means, "g"), V.gated(F.col("x"), F.col("mean"), own.tolist(), prior.tolist()))
    m = [v[0::2].mean(axis=0), v[1::2].mean(axis=0)]
    assert np.allclose(got, [x / (1 + np.exp(-(own @ x + prior @ m[i % 2]))) for i, x in enumerate(v)])


# ---- recurrences ----


@pytest.mark.parametrize("size", [1, 3, 7, 4096])
def test_affine_scan(spark, size):
    series = {s: [(t, float(RNG.uniform(-1.1, 1.1)), float(RNG.standard_normal())) for t in range(n)] for s, n in (("a", 25), ("b", 1), ("c", 14))}
    series["gaps"] = [(t, 0.5, 1.0) for t in (0, 5, 6, 40)]
    df = spark.createDataFrame([(s, t, a, b) for s, rows in series.items() for t, a, b in rows], "s string, t long, a double, b double").repartition(3)
    got = {(r["s"], r["t"]): r["x"] for r in recurrences.affine_scan(df, "s", "t", "a", "b", "x", 0.25, size).collect()}
    for s, rows in series.items():
        x = 0.25
        for t, a, b in rows:
            x = a * x + b
            assert math.isclose(got[s, t], x, rel_tol=1e-9, abs_tol=1e-12)
    assert len(got) == sum(map(len, series.values()))
    assert recurrences.affine_scan(df.limit(0), "s", "t", "a", "b", "x").count() == 0


def test_training_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(recurrences, "SLICE", 5)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(s, t0 + datetime.timedelta(minutes=17 * (i // 2)), i, float(RNG.normal(0, 2))) for s, n in (("a", 90), ("b", 37)) for i in range(n)] + [("a", t0, 999, None)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, id long, g double").repartition(4)
    got = {(r["s"], r["step"]): r for r in recurrences.trained(df, "s", ["ts", "id"], "g", every=4, most=1.5, base=0.2, period=6).collect()}
    grads = {s: [np.mean(c) for c in (lambda g: [g[i : i + 4] for i in range(0, len(g), 4)])([g for k, _, _, g in rows if k == s and g is not None])] for s in "ab"}
    state = {s: (0.0, 0.0, 0.0) for s in "ab"}
    for step in range(max(map(len, grads.values()))):
        now = {s: g[step] for s, g in grads.items() if step < len(g)}
        scale = min(1.0, 1.5 / (math.sqrt(sum(g * g for g in now.values())) + 1e-6))
        rate = 0.2 * 0.5 * (1 + math.cos(math.pi * (step % 6) / 6))
        for s, g in now.items():
            m, v, x = state[s]
            g *= scale
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x * (1 - rate * 0.01) - rate * (m / (1 - 0.9 ** (step + 1))) / (math.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
            state[s] = m, v, x
            r = got[s, step]
            assert all(math.isclose(p, q, rel_tol=1e-7, abs_tol=1e-10) for p, q in ((r["gradient"], g), (r["m"], m), (r["v"], v), (r["value"], x)))
    assert len(got) == sum(map(len, grads.values()))


def test_changed_settings(spark):
    """Absent paths hold; nulls, objects and other values are changes; documents that can't be parsed have none."""
    docs = [(1, '{"a":{"only":true},"b":1}'), (2, '{"a":{"only":false}}'), (3, '{"a":{"only":null}}'), (4, '{"a":{"only":{"x":1}}}'), (5, '{"b":2}'), (6, "{"), (7, None), (2, '{"a":{"only":false}}')]
    df = spark.createDataFrame(docs, "id long, doc string")
    got = nested.changed_settings(df, "id", "doc", {"$.a.only": "true"}).collect()
    assert sorted((r["id"], r["path"], r["value"]) for r in got if r["value"]) == [(2, "$.a.only", "false")] * 2
    assert sorted(r["id"] for r in got if r["value"] is None) == [3, 4]


def test_input_problems(spark):
    cases = [
        ((2, 2, 3, 16, bytes(12)), None), ((2, 6, 1, 0, bytes(12)), None), (None, "no image"), ((-1, -1, -1, -1, b""), "no image"), ((2, 2, 3, None, bytes(12)), "no image"),
        ((2, 2, 4, 24, bytes(16)), "channels"), ((2, 2, None, 16, bytes(12)), "channels"), ((2, 2, 3, 21, bytes(12)), "depth"), ((0, 2, 3, 16, b""), "empty"), ((2, None, 3, 16, b""), "empty"),
        ((2, 2, 3, 16, bytes(11)), "bytes"), ((2, 2, 3, 16, None), "bytes"), ((1 << 20, 1 << 20, 3, 16, bytes(1)), "bytes"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = df.select("id", pixels.input_problem(F.col("image")).alias("p")).orderBy("id").collect()
    assert [r["p"] for r in got] == [p for _, p in cases]
