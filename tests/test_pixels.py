"""Measurements as expressions against the numpy kernels, which compute them another way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.functions import pixels as P
from quillspark.plans import media_queries  # noqa: F401  registers the queries
from quillspark.plans.queries import QUERIES


def images():
    rng = np.random.Generator(np.random.PCG64(4))
    yield 32, np.frombuffer(b"plain words of a text " * 40, np.uint8)[: 32 * 3 * 9].reshape(9, 32, 3)
    for h, w in ((1, 12), (2, 9), (40, 33), (64, 3), (7, 7)):
        yield w, rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
    yield 8, np.zeros((8, 8, 3), np.uint8)


@pytest.mark.parametrize("band", (P.BAND, 200))
@pytest.mark.parametrize("k", range(7))
def test_expressions_match_the_kernels(spark, monkeypatch, k, band):
    monkeypatch.setattr(P, "BAND", band)
    width, x = list(images())[k]
    g = K.gray(x)
    df = spark.createDataFrame([(bytearray(x.tobytes()),)], "content binary")

    def values(image):
        return F.struct(P.brightness(image).alias("levels"), P.laplacian_variance(image).alias("lap"), P.noise_sigma(image).alias("noise"), P.dhash(image).alias("dhash"), P.phash(image).alias("phash"), P.sharpness(image, 16).alias("sharp"), P.upload_quality(image).alias("up"), P.dark_share(image, 100).alias("dark"))

    v = df.select(P.measured(F.col("content"), width, values).alias("v")).first()["v"]
    assert (v["levels"]["mean"], v["levels"]["variance"], v["lap"], v["noise"], v["dark"]) == pytest.approx((g.mean(), g.var(), K.laplacian_variance(x), K.noise_sigma(x), (g <= 100).mean()), abs=1e-6)
    assert v["sharp"] == pytest.approx(K.sharpness(x, 16), rel=1e-6, abs=1e-6)
    assert v["up"].asDict() == pytest.approx(K.upload_quality(x), abs=1e-6)
    small = K.resize(g, 8, 9)
    assert v["dhash"] == K.hex_bits(small[:, 1:] - small[:, :-1] > P.EVEN)
    i = np.arange(32)
    dct = np.sqrt(2 / 32) * np.cos(np.pi * (2 * i[None] + 1) * i[:, None] / 64)
    dct[0] /= np.sqrt(2)
    low = (dct @ K.resize(g, 32, 32) @ dct.T)[:8, :8]
    if x.any():  # of a black image all coefficients are even
        assert v["phash"] == K.hex_bits(low - np.median(low.ravel()[1:]) > P.EVEN)
    h, w = spark.range(1).select(*P.proxy_size(F.lit(x.shape[0]), F.lit(width), 16)).first()
    assert (h, w) == K.proxy(x, 16).shape[:2]


def test_empty_content(spark):
    df = spark.createDataFrame([(bytearray(b""),), (None,)], "content binary")
    got = [r["v"] for r in df.select(P.measured(F.coalesce("content", F.lit(b"")), 4, lambda image: F.struct(P.brightness(image)["mean"].alias("m"), image.height.alias("h"))).alias("v")).collect()]
    assert [(v["m"], v["h"]) for v in got] == [(0.0, 1)] * 2


def test_hash_looks_up_no_place_of_the_waves(spark):
    """Index arithmetic in the innermost loop was most of the time of a hash."""
    df = spark.createDataFrame([(bytearray(96 * 20),)], "content binary")
    plan = df.select(P.measured(F.col("content"), 32, P.phash).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "% 32" not in plan


def test_a_row_of_the_wanted_width_stays(spark):
    df = spark.createDataFrame([(bytearray(range(96)) * 40,)], "content binary")
    v = df.select(P.measured(F.col("content"), 32, lambda x: P.resized(x, 8, 32)).alias("v")).first()["v"]
    assert v == pytest.approx(K.resize(K.gray(np.frombuffer(bytes(range(96)) * 40, np.uint8).reshape(40, 32, 3)), 8, 32).ravel())


@pytest.mark.parametrize("band", (P.BAND, 200))
@pytest.mark.parametrize("k", range(7))
def test_pixels_as_rows_match_the_kernels(spark, monkeypatch, k, band):
    """M6 and M11 as aggregates: whole bands and many, last rows that aren't full, rows with the same key."""
    monkeypatch.setattr(P, "BAND", band)
    width, x = list(images())[k]
    short = x.copy().reshape(-1)
    short[-2:] = 0
    y = short.reshape(x.shape)
    df = spark.createDataFrame([(1, bytearray(x.tobytes())), (1, bytearray(short.tobytes()[:-2])), (None, bytearray(b""))], "id long, content binary")
    want = [(1, x), (1, y), (None, np.zeros((1, width, 3), np.uint8))]
    order = lambda rows: sorted(([-1 if v is None else float(v) for v in r] for r in rows))
    found = order(P.pixel_noise(df, "content", width).collect())
    assert np.array(found) == pytest.approx(np.array(order((i, K.noise_sigma(v)) for i, v in want)), abs=1e-6)
    found = order(P.pixel_quality(df, "content", width).select("id", "visible_fraction", "brightness", "sharpness", "color_score").collect())
    assert np.array(found) == pytest.approx(np.array(order((i, *K.upload_quality(v).values()) for i, v in want)), abs=1e-6)


@pytest.mark.parametrize("name", ("M11", "M6"))
def test_pixels_are_measured_by_compiled_code(spark, data, name):
    """Only the making of numbers from bytes is left to interpreted lambdas, one a byte: the rest took most of the time."""
    plan = QUERIES[name](spark, data())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.count("lambdafunction") == 1


@pytest.mark.parametrize("band", (P.BAND, 200))
def test_resized_rows_share_the_columns_weights(spark, monkeypatch, band):
    """Shares were worked out for each cell of each row, and rows between two cells were read twice."""
    monkeypatch.setattr(P, "BAND", band)
    x = np.random.Generator(np.random.PCG64(5)).integers(0, 256, (19, 12, 3)).astype(np.uint8)
    df = spark.createDataFrame([(bytearray(x.tobytes()),)], "content binary")
    sizes = ((16, 5), (16, 16), (40, 7), (40, 12), (1, 1))
    made = df.select(P.measured(F.col("content"), 12, lambda i: F.array(*(P.resized(i, *s) for s in sizes))).alias("v"))
    for (h, w), v in zip(sizes, made.first()["v"]):
        assert v == pytest.approx(K.resize(K.gray(x), h, w).ravel())
    assert "slice(" in made._jdf.queryExecution().optimizedPlan().toString()
