"""Rows-only and written-and-read-back queries: media kernels over text bytes as pixels, sinks, streams, functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import kernels, pixels
from quillspark.operators import epochs, rules
from quillspark.plans.queries import CLEAN, LOGS, ORDINAL, cleaned, query, r
from quillspark.plans.tables import M, manifest, read, scores
from quillspark.scratch import Scratch
from quillspark.sources import manifests, sinks
from quillspark.streaming import manifests as streams

SIDE = 32


def as_image(raw: bytes) -> np.ndarray:
    """A text's bytes as rows of SIDE pixels of three bytes, the last row filled up with zeros."""
    row = SIDE * 3
    n = max(1, -(-len(raw) // row))
    return np.frombuffer(raw.ljust(n * row, b"\0"), np.uint8).reshape(n, SIDE, 3)


def _measured(spark: SparkSession, d: str, run, schema: str) -> DataFrame:
    """run(image) -> values, for each document's bytes, in Arrow batches."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *run(as_image(bytes(c)))) for i, c in zip(pdf["doc_id"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    return docs.mapInPandas(each, f"doc_id long, {schema}")


def measured(spark: SparkSession, d: str, values) -> DataFrame:
    """A struct of values of each document's bytes as an image SIDE pixels wide, by expressions alone."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, d, "documents").select("doc_id", pixels.measured(content, SIDE, values).alias("v"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and content, each document's bytes as an image."""
    return read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


#: The same images in SQL: a row for each pixel, and gray levels resized by area along both axes (or linearly, where they grow).
PX = f"""im AS (SELECT doc_id, hex(coalesce(text, '')) AS hx, greatest(1, ceil(strlen(coalesce(text, '')) / {SIDE * 3}.0))::INT AS h FROM documents),
li AS (SELECT doc_id, h, regexp_extract_all(rpad(hx, h * {SIDE * 6}, '0'), '..') AS bs FROM im),
oc AS (SELECT doc_id, h, unnest(bs) AS hb, unnest(range(h * {SIDE * 3})) AS k FROM li),
px AS (SELECT doc_id, h, k // 3 AS i, max(('0x' || hb)::INT) FILTER (WHERE k % 3 = 0) AS r, max(('0x' || hb)::INT) FILTER (WHERE k % 3 = 1) AS gr, max(('0x' || hb)::INT) FILTER (WHERE k % 3 = 2) AS b FROM oc GROUP BY ALL),
g AS MATERIALIZED (SELECT doc_id, h, (i // {SIDE})::INT AS y, (i % {SIDE})::INT AS x, r, gr, b, r * 0.299::DOUBLE + gr * 0.587::DOUBLE + b * 0.114::DOUBLE AS v FROM px)"""
LAP = """nb AS (SELECT *, lag(v) OVER (PARTITION BY doc_id, x ORDER BY y) AS u, lead(v) OVER (PARTITION BY doc_id, x ORDER BY y) AS o,
  lag(v) OVER (PARTITION BY doc_id, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY doc_id, y ORDER BY x) AS e FROM g),
lap AS (SELECT doc_id, v AS own, r, gr, b, coalesce(u, o, v) + coalesce(o, u, v) + coalesce(l, CASE WHEN h = 1 THEN v ELSE e END) + coalesce(e, CASE WHEN h = 1 THEN v ELSE l END) - 4 * v AS v FROM nb)"""


def _resized(rows: int, columns: int) -> str:
    """sm(doc_id, t, u, v): the cells of the smaller image."""
    def shares(name: str, have: str, want: int, source: str) -> str:
        return f"""{name} AS (SELECT {have} AS have, t, c, CASE WHEN {have} >= {want} THEN greatest(0, least((t + 1) * {have} / {want}.0::DOUBLE, c + 1) - greatest(t * {have} / {want}.0::DOUBLE, c)) / ({have} / {want}.0::DOUBLE)
  ELSE (CASE WHEN c = floor(a) THEN 1 - a + floor(a) ELSE 0 END) + (CASE WHEN c = least(floor(a) + 1, {have} - 1) THEN a - floor(a) ELSE 0 END) END AS w
  FROM (SELECT *, greatest(0, least((t + 0.5::DOUBLE) * {have} / {want} - 0.5::DOUBLE, {have} - 1)) AS a FROM (SELECT {have}, unnest(range({have})) AS c FROM {source}) s, range({want}) t(t)))"""

    return f"""hs AS (SELECT DISTINCT h FROM im), {shares("wy", "h", rows, "hs")}, ws AS (SELECT {SIDE} AS w0), {shares("wx", "w0", columns, "ws")},
tall AS (SELECT doc_id, t, x, sum(v * w) AS v FROM g JOIN wy ON have = h AND c = y WHERE w > 0 GROUP BY ALL),
sm AS (SELECT doc_id, tall.t, wx.t AS u, sum(v * w) AS v FROM tall JOIN wx ON c = x WHERE w > 0 GROUP BY ALL)"""


def _hex(bits: str) -> str:
    """16 hexadecimal digits of 64 bits (doc_id, k, bit), most significant first."""
    digit = "substr('0123456789abcdef', 1 + sum(bit::INT << (3 - k % 4))::INT, 1)"
    return f"SELECT doc_id, string_agg(d, '' ORDER BY q) AS code FROM (SELECT doc_id, k // 4 AS q, {digit} AS d FROM ({bits}) GROUP BY ALL) GROUP BY doc_id"


DHASH = f"dh AS ({_hex('SELECT a.doc_id, a.t * 8 + a.u AS k, b.v - a.v > 1e-7 AS bit FROM sm a JOIN sm b ON a.doc_id = b.doc_id AND a.t = b.t AND b.u = a.u + 1')})"
BASIS = "ba AS (SELECT k, x, sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 32.0::DOUBLE) * cos(pi() * (2 * x + 1) * k / 64) AS c FROM range(8) k(k), range(32) x(x))"
PHASH = f"""{BASIS}, hf AS (SELECT doc_id, k, u, sum(c * v) AS v FROM sm JOIN ba ON t = x GROUP BY ALL), lo AS (SELECT doc_id, hf.k * 8 + ba.k AS k, sum(c * v) AS v FROM hf JOIN ba ON u = x GROUP BY ALL),
md AS (SELECT doc_id, median(v) AS m FROM lo WHERE k > 0 GROUP BY doc_id), ph AS ({_hex('SELECT doc_id, k, v - m > 1e-7 AS bit FROM lo JOIN md USING (doc_id)')})"""


@query("M1", f"WITH {PX}, {_resized(8, 9)}, {DHASH} SELECT doc_id, code AS dhash FROM dh")
def m1(spark, d):
    return measured(spark, d, pixels.dhash).select("doc_id", F.col("v").alias("dhash"))


@query("M2", f"WITH {PX}, {_resized(32, 32)}, {PHASH} SELECT doc_id, code AS phash FROM ph")
def m2(spark, d):
    return measured(spark, d, pixels.phash).select("doc_id", F.col("v").alias("phash"))


@query("M3", f"WITH {PX} SELECT doc_id, sum(r * 299 + gr * 587 + b * 114) / (count(*) * 1000)::DOUBLE AS brightness, round(stddev_pop(v), 6) AS contrast FROM g GROUP BY doc_id")
def m3(spark, d):
    out = measured(spark, d, pixels.brightness)
    return out.select("doc_id", F.col("v.mean").alias("brightness"), r(F.sqrt("v.variance")).alias("contrast"))


@query("M4", f"WITH {PX}, {LAP} SELECT doc_id, round(var_pop(v), 4) AS laplacian_var FROM lap GROUP BY doc_id")
def m4(spark, d):
    return measured(spark, d, pixels.laplacian_variance).select("doc_id", r("v", 4).alias("laplacian_var"))


@query("M5", f"""WITH {PX}, {_resized(16, 16)}, sq AS (SELECT doc_id, t, u, v, CASE WHEN var_pop(v) OVER (PARTITION BY doc_id) > 1e-7 THEN var_pop(v) OVER (PARTITION BY doc_id) ELSE 1 END AS s FROM sm),
nb AS (SELECT *, lag(v) OVER (PARTITION BY doc_id, u ORDER BY t) AS n, lead(v) OVER (PARTITION BY doc_id, u ORDER BY t) AS o, lag(v) OVER (PARTITION BY doc_id, t ORDER BY u) AS l, lead(v) OVER (PARTITION BY doc_id, t ORDER BY u) AS e FROM sq),
lq AS (SELECT doc_id, s, coalesce(n, o) + coalesce(o, n) + coalesce(l, e) + coalesce(e, l) - 4 * v AS v FROM nb)
SELECT doc_id, round(var_pop(v) / any_value(s), 6) AS sharpness_norm FROM lq GROUP BY doc_id""")
def m5(spark, d):
    return measured(spark, d, lambda image: pixels.sharpness(image, 16)).select("doc_id", r("v").alias("sharpness_norm"))


@query("M6", f"""WITH {PX}, sh AS (SELECT c.doc_id, c.h, abs(sum(CASE WHEN o.x = c.x AND o.y = c.y THEN 4 WHEN o.x = c.x OR o.y = c.y THEN -2 ELSE 1 END * o.v)) AS v
  FROM g c JOIN (SELECT g.*, unnest([-1, 0, 1]) AS dy FROM g) o ON o.doc_id = c.doc_id AND c.y = o.y + o.dy AND o.x BETWEEN c.x - 1 AND c.x + 1
  WHERE c.y BETWEEN 1 AND c.h - 2 AND c.x BETWEEN 1 AND {SIDE - 2} GROUP BY c.doc_id, c.h, c.y, c.x)
SELECT doc_id, round(coalesce(n, 0), 6) AS noise_sigma FROM im LEFT JOIN (SELECT doc_id, sum(v) * sqrt(pi() / 2) / 36 / ({SIDE - 2} * (any_value(h) - 2)) AS n FROM sh GROUP BY doc_id) USING (doc_id)""")
def m6(spark, d):
    return pixels.pixel_noise(images(spark, d), "content", SIDE).select("doc_id", r("noise_sigma").alias("noise_sigma"))


@query("M8", f"WITH {PX} SELECT doc_id, round(avg((v <= 100)::INT), 6) AS padding_ratio FROM g GROUP BY doc_id")
def m8(spark, d):
    return measured(spark, d, lambda image: pixels.dark_share(image, 100)).select("doc_id", r("v").alias("padding_ratio"))


@query("M9", f"WITH {PX} SELECT doc_id, CASE WHEN greatest(h, {SIDE}) <= 64 THEN h ELSE greatest(1, round_even(h * 64 / greatest(h, {SIDE})::DOUBLE, 0)::INT) END AS height, CASE WHEN greatest(h, {SIDE}) <= 64 THEN {SIDE} ELSE greatest(1, round_even({SIDE} * 64 / greatest(h, {SIDE})::DOUBLE, 0)::INT) END AS width FROM im")
def m9(spark, d):
    docs = read(spark, d, "documents").select("doc_id", pixels.rows_of(F.coalesce("text", F.lit("")).cast("binary"), SIDE).alias("h"))
    height, width = pixels.proxy_size(F.col("h"), F.lit(SIDE), 64)
    return docs.select("doc_id", height.alias("height"), width.alias("width"))


#: An image of Spark's source for each document; some have other channels, depths, sides or too few bytes.
CHANNELS = "CASE doc_id % 11 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END"
MODE = "CASE WHEN doc_id % 23 = 0 THEN -1 WHEN doc_id % 17 = 0 THEN 21 ELSE 16 END"
BOX = f"CASE WHEN doc_id % 11 = 1 THEN {SIDE * 3} ELSE {SIDE} END"


@query("P19", f"""WITH im AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, greatest(1, ceil(strlen(coalesce(text, '')) / {SIDE * 3}.0))::INT AS rows FROM documents),
i AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE rows END AS height, {BOX} AS width, {CHANNELS} AS channels, {MODE} AS mode, CASE WHEN doc_id % 19 = 0 THEN n ELSE rows * {SIDE * 3} END AS bytes FROM im)
SELECT doc_id, CASE WHEN mode < 0 THEN 'no image' WHEN channels NOT IN (1, 3) THEN 'channels' WHEN mode % 8 <> 0 THEN 'depth' WHEN least(height, width) <= 0 THEN 'empty' WHEN bytes <> height * width * channels THEN 'bytes' END AS problem FROM i""")
def p19(spark, d):
    """Why a document's image is no input, or null."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    docs = read(spark, d, "documents").select("doc_id", content.alias("content"), pixels.rows_of(content, SIDE).cast("int").alias("rows"))
    data = F.expr(f"CASE WHEN doc_id % 19 = 0 THEN content ELSE rpad(content, rows * {SIDE * 3}, X'00') END")
    height = F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("rows"))
    image = F.struct(height.alias("height"), F.expr(BOX).alias("width"), F.expr(CHANNELS).alias("nChannels"), F.expr(MODE).alias("mode"), data.alias("data"))
    return docs.select("doc_id", image.alias("image")).select("doc_id", pixels.input_problem(F.col("image")).alias("problem"))


@query("M11", f"""WITH {PX}, {LAP} SELECT doc_id, round(count_if(own > 10) / count(*), 6) AS visible_fraction, coalesce(sum(r * 299 + gr * 587 + b * 114) FILTER (WHERE own > 10) / (1000 * count_if(own > 10))::DOUBLE, 0) AS brightness, round(coalesce(var_pop(v) FILTER (WHERE own > 10), 0), 4) AS sharpness,
  round(coalesce(avg(r) FILTER (WHERE own > 10) / greatest(avg(gr) FILTER (WHERE own > 10), avg(b) FILTER (WHERE own > 10), 1), 0), 6) AS color_score FROM lap GROUP BY doc_id""")
def m11(spark, d):
    out = pixels.pixel_quality(images(spark, d), "content", SIDE)
    return out.select("doc_id", r("visible_fraction").alias("visible_fraction"), "brightness", r("sharpness", 4).alias("sharpness"), r("color_score").alias("color_score"))


@query("M7")
def m7(spark, d):
    return _measured(spark, d, lambda x: kernels.tissue_box(x, 100) or (-1, -1, -1, -1), "disc_x int, disc_y int, disc_w int, disc_h int")


@query("M10")
def m10(spark, d):
    def run(x: np.ndarray) -> tuple:
        m = kernels.measure("", *x.shape, np.ascontiguousarray(x[:, :, ::-1]).tobytes())
        return m["aspect_ratio"], m["sharpness_norm"], m["dhash"], m["readable"]

    return _measured(spark, d, run, "aspect_ratio double, sharpness_norm double, dhash string, readable boolean")


@query("X1")
def x1(spark, d):
    def run(x: np.ndarray) -> tuple:
        out = kernels.pipeline(x, {"remove_border": {"threshold": 40}, "circular_crop": {}, "resize": {"size": 32}})
        return out.shape[0], out.shape[1], float(out.mean())

    return _measured(spark, d, run, "height int, width int, mean double")


@query("M12")
def m12(spark, d):
    def run(x: np.ndarray) -> tuple:
        part = kernels.largest_component(kernels.majority(kernels.gray(x) > 100))
        return (0 if part is None else int(part.sum()),)

    return _measured(spark, d, run, "pixels int")


@query("X2")
def x2(spark, d):
    return _measured(spark, d, lambda x: (float(kernels.circular_crop(x).mean()),), "mean double")


@query("X3")
def x3(spark, d):
    return _measured(spark, d, lambda x: (*kernels.resize(x, 24, 24).shape[:2], float(kernels.resize(x, 24, 24).mean().round(6))), "height int, width int, mean double")


@query("X4")
def x4(spark, d):
    return _measured(spark, d, lambda x: tuple(float(kernels.local_contrast(x, m).mean()) for m in ("lab", "green", "hsv")), "lab double, green double, hsv double")


@query("X5")
def x5(spark, d):
    return _measured(spark, d, lambda x: (float(kernels.even_light(x).mean()),), "mean double")


@query("S8")
def s8(spark, d):
    """The table files themselves, by Spark's own scan of files: name and size; their content isn't read."""
    files = manifests.file_content(spark, d, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"))


@query("S14", "SELECT (i - 1)::INT AS channel, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i")
def s14(spark, d):
    """Channel constants written as JSON and loaded."""
    from quillspark.operators import profile

    path = Scratch(spark, "s14").path("stats")
    e = read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    profile.channel_moments(e, "embedding").select("channel", r("mean").alias("mean")).write.json(path)
    return spark.read.schema("channel int, mean double").json(path)


@query("K5", f"WITH {M} SELECT split, label, count(*) AS count FROM m GROUP BY ALL")
def k5(spark, d):
    path = Scratch(spark, "k5").path("counts")
    sinks.write_counts(manifest(spark, d).groupBy("split", "label").count(), path)
    return spark.read.schema("split string, label int, count long").option("header", True).csv(path)


@query("G1", "WITH RECURSIVE up(n, m) AS (SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT n, m // 7 FROM up WHERE m > 0), nodes AS (SELECT c_custkey AS n FROM customer UNION SELECT c_custkey // 7 FROM customer) SELECT n AS node, coalesce(min(m), n) AS component FROM nodes LEFT JOIN up USING (n) GROUP BY n")
def g1(spark, d):
    """A tree of all customers, each linked to the one at a seventh of its key: one component, that of the root."""
    from quillspark.operators.components import connected_components

    links = read(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 7").alias("dst"))
    return connected_components(links, Scratch(spark, "g1"))


@query("G8", f"WITH {M} SELECT count(*) AS leaking FROM (SELECT md5 FROM m GROUP BY md5 HAVING count(DISTINCT split) > 1)")
def g8(spark, d):
    from quillspark.operators import splits

    return splits.spanning_keys(manifest(spark, d), "md5").agg(F.count("*").alias("leaking"))


@query("X9")
def x9(spark, d):
    names = [n for _, n, _ in kernels.POLICY]

    def run(x: np.ndarray) -> tuple:
        rng = np.random.Generator(np.random.PCG64(int(x.sum())))
        return tuple(float(kernels.augment(x, n, rng).mean()) for n in names)

    return _measured(spark, d, run, ", ".join(f"{n} double" for n in names))


TYPE = "CASE WHEN doc_id % 3 = 0 THEN 'image/png' WHEN doc_id % 3 = 1 THEN 'image/jpeg' WHEN doc_id % 2 = 0 THEN 'text/plain' END"
LENGTH = "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END"


@query("S15", f"SELECT doc_id, CASE WHEN coalesce({TYPE} NOT IN ('image/png', 'image/jpeg'), true) THEN 415 WHEN {LENGTH} = 0 THEN 400 WHEN {LENGTH} > 2000 THEN 413 ELSE 200 END AS status FROM documents")
def s15(spark, d):
    """Documents as uploads of stated types and lengths, with a limit of 2000."""
    docs = read(spark, d, "documents").select("doc_id", F.expr(TYPE).alias("content_type"), F.expr(LENGTH).alias("length"))
    return manifests.upload_reasons(docs, 2000).select("doc_id", "status")


@query("S10", f"WITH {M} SELECT split, count(*) AS n FROM m GROUP BY split")
def s10(spark, d):
    path = Scratch(spark, "s10").path("report")
    manifest(spark, d).groupBy("split").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("split string, n long").json(path)


@query("K1", f"WITH {M} SELECT split, id_code, label FROM m")
def k1(spark, d):
    path = Scratch(spark, "k1").path("out")
    m = manifest(spark, d).select("split", "id_code", "label")
    sinks.write_manifest(m, path, m.agg(F.count("*").alias("rows")), csv=True)
    return spark.read.schema("split string, id_code string, label int").option("header", True).csv(f"{path}/manifest")


@query("K2", f"WITH {CLEAN} SELECT included, count(*) AS n FROM k GROUP BY included")
def k2(spark, d):
    path = Scratch(spark, "k2").path("out")
    sinks.write_clean(cleaned(spark, d), path)
    return spark.read.parquet(f"{path}/rows").groupBy(F.col("included").cast("boolean").alias("included")).agg(F.count("*").alias("n"))


@query("K4", f"WITH {M} SELECT split AS new_split, count(*) AS n FROM m GROUP BY split")
def k4(spark, d):
    path = Scratch(spark, "k4").path("out")
    sinks.write_splits(manifest(spark, d).select("id_code", "label", F.col("split").alias("new_split")), path, {"seed": 0, "source": "documents"})
    return spark.read.option("header", True).csv(f"{path}/splits").groupBy("new_split").agg(F.count("*").alias("n"))


@query("K7", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def k7(spark, d):
    path = Scratch(spark, "k7").path("epochs")
    e = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    sinks.append_epoch(e.where("dayofmonth(day) % 2 = 0"), path)
    sinks.append_epoch(e.where("dayofmonth(day) % 2 = 1"), path)
    return spark.read.parquet(path)


@query("K9", f"WITH {M} SELECT 'a1b2' AS preprocessing_hash, count(*) AS n FROM m")
def k9(spark, d):
    path = Scratch(spark, "k9").path("cache")
    sinks.processed_cache(manifest(spark, d).select("row_pos", "md5"), path, "a1b2")
    return spark.read.schema("row_pos long, md5 string, preprocessing_hash string").parquet(path).groupBy("preprocessing_hash").agg(F.count("*").alias("n"))


@query("K11", f"WITH {M} SELECT to_json(struct_pack(split := split, n := count(*))) AS value FROM m GROUP BY split")
def k11(spark, d):
    return sinks.report_json(manifest(spark, d).groupBy("split").agg(F.count("*").alias("n")))


@query("O1", f"WITH {M} SELECT row_pos, row_number() OVER (PARTITION BY split ORDER BY readable DESC, label DESC, row_pos) AS place FROM m")
def o1(spark, d):
    m = manifest(spark, d).select("row_pos", "split", "readable", "label")
    placed = epochs.placed_within(m, "split", [F.desc("readable"), F.desc("label"), F.asc("row_pos")], "place", Scratch(spark, "o1"))
    return placed.select("row_pos", "place")


@query("O4", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 50) ORDER BY o_orderkey")
def o4(spark, d):
    return epochs.seeded_sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 50, 5).orderBy("o_orderkey")


@query("F4", f"WITH {M} SELECT row_pos, round(log2(width), 6) AS bits, round(sqrt(height), 6) AS root, least(greatest(width, 200), 500) AS clipped, round_even(brightness, 2) AS even FROM m")
def f4(spark, d):
    return manifest(spark, d).select("row_pos", r(F.log2("width")).alias("bits"), r(F.sqrt("height")).alias("root"), F.least(F.greatest("width", F.lit(200)), F.lit(500)).alias("clipped"), F.bround("brightness", 2).alias("even"))


@query("F6", f"WITH {M} SELECT row_pos, CASE WHEN TRY_CAST(raw_label AS DOUBLE) = floor(TRY_CAST(raw_label AS DOUBLE)) THEN TRY_CAST(raw_label AS DOUBLE)::INT ELSE -1 END AS label, raw_label IS NOT NULL AS given FROM m")
def f6(spark, d):
    """A fractional label is no label, like a missing one or one that is no number."""
    m = manifest(spark, d)
    return m.select("row_pos", F.coalesce(C.integer_label(F.col("raw_label"))[1], F.lit(-1)).alias("label"), F.col("raw_label").isNotNull().alias("given"))


@query("F7", f"WITH {M} SELECT row_pos, label AS \"truth.label\", split AS \"truth.split\" FROM m")
def f7(spark, d):
    """A nested record flattened to dotted names."""
    nested = manifest(spark, d).select("row_pos", F.struct("label", "split").alias("truth"))
    return nested.select("row_pos", *(F.col(f"truth.{f}").alias(f"truth.{f}") for f in nested.schema["truth"].dataType.names))


@query("F8", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def f8(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("F9", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events")
def f9(spark, d):
    e = read(spark, d, "events")
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return e.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), key).alias("first"))


@query("L4", f"WITH {LOGS} SELECT vec_id, round({ORDINAL}, 6) AS loss FROM lp")
def l4(spark, d):
    return scores(spark, d).select("vec_id", r(C.ordinal_loss(F.col("ordinal_logits"), F.col("label"), 1.0)).alias("loss"))


@query("L9", "WITH a AS (SELECT vec_id, list_transform(range(1, 65), lambda i: greatest(0, embedding[i]::DOUBLE * 0.5::DOUBLE)) AS w FROM embeddings) SELECT vec_id, round(list_sum(list_transform(w, lambda x: (x - list_min(w)) / (list_max(w) - list_min(w) + 0.000001::DOUBLE))), 4) AS total FROM a")
def l9(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", r(C.total(C.class_activation(F.col("embedding"), F.array_repeat(F.lit(0.5), 64))), 4).alias("total"))


@query("L10", "SELECT o_orderkey, round(0.5 * (1 + cos(pi() * (o_orderkey % 50) / 50)), 6) AS rate FROM orders")
def l10(spark, d):
    return read(spark, d, "orders").select("o_orderkey", r(C.cosine_rate(F.col("o_orderkey") % 50, 50)).alias("rate"))


@query("L11", "WITH a AS (SELECT vec_id, embedding, greatest(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127, 1e-12) AS s FROM embeddings) SELECT vec_id, list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE / s, 0)))::BIGINT AS total FROM a")
def l11(spark, d):
    e = read(spark, d, "embeddings")
    codes = C.quantize_int8(F.col("embedding"))
    return e.select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("streamed_daily_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def streamed_daily_counts(spark, d):
    """An extension: the events as a stream, by day and type, written exactly once and read back."""
    scratch = Scratch(spark, "stream")
    path, state = scratch.path("out"), scratch.path("state")
    schema = read(spark, d, "events").schema
    stream = streams.arriving(spark, f"{d}/events.parquet*", schema)
    counts = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    flat = counts.select(F.col("window.start").alias("start"), "event_type", "n", r("mean").alias("mean"))
    run = flat.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    run.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, mean double").parquet(path)


@query("P8", f"WITH {M} SELECT count(*) AS flagged FROM m WHERE brightness < 6")
def p8(spark, d):
    """A report-only rule flags and never excludes."""
    m = manifest(spark, d)
    out = rules.apply_rules(m, [rules.quality({"dark": ("brightness", "<", 6.0)})])
    return out.where("included AND quality_flags = 'dark'").agg(F.count("*").alias("flagged"))
