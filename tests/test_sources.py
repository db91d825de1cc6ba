"""Configuration, scans, sinks, kernels and streams."""

import dataclasses
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.sources import config, manifests, sinks
from quillspark.streaming import manifests as streams


def png(image):
    h, w = image.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def disc(w=90, h=70, r=25):
    y, x = np.mgrid[:h, :w]
    image = np.zeros((h, w, 3), np.uint8)
    image[(y - h // 2) ** 2 + (x - w // 2) ** 2 <= r * r] = (180, 90, 40)
    return image


def test_overrides_and_merge(tmp_path):
    assert config.parse_override("a.b=3") == {"a": {"b": 3}} and config.parse_override("a=x y") == {"a": "x y"}
    with pytest.raises(config.ConfigError):
        config.parse_override("novalue")
    f = tmp_path / "c.json"
    f.write_text('{"n": 1, "dataset_name": "x", "datasets": {"x": {"n": 2, "m": {"k": 1}}}, "profiles": {"p": {"m": {"j": 5}}}}')
    assert config.layered(f, "p", ["m.k=9"]) == {"n": 2, "dataset_name": "x", "m": {"j": 5, "k": 9}}
    with pytest.raises(config.ConfigError):
        config.layered(f, "none")


def test_strict_shapes():
    @dataclasses.dataclass
    class Inner:
        rate: float

    @dataclasses.dataclass
    class Outer:
        n: int
        inner: Inner
        names: list[str]
        on: bool = True

    made = config.strict(Outer, {"n": 1, "inner": {"rate": 2}, "names": ["a"]})
    assert made.inner.rate == 2.0 and isinstance(made.inner.rate, float)
    for bad in ({"n": True, "inner": {"rate": 1}, "names": []}, {"n": 1, "inner": {"rate": 1}, "names": [], "x": 1}, {"n": 1, "names": []}, {"n": 1, "inner": {"rate": 1}, "names": [], "on": 1}):
        with pytest.raises(config.ConfigError):
            config.strict(Outer, bad)


def test_columns_and_registry():
    assert config.resolve_column([" Diagnosis ", "ID"], manifests.LABEL_COLUMNS, "label") == " Diagnosis "
    with pytest.raises(config.ConfigError):
        config.resolve_column(["a"], ["b"], "id")
    reg = manifests.Registry("dataset")
    reg.register("a")(lambda: 1)
    assert reg.create("a") == 1
    for wrong in (lambda: reg.create("b"), lambda: reg.register("a")(lambda: 2)):
        with pytest.raises(config.ConfigError):
            wrong()
    assert config.forbidden({"steps": [{"CutMix": {}}, "flip"]}, ["cutmix"]) == ["config.steps[0].CutMix"]


def test_split_scan_keeps_ids_and_tolerates_missing_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id_code,Diagnosis\n 007 ,2\n8,x\n")
    (tmp_path / "b.csv").write_text("image\n009\n")
    rows = manifests.split_scan(spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "b.csv")}, "raw").orderBy("id_code").collect()
    assert [(r["split"], r["id_code"], r["raw_label"], r["path"]) for r in rows] == [("train", "007", "2", "raw/train/007.png"), ("test", "009", None, "raw/test/009.png"), ("train", "8", "x", "raw/train/8.png")]


def test_files_and_images(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(png(disc()))
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "broken.png").write_bytes(b"not an image")
    listed = {r["path"].rsplit("/", 1)[1]: r["size_bytes"] for r in manifests.listed_files(spark, str(tmp_path), "*.png").collect()}
    assert listed["empty.png"] == 0 and len(listed) == 3
    heads = {r["path"].rsplit("/", 1)[1]: (r["format"], r["width"], r["height"]) for r in K.headers(manifests.file_content(spark, str(tmp_path), "*.png")).collect()}
    assert heads["one.png"] == ("PNG", 90, 70) and heads["broken.png"][0] is None
    measured = {r["path"].rsplit("/", 1)[1]: r for r in K.measured_images(spark, str(tmp_path)).collect()}
    assert not measured["broken.png"]["readable"] and measured["broken.png"]["error"] == "decode failed"
    m = measured["one.png"]
    assert m["readable"] and (m["width"], m["height"]) == (90, 70) and m["dhash"] == K.dhash(disc()) and abs(m["disc_w"] - 51) <= 2
    assert manifests.split_manifest(spark, str(tmp_path / "none"), "train", lambda: spark.createDataFrame([("a", "p", 1, "train")], "id_code string, path string, label int, split string")).count() == 1


def test_kernels():
    flat = np.full((40, 50, 3), 100, np.uint8)
    assert K.brightness_contrast(flat) == pytest.approx((100, 0)) and K.laplacian_variance(flat) == pytest.approx(0) and K.noise_sigma(flat) == pytest.approx(0)
    assert K.dhash(flat) == "0" * 16 and len(K.phash(disc())) == 16
    ramp = np.repeat(np.arange(0, 180, 2, dtype=np.uint8)[None, :, None], 60, axis=0).repeat(3, axis=2)
    assert K.dhash(ramp) == "f" * 16
    assert K.resize(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert K.proxy(flat, 512) is flat and K.proxy(np.zeros((1000, 500, 3), np.uint8)).shape == (512, 256, 3)
    assert K.padding_ratio(np.zeros((5, 5, 3), np.uint8)) == 1 and K.tissue_box(np.zeros((9, 9, 3), np.uint8)) is None
    cut = K.remove_border(disc())
    assert cut.shape[0] <= 53 and cut.shape[1] <= 53
    tiny = np.zeros((100, 100, 3), np.uint8)
    tiny[40:50, 40:50] = 200
    assert K.remove_border(tiny).shape == tiny.shape
    assert K.circular_crop(flat)[0, 0].sum() == 0 and K.letterbox(disc(), 64).shape == (64, 64, 3)
    for wrong in (np.zeros((0, 3, 3), np.uint8), np.zeros((3, 3), np.uint8), np.zeros((3, 3, 3))):
        with pytest.raises(K.ImageError):
            K.checked(wrong)
    with pytest.raises(K.ImageError):
        K.pipeline(flat, {"resize": {"size": 8}, "remove_border": {}})
    with pytest.raises(K.ImageError):
        K.channels_first(flat, (0, 0, 0), (1, 0, 1))
    assert (K.local_contrast(flat, "green")[:, :, 0] == 100).all() and K.local_contrast(disc()).std() > 0 and K.local_contrast(disc(), "hsv").shape == disc().shape
    assert (K.even_light(flat) == 128).all()
    with pytest.raises(K.ImageError):
        K.local_contrast(flat, "none")
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 2] = mask[4, 0] = mask[4, 1] = True
    assert K.largest_component(mask).sum() == 3
    rng = np.random.Generator(np.random.PCG64(0))
    for _, name, _ in K.POLICY:
        assert K.augment(disc(), name, rng).shape == disc().shape


def test_cache_equals_forced_measurement(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size_bytes long, modified_ms long")
    before = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 2, 9, 0.6)], "path string, size_bytes long, modified_ms long, m double")
    kept, anew = manifests.reusable(now, before)
    assert [r["path"] for r in kept.collect()] == ["a"] and sorted(r["path"] for r in anew.collect()) == ["b", "c"]


def test_uploads(spark):
    rows = [("image/png", 0), ("image/gif", 8), ("image/gif", 0), ("image/png", 20 << 20), ("image/jpeg", 8), (None, 8), ("image/png", None)]
    df = spark.createDataFrame(rows, "content_type string, length long")
    assert [r["status"] for r in manifests.upload_reasons(df).collect()] == [400, 415, 415, 413, 200, 415, 400]


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "x" / "r.json", {"a": np.int64(3)})
    assert (tmp_path / "x" / "r.json").read_text() == '{\n  "a": 3\n}'
    assert sinks.ordered_columns([{"a": 1}, {"b": 1, "a": 2}]) == ["a", "b"]
    df = spark.createDataFrame([("1", "train"), ("2", "val")], "id_code string, new_split string")
    sinks.write_splits(df, str(tmp_path / "s"), {"seed": 1})
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_splits(df, str(tmp_path / "s"), {"seed": 1})
    assert sinks.run_manifest({"data": "ab"}, 3)["seed"] == 3
    with pytest.raises(config.ConfigError):
        manifests.require_columns(df, ["label"])
    with pytest.raises(config.ConfigError):
        manifests.require_columns(df.limit(0), ["id_code"])


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"2024-01-0{1 + i % 4} 00:00:00", float(i)) for i in range(24)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.arriving(spark, str(tmp_path / "in"), df.schema, 1)
    streams.append_to(streams.windowed_counts(stream, "t", "k", "v"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] > 0
    streams.append_to(streams.first_of_key(stream, "t", "k", "30 days"), str(tmp_path / "first"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "first")).count() == 3
