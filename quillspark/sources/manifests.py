"""Scans of split manifests and files."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillspark.sources.config import ConfigError, resolve_column

ID_COLUMNS = ("id_code", "image_id", "filename", "image", "id")
LABEL_COLUMNS = ("diagnosis", "target", "label", "grade")


def split_scan(spark: SparkSession, paths: Mapping[str, str], folder: str = "", extension: str = ".png") -> DataFrame:
    """split, id_code, raw_label, path of several CSV files, one a split (S1). Ids stay text (T14); a file without a label
    column has null labels (S3). Nothing is inferred, so the data isn't read for its types."""
    parts = []
    for split, path in paths.items():
        raw = spark.read.option("header", True).csv(path)
        id_column = resolve_column(raw.columns, ID_COLUMNS, "id")
        try:
            label = F.col(f"`{resolve_column(raw.columns, LABEL_COLUMNS, 'label')}`")
        except ConfigError:
            label = F.lit(None).cast("string")
        name = F.trim(F.col(f"`{id_column}`"))
        parts.append(raw.select(F.lit(split).alias("split"), name.alias("id_code"), label.alias("raw_label"), F.concat(F.lit(f"{folder}/{split}/" if folder else f"{split}/"), name, F.lit(extension)).alias("path")))
    return reduce(DataFrame.unionByName, parts)


def stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_manifest(spark: SparkSession, path: str, split: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """A split's included rows from the clean manifest, or the raw scan with a warning where there is none."""
    try:
        clean = spark.read.parquet(path)
    except AnalysisException:
        warnings.warn(f"no clean manifest at {path}; raw rows are used", stacklevel=2)
        return fallback().where(F.col("split") == split).select("id_code", "path", "label")
    return clean.where((F.col("split") == split) & F.col("included")).select("id_code", "path", "label")


def listed_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, size_bytes, modified of files, zero-byte ones too, from Hadoop's listing.

    binaryFile skips empty files, so the listing comes from the file system: names only, no content.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(conf).listFiles(root, recursive)
    glob = jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    rows = []
    while found.hasNext():
        f = found.next()
        if glob.accept(f.getPath()):
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "path string, size_bytes long, modified_ms long")


def file_content(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content; queries without content don't read it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def with_measurements(manifest: DataFrame, measured: DataFrame, defaults: Mapping[str, object], key: str = "path") -> DataFrame:
    """manifest with measured columns; what wasn't measured keeps its default."""
    extra = [c for c in measured.columns if c != key]
    m = measured.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_m_{c}") for c in extra))
    out = manifest.join(m, manifest[key] == m["_key"], "left")
    old = {c: F.col(c) if c in manifest.columns else F.lit(None) for c in extra}
    return out.select(*(c for c in manifest.columns if c not in extra), *(F.coalesce(F.col(f"_m_{c}"), F.lit(defaults[c]) if c in defaults else old[c]).alias(c) for c in extra))


def unreferenced(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files that no split names."""
    return files.join(manifest.select(key), key, "left_anti")


def reusable(now: DataFrame, before: DataFrame, keys: Sequence[str] = ("path", "size_bytes", "modified_ms")) -> tuple[DataFrame, DataFrame]:
    """(rows of the earlier manifest that are still valid, rows to measure anew): all keys must agree."""
    return before.join(now.select(*keys), list(keys), "left_semi"), now.join(before.select(*keys), list(keys), "left_anti")


#: Content types of uploads that are read.
UPLOAD_TYPES = ("image/png", "image/jpeg")


def upload_reasons(df: DataFrame, limit: int = 15 << 20, content_type: str = "content_type", length: str = "length") -> DataFrame:
    """Status of uploads: 415 by their stated type, then 400 where empty, 413 where too long, else 200."""
    known = F.coalesce(F.col(content_type).isin(*UPLOAD_TYPES), F.lit(False))
    return df.withColumn("status", F.when(~known, 415).when(F.coalesce(F.col(length), F.lit(0)) == 0, 400).when(F.col(length) > limit, 413).otherwise(200))


class Registry:
    """Named factories (S17, X8): an unknown or repeated name is an error."""

    def __init__(self, kind: str):
        self.kind, self.made = kind, {}

    def register(self, name: str) -> Callable:
        def add(factory: Callable) -> Callable:
            if name in self.made:
                raise ConfigError(f"{self.kind} {name} is registered twice")
            self.made[name] = factory
            return factory

        return add

    def create(self, name: str, *args, **options):
        if name not in self.made:
            raise ConfigError(f"unknown {self.kind} {name}; known: {sorted(self.made)}")
        return self.made[name](*args, **options)


def build_splits(make: Callable[[str], DataFrame], splits: Sequence[str]) -> dict[str, DataFrame]:
    """Datasets of the splits that can be built; a warning for each other one."""
    out = {}
    for s in splits:
        try:
            out[s] = make(s)
        except (ConfigError, AnalysisException, ValueError) as e:
            warnings.warn(f"split {s} is left out: {e}", stacklevel=2)
    return out


def manifest_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(check, passed) of a manifest: that it has rows, and each required column."""
    rows = df.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("passed")).select(F.lit("rows").alias("check"), "passed")
    return rows.union(df.sparkSession.createDataFrame([(f"column:{c}", c in df.columns) for c in columns], "check string, passed boolean"))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or an error where columns are missing or there are no rows."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ConfigError(f"missing columns {missing}")
    if df.isEmpty():
        raise ConfigError("the manifest has no rows")
    return df
