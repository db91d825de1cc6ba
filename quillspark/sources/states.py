"""What is kept between runs so that only new or changed input is read: moment states by file, processed rows by parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.columns import config_hash
from quillspark.operators.profile import merge_moments, moment_states
from quillspark.scratch import Scratch, drop_path
from quillspark.sources.manifests import listed_files, reusable

IDENTITY = ["path", "size_bytes", "modified_ms"]
STATE = "path string, size_bytes long, modified_ms long, channel int, n long, mean double, m2 double"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs left at path; nothing where there was none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def updated_moments(spark: SparkSession, folder: str, values: str, state: str) -> tuple[DataFrame, list[str]]:
    """(channel, n, mean, std) over the Parquet files in folder, and the files that were read for it.

    state holds (n, mean, m2) by file and channel. Files that it knows, with the same size and time, aren't opened; new and changed ones are
    read and added; states of files that are gone or changed take no part. Files without values have a state of no channel, so that
    they aren't read again. The listing is the driver's, a name a file; no row of data is. Equal to a run over all files.
    """
    files = listed_files(spark, folder, "*.parquet")
    known = _stored(spark, state, STATE)
    _, missing = reusable(files, known.select(*IDENTITY).distinct(), IDENTITY)
    new = [r["path"] for r in missing.select("path").orderBy("path").collect()]
    if new:
        read = spark.read.parquet(*new).select(F.col("_metadata.file_path").alias("uri"), values)
        states = moment_states(read, values, ["uri"])
        tail = F.regexp_extract("path", "[^:]*$", 0)  # one store writes file:/x, another file:///x
        name = lambda c: F.regexp_replace(c, "^/+", "/")
        each = missing.withColumn("_name", name(tail)).join(states.withColumn("_name", name(F.regexp_extract("uri", "[^:]*$", 0))), "_name", "left")
        each.select(*IDENTITY, F.coalesce("channel", F.lit(-1)).alias("channel"), F.coalesce("n", F.lit(0)).alias("n"), "mean", "m2").write.mode("append").parquet(state)
    valid = spark.read.schema(STATE).parquet(state) if new else known
    return merge_moments(valid.join(files.select(*IDENTITY), IDENTITY, "left_semi")), new


#: Parts of a cache that are rewritten one by one.
BUCKETS = 64


def processed(rows: DataFrame, parameters: Mapping[str, Any], process: Callable[[DataFrame], DataFrame], cache: str, buckets: int = BUCKETS) -> DataFrame:
    """process(rows), each row once for its path, size, time and the parameters: all its columns, and reused.

    rows has path, size_bytes and modified_ms, path naming a row; process keeps these and adds columns whose values depend on the row and the
    parameters alone. The cache is partitioned by the parameters' hash and by buckets of paths. Rows that it holds with the same size and
    time are taken from it, others are processed; only buckets with rows that are new, changed or gone are written again, each whole.
    Other parameters leave what is there alone.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "processed")
    key = config_hash(dict(parameters))
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    schema = process(rows.limit(0)).schema
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    held = _stored(spark, cache, f"{listed}, preprocessing_hash string, bucket int").where(F.col("preprocessing_hash") == key).drop("preprocessing_hash")
    held = scratch.table(held, "held")
    kept, missing = reusable(rows, held, IDENTITY)
    made = scratch.table(process(missing.select(*rows.columns)).select(*schema.names).withColumn("bucket", bucket), "made")
    kept = scratch.table(kept.select(*schema.names, "bucket"), "kept")
    gone = held.join(kept.select("path"), "path", "left_anti").select("bucket")
    touched = made.select("bucket").union(gone).distinct()  # buckets rows at most
    again = kept.join(F.broadcast(touched), "bucket", "left_semi").unionByName(made)
    again.withColumn("preprocessing_hash", F.lit(key)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("preprocessing_hash", "bucket").parquet(cache)
    for empty in touched.join(again.select("bucket"), "bucket", "left_anti").collect():  # a write leaves parts without rows as they were
        drop_path(spark, f"{cache}/preprocessing_hash={key}/bucket={empty['bucket']}")
    out = kept.withColumn("reused", F.lit(True)).unionByName(made.withColumn("reused", F.lit(False))).drop("bucket")
    result = scratch.table(out, "result")
    scratch.drop_all(but=result)
    return result
