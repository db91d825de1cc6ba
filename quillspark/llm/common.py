"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


#: Most bytes of text that a classifier is fitted on.
SAMPLE_BYTES = 64 << 20


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limit: int, divisor: int, held: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of labelled rows outside the held-out fold, the same ones at every run: at most limit rows of at most
    most_bytes bytes in all (texts of over a 64th of that are not sampled).

    These bound what a classifier is fitted on, and so the keys that are broadcast. Rows with a null label or id are left
    out, and so are labels of documents that aren't there, which take nothing of the bound; a document with several labels counts
    once for each; rows that share id, label and text count once. The order in which rows are taken is that of hashes of the
    id and then of the text.
    """
    wanted = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", divisor) != held)).distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    named = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), size.alias("bytes")).where(F.col("bytes") <= most_bytes // 64)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"), F.col("text_hash")]
    keys = named.join(wanted, "doc_id").groupBy("doc_id", "y", "text_hash").agg(F.max("bytes").alias("bytes")).orderBy(*order).limit(limit)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most limit rows
    chosen = keys.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= most_bytes).select("doc_id", "y", "text_hash")
    return named.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "y", "text_hash"]).select("doc_id", "text", "y")


def without(documents: DataFrame, *names: str) -> list[str]:
    """The columns of documents but for those of these names, in whatever case."""
    return [c for c in documents.columns if c.lower() not in names]


def one_row_each(rows: DataFrame, *key: str) -> DataFrame:
    """(key, row): of the rows that share a key the first in a total order of all their columns, whatever the partitions."""
    return rows.groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))


#: About how many bytes of text a shard of a range-sorted output holds.
SHARD_BYTES = 256 << 20


def shards(spark: SparkSession, text_bytes: int | None) -> int:
    """How many parts to range-sort texts into: what the session asks for, more where parts would grow with the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(text_bytes or 0) // SHARD_BYTES))
