"""The manifest and prediction tables as the supplied tables stand for them; each column once, as SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND = "CASE WHEN n_chars < 741 THEN 0 WHEN n_chars < 1209 THEN 1 WHEN n_chars < 1867 THEN 2 WHEN n_chars < 3262 THEN 3 ELSE 4 END"


def _share(letter: str) -> str:
    return f"CAST(100 AS DOUBLE) * (length(text) - length(replace(text, '{letter}', ''))) / greatest(1, length(text))"


#: A document as a manifest row: text metrics stand for image metrics.
MANIFEST = {
    "row_pos": "doc_id",
    "split": "CASE WHEN doc_id % 10 = 8 THEN 'val' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END",
    "id_code": "CASE WHEN doc_id % 97 = 0 THEN '0' ELSE CAST(doc_id AS STRING) END",
    "source": "source",
    "lang": "CASE WHEN doc_id % 53 = 0 THEN '' ELSE lang END",
    "path": "concat(source, '/', CAST(doc_id AS STRING))",
    "md5": "md5(text)",
    "label": BAND,
    "raw_label": f"CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '7' WHEN doc_id % 23 = 0 THEN 'x' WHEN doc_id % 29 = 0 THEN '2.5' ELSE CAST({BAND} AS STRING) END",
    "exists": "doc_id % 37 <> 0",
    "size_bytes": "CASE WHEN doc_id % 43 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(n_chars AS BIGINT) END",
    "readable": "doc_id % 37 <> 0 AND doc_id % 43 <> 0 AND doc_id % 41 <> 0",
    "brightness": _share("e"),
    "contrast": _share(" "),
    "sharpness": f"CASE WHEN doc_id % 31 = 0 THEN NULL ELSE {_share('t')} END",
    "noise_sigma": _share("o"),
    "width": "CAST(length(text) % 640 + 100 AS INT)",
    "height": "CAST(length(text) % 480 AS INT)",
}

#: Orders as many predictions of a five-level truth.
GRADES = {
    "key": "o_orderkey",
    "label": "CAST(substr(o_orderpriority, 1, 1) AS INT) - 1",
    "prediction": "CASE WHEN o_orderkey % 10 < 7 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 ELSE CAST((CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 + o_custkey) % 5 AS INT) END",
    "confidence": "CAST((o_orderkey * 7919 + o_custkey) % 1000 AS DOUBLE) / 1000",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(e).alias(n) for n, e in columns.items()))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(read(spark, sf_dir, "documents"), MANIFEST)


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(read(spark, sf_dir, "orders"), GRADES)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits: places 1-5 of the classes, 6-9 of the thresholds; label % 5 is the truth."""
    e = read(spark, sf_dir, "embeddings")
    wide = lambda low, n: F.transform(F.slice("embedding", low, n), lambda x: x.cast("double"))
    return e.select(F.col("vec_id"), wide(1, 5).alias("logits"), wide(6, 4).alias("ordinal_logits"), (F.col("label") % 5).cast("int").alias("label"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day as an epoch series."""
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


def _sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {table}"


M = f"m AS ({_sql(MANIFEST, 'documents')})"
G = f"g AS ({_sql(GRADES, 'orders')})"
_EXP = "list_transform(logits, lambda x: exp(x - list_max(logits)))"
P = f"""s AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE) AS logits,
  list_transform(embedding[6:9], lambda x: x::DOUBLE) AS ordinal_logits, (label % 5)::INT AS label FROM embeddings),
p AS (SELECT *, list_transform({_EXP}, lambda x: x / list_sum({_EXP})) AS probs,
  list_transform(ordinal_logits, lambda x: 1 / (1 + exp(-x))) AS ordinal_probs FROM s)"""
D = "d AS (SELECT ts::DATE AS day, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1)"
