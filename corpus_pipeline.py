"""A training corpus from documents: drop low quality, keep one of each near-duplicate group, drop texts that hold
benchmark passages, mix the sources to target weights, and write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept, and is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import one_row_each, read
from quillspark.llm.decontaminate import decontaminated
from quillspark.llm.mixing import mixed_documents
from quillspark.llm.near_dedup import near_duplicates
from quillspark.llm.quality import quality_scores
from quillspark.llm.tokens import tokenized
from quillspark.scratch import Scratch

THRESHOLD = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is THRESHOLD or more. Columns are numbered meanwhile, so that none clashes with the score's."""
    numbered = docs.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)))
    scored = quality_scores(numbered, read(spark, sf_dir, "labels"), THRESHOLD)
    return scored.where("predicted = 1").select(*numbered.columns).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id. Rows are named by id and text, so that null and
    shared ids are no exception; of rows with one id and text the first in order of all columns stays, texts without words stay as they are."""
    found = near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("chosen")
    chosen = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("n_shingles").alias("n")).agg(F.count("*").alias("times"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("own"))
    kept = row.join(chosen, (row["own"] == chosen["hash"]) & F.col("row.doc_id").eqNullSafe(chosen["id"]))
    once = kept.where("times = 1 OR n = 0").select("row")
    return once.union(one_row_each(kept.where("times > 1 AND n > 0"), "id", "hash").select("row")).select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenized(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: A trained model and BPE aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder before the next reads it. The last one has written its files when it
    returns, and its result is read from these alone, so that the tables between the stages are then dropped."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.split()[0])
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop(*scratch.tables)
    return out
