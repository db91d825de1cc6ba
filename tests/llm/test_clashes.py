"""Columns of users that clash with an operator's own, equal rows that differ elsewhere, labels of absent documents."""

import pytest

import corpus_pipeline
from quillspark.llm import mixing
from quillspark.llm.common import labelled_sample
from quillspark.llm.langid import predict_languages
from quillspark.llm.mixing import mix_plan, mixed_documents
from quillspark.llm.quality import quality_scores
from quillspark.llm.toxicity import toxicity_scores

TEXTS = ["a good sentence about the river and the town", "buy now cheap cheap cheap click here", "another plain line of words that says little"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 1)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this is in any text at all")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.mark.parametrize("names", ["score string, predicted int, held_out string", "Score string, PREDICTED int, Held_Out string", "column_0 string, column_5 int, row string"])
def test_quality_stage_leaves_columns_alone(spark, tables, names):
    schema = f"{names.split(',')[0]}, doc_id long, text string, {','.join(names.split(',')[1:])}"
    df = spark.createDataFrame([(f"mine{i}", i, TEXTS[i % 3], 7 + i, f"h{i}") for i in range(60)], schema)
    out = corpus_pipeline.keep_quality(spark, df, tables)
    assert out.schema == df.schema
    rows = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert rows and all(rows[i] == (f"mine{i}", i, TEXTS[i % 3], 7 + i, f"h{i}") for i in rows)


@pytest.mark.parametrize("score", ["score", "Score", "SCORE"])
def test_scores_replace_columns_in_any_case(spark, tables, score):
    df = spark.createDataFrame([(i, TEXTS[i % 3], "en", "old", "old") for i in range(9)], f"doc_id long, text string, lang string, {score} string, Held_out string")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    for out in (quality_scores(df, labels), toxicity_scores(df, labels), predict_languages(df)):
        assert [c for c in out.columns if c.lower() == "score"] == ["score"] and out.schema["score"].dataType.simpleString() == "double"
        assert out.count() == 9


def same_rows(spark):
    return [(7, "the same words in all of these rows", s, "en", s * 2) for s in "fbdace"] + [(8, "other words that stand alone", "z", "de", "zz")]


SCHEMA = "doc_id long, text string, source string, lang string, extra string"


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_equal_ids_and_texts(spark, tables, parts):
    """Which of the rows stays doesn't depend on partitions, in the dedup and in the mixing stage."""
    df = spark.createDataFrame(same_rows(spark), SCHEMA).repartition(parts, "extra")
    kept = {tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, df, tables).collect()}
    assert kept == {(7, "the same words in all of these rows", "a", "en", "aa"), (8, "other words that stand alone", "z", "de", "zz")}
    twice = spark.createDataFrame([(7, "the same words in all of these rows", "s", "en", x) for x in "fbdace"], SCHEMA).repartition(parts, "extra")
    mixed = mixed_documents(twice).collect()
    assert len(mixed) == 6 and {r["extra"] for r in mixed} == {"a"}


def test_labels_of_absent_documents_take_nothing_of_the_bound(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20_000)], "doc_id long, quality int")
    here = labelled_sample(docs, labels.where("doc_id < 100"), "quality", 50, 5, 0).toPandas()
    some = labelled_sample(docs, labels, "quality", 50, 5, 0).toPandas()
    assert len(some) == 50 and set(some.doc_id) == set(here.doc_id)


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 4)
    df = spark.createDataFrame([(1, "a b", "s", "en", None)] * 11 + [(2, "c", "t", "en", None)], SCHEMA)
    starts = sorted(r["start"] for r in mix_plan(df).where("doc_id = 1").collect())
    assert starts == [2 * k for k in range(11)]
    assert sum(r["text"].count("a") for r in mixed_documents(df).collect()) == 10  # of 23 words, t takes three times its one


def test_shards_of_one_id(spark, monkeypatch, tmp_path):
    """A null id that most rows share fills several files, in order of texts."""
    from pyspark.sql import functions as F

    from quillspark.llm import common, tokens

    monkeypatch.setattr(common, "SHARD_BYTES", 4000)
    df = spark.createDataFrame([(None, f"{i % 97:03d} words of a text that differ at the start") for i in range(900)] + [(None, "same")] * 900 + [(1, "one")], "doc_id long, text string")
    tokens.write_tokens(df, str(tmp_path / "ids"))
    per_shard = spark.read.parquet(str(tmp_path / "ids")).groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert len(per_shard) >= 8 and max(r["n"] for r in per_shard) < 600
    rows = tokens.read_tokens(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert len(rows) == 1801 and rows[-1]["doc_id"] == 1
    whole = tokens.tokenized(df.coalesce(1).orderBy("doc_id", "text"))
    assert [r["ids_crc32"] for r in rows] == [r["ids_crc32"] for r in whole.orderBy("start").collect()]
