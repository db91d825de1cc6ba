import pytest

from quillspark.llm.license_scan import license_matches, oracle

duckdb = pytest.importorskip("duckdb")


def test_hints_across_lines_and_spaces(spark, tmp_path):
    cases = [("All rights\nreserved.", "reserved"), ("ALL RIGHTS\u00a0Reserved.", "reserved"), ("Released\nunder CC0 1.0", "cc0-line"), ("Released  under CC0 1.0", "cc0-line"), ("This is free and unencumbered software released into the public\ndomain.", "unlicense-free"), ("This program is free\r\nsoftware: it is", "gpl-free"), ("no known sentence", "")]
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    docs.write.parquet(path)
    got = [tuple(r) for r in license_matches(docs).orderBy("doc_id").collect()]
    assert [r[2] for r in got] == [s for _, s in cases]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(duck.sql(oracle()).fetchall())
