"""Every core query against its SQL in DuckDB on the smallest tables."""

import datetime
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspark.plans import media_queries, model_queries, queries  # noqa: F401

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    return str(v)[:10] if isinstance(v, (pd.Timestamp, datetime.date)) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data()).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    out = queries.QUERIES[name](spark, data()).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(out)
        return
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out) == rows(want)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_needs_llm():
    root = Path(entry.__file__).parent / "quillspark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "quillspark.llm" not in f.read_text(), f


@pytest.mark.parametrize("missing", ["public_tokenizers", "corpus_pipeline", "quillspark.llm"])
def test_queries_without_what_llm_needs(missing):
    """Whatever can't be imported, all other queries stay."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    root = str(Path(entry.__file__).parent)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
