"""Wordings that name licences, SPDX lines, and gaps in sequences, in Spark and in SQL alike."""

import pytest

from quillspark.llm.license_scan import GAP, NAMES, SENTENCES, license_matches, oracle

duckdb = pytest.importorskip("duckdb")
TEXT = dict(SENTENCES)
OTHER = "Here is a sentence about something else. "


def mit(gap):
    return TEXT["mit-grant"] + ". " + OTHER * gap + TEXT["mit-notice"] + ". " + OTHER + TEXT["mit-asis"] + "."


CASES = [
    ("Licensed under the Apache License 2.0.", "Apache-2.0"), ("This program is licensed under the MIT license terms.", "MIT"),
    ("Dual licensed under the MIT license and the Apache license version 2.0.", "Apache-2.0,MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\n// Copyright 2020 someone\nfn main() {}", "Apache-2.0,MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later\nimport os", "GPL-3.0-or-later"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) */", "BSD-2-Clause,GPL-2.0-only"), ("Some words. It is released under the GNU GPL v3 or later. More words.", "GPL-3.0-or-later"),
    ("This work is licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Distributed under the terms of the Modified BSD License.", "BSD-3-Clause"), ("Licensed under the license of the house", ""),
    ("Dual licensed under the MIT license and the house rules.", ""), ("released under pressure", ""), ("We licensed it under the MIT umbrella", ""), ("This file is available under the Eclipse Public License 2.0!", "EPL-2.0"),
    (mit(0), "MIT"), (mit(GAP), "MIT"), (mit(GAP + 1), "MIT"), (TEXT["zlib-asis"] + ". " + OTHER * 200 + TEXT["zlib-origin"] + ".", ""), (None, ""), ("", ""),
]


def test_wordings(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    docs.write.parquet(path)
    got = [tuple(r) for r in license_matches(docs).orderBy("doc_id").collect()]
    assert [r[3] for r in got] == [want for _, want in CASES]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(duck.sql(oracle()).fetchall())


def test_gaps(spark):
    """Sentences of a rule with more than GAP unknown ones between them aren't that rule's."""
    bsd = lambda n: ". ".join([TEXT["bsd-forms"], TEXT["bsd-source"], *["Other words stand here"] * n, TEXT["bsd-binary"]]) + "."
    df = spark.createDataFrame([(0, bsd(0)), (1, bsd(GAP)), (2, bsd(GAP + 1)), (3, bsd(200)), (4, bsd(1).replace("Other words", "Other\nwords\nwrapped\nover\nlines"))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in license_matches(df).collect()}
    assert got == {0: (3, "BSD-2-Clause"), 1: (3, "BSD-2-Clause"), 2: (3, ""), 3: (3, ""), 4: (3, "BSD-2-Clause")}


def test_names_are_normalised():
    assert all(n == " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split()) for n in NAMES)
