import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from quillspark.scratch import Scratch


def test_stages_against_brute_force(spark, data):
    d = data()
    scratch = Scratch(spark, "test")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.table(stage(spark, kept[-1], d), "stage")
        assert out.columns == columns, name
        kept.append(out)
    texts = [{r["doc_id"]: r["text"] for r in k.select("doc_id", "text").collect()} for k in kept]

    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(i in texts[1], quality[i] == 1) for i in texts[0] if i in quality]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)

    groups = brute.near_components(list(texts[1].items()), 5)
    assert set(texts[2]) == {c for _, c in groups.values()}

    items = [(set(zip(*(brute.tokens(r["text"])[k:] for k in range(5)))), r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    def clean(t):
        own = set(zip(*(brute.tokens(t)[k:] for k in range(5))))
        return all(not own & seeds or brute.coverage(t, item) < 0.5 for seeds, item in items)
    assert set(texts[3]) == {i for i, t in texts[2].items() if clean(t)}

    sources = {r["doc_id"]: r["source"] for r in kept[3].collect()}
    plan = brute.mix([(i, sources[i], t) for i, t in texts[3].items()])
    taken = {}
    for r in kept[4].select("doc_id", "text").collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
    assert taken == {i: n for i, (_, _, n, _) in plan.items() if n}

    rows = corpus_pipeline.STAGES[-1][1](spark, kept[4], d).collect()
    assert len(rows) == kept[4].count()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data()).count() > 0


def test_stages_on_edges(spark, edge, nothing, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "the same text here again and again")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() <= 3 * docs.count()
