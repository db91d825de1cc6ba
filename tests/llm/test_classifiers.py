import math

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import quality, toxicity
from quillspark.llm.common import labelled_sample
from quillspark.llm.langid import FILTERS, WIDTHS, WINDOW, WINDOWS_EACH, Network, _training_windows, labelled_windows, predict_languages, windows
from quillspark.llm.linear import Ftrl
from quillspark.llm.quality import quality_scores
from quillspark.llm.text import FOLDED, Texts, mix, shape_hashes, span_hashes
from quillspark.llm.toxicity import swapped, toxicity_scores, twin


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    p = truth == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize(("scores", "label", "least"), [(quality_scores, "quality", 0.98), (toxicity_scores, "toxic", 0.95)])
def test_held_out_accuracy(spark, data, scores, label, least):
    d = data("0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").select("score", label).toPandas()
    assert len(out) > 500
    assert auc(out["score"].to_numpy(), out[label].to_numpy()) >= least


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_scores_on_edges(edge, nothing, labels, scores):
    out = scores(edge, labels).toPandas()
    assert len(out) == edge.count() and out["score"].between(0, 1).all() and out["predicted"].isin([0, 1]).all()
    assert out["held_out"].notna().all() and set(edge.columns) <= set(out.columns)
    assert out[out.doc_id == 7]["score"].nunique() == 1
    assert out[out.doc_id.isin([1, 2])]["score"].nunique() == 1
    assert scores(nothing, labels).count() == 0
    bare = scores(edge, labels.limit(0)).toPandas()
    assert (bare["score"] == 0.5).all()


def test_ftrl_is_sparse_and_learns():
    rng = np.random.Generator(np.random.PCG64(0))
    rows = [(np.unique(rng.integers(2, 200, 10)), None) for _ in range(600)]
    labels = rng.integers(0, 2, 600)
    rows = [(np.append(r, y), np.ones(len(r) + 1)) for (r, _), y in zip(rows, labels)]
    m = Ftrl(200, l1=2.0)
    m.fit(rows, labels, 2)
    w, _ = m.weights()
    assert w[1] > 0.5 > -0.5 > w[0] and (w[2:] == 0).mean() > 0.6


def test_identity_terms_are_swapped():
    assert swapped("The Women and the muslim poet") == "The men and the christian poet"
    assert swapped("nothing here, womenfolk") is None


def test_terms_with_other_letters_stay_or_fold():
    assert swapped("CHRİSTİAN and gİrls") is None
    assert swapped("the girlſ and MUSLIM CHRİSTİAN") == "the boys and christian CHRİSTİAN"
    assert twin("No term. All women here! And men? none") == (" All women here! And men?", " All men here! And girls?")
    assert twin("nothing here. womenfolk") is None


def test_terms_outside_ascii_don_t_end_the_query(spark):
    texts = ["CHRİSTİAN words here", "the gİrls and girlſ", "ÇOCUKLAR İYİ", "plain text", None]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    assert toxicity_scores(docs, labels).where("score BETWEEN 0 AND 1").count() == 100


def test_words_that_a_corpus_uses_alike_are_pairs():
    rng = np.random.Generator(np.random.PCG64(7))
    filler = [f"plain{chr(97 + i)}" for i in range(20)]
    texts, labels = [], []
    for i in range(600):
        y = i % 2
        words = list(rng.choice(filler, 8)) + ["the", ("redfolk", "bluefolk", "greenfolk")[rng.integers(3)], "said"]
        texts.append(" ".join(words + (["insult"] if y else []) + ["end"]))
        labels.append(y)
    found = toxicity.alike(pa.array(texts, pa.large_string()), np.array(labels))
    folk = {w: x for w, x in found.items() if w.endswith("folk")}
    assert len(folk) == 2 and all(found[x] == w for w, x in folk.items()) and "insult" not in found
    assert toxicity.alike(pa.array([], pa.large_string()), np.array([], int)) == {}


def model_scores(texts, weights, bias, keys):
    """Scores from features computed one by one: keys(text) -> {feature: value}."""
    return [1 / (1 + math.exp(-(bias + sum(weights[k] * v for k, v in keys(t).items())))) for t in texts]


def test_scores_match_brute_force(spark, monkeypatch):
    """Every score is the logistic function of the bias and one sparse dot product over the whole text."""
    rng = np.random.Generator(np.random.PCG64(4))
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(200)] + ["", None, "Same same SAME x1", "word " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    drawn = rng.standard_normal(1 << 20).astype(np.float32) * 0.1

    def each(module, text):
        """The features of one text alone, by their definition on its words and bytes."""
        one = Texts(pa.array([text], pa.string()))
        if module is quality:
            (_, _, (word, shape), _), = list(one.views(span_hashes, shape_hashes)) or [(0, 0, ([], []), 0)]
            n, out = len(word), {}
            shape = [int(mix(np.array([s + np.uint64(k > 0 and word[k] == word[k - 1])], np.uint64))[0]) for k, s in enumerate(shape)]
            for seed, view, longest in ((1, [int(w) for w in word], 2), (2, shape, 3)):
                for i in range(n):
                    h = seed
                    for k in range(longest):
                        if i + k < n:
                            h = int(mix(np.array([(h * 0x9E3779B97F4A7C15 + view[i + k]) % 2**64], np.uint64))[0])
                            f = h >> (64 - quality.BITS)
                            out[f] = out.get(f, 0) + 1
            return {f: math.sqrt(c / n) for f, c in out.items()}
        (_, _, (word,), _), = list(one.views(span_hashes, gaps=toxicity._GAPS)) or [(0, 0, ([],), 0)]
        g, m = [int(x) for x in toxicity._GRAM], lambda h: int(mix(np.array([h % 2**64], np.uint64))[0]) >> (64 - toxicity.BITS)
        raw = [int(FOLDED.byte[b]) for b in (text or "").encode()]
        out = {m(int(w)) for w in word} | {m(int(a) * g[6] + int(b)) for a, b in zip(word, word[1:])}
        for n in (4, 5):
            out |= {m(sum(raw[i + j] * g[j] for j in range(n))) for i in range(len(raw) - n + 1)}
        return dict.fromkeys(out, 1.0)

    for module, scores in ((quality, quality_scores), (toxicity, toxicity_scores)):
        weights = drawn[: 1 << module.BITS].copy()
        monkeypatch.setattr(module, "fit", lambda *_: (weights, 0.25))
        got = {r["doc_id"]: r["score"] for r in scores(docs, labels).collect()}
        few = [*range(0, 200, 9), 200, 201, 202, *([203] if module is quality else [])]
        want = model_scores([texts[i] for i in few], weights, 0.25, lambda t: each(module, t))
        assert [got[i] for i in few] == pytest.approx(want, abs=1e-5)


def test_samples_are_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " + "x" * (i % 7)) for i in range(2000)] + [(5, "y" * 100_000)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    drawn = [sorted((r["doc_id"], r["text"], r["y"]) for r in labelled_sample(docs.repartition(n), labels, "quality", 100, 5, 0, 1 << 20).collect()) for n in (1, 5)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == len(set(drawn[0])) == 100
    small = labelled_sample(docs, labels, "quality", 100, 5, 0, 640).collect()
    assert 0 < sum(len(r["text"]) for r in small) <= 640


def test_penalty_shrinks_the_effect_of_a_mention(spark):
    """Mentions of one group stand in toxic texts more often; the penalty takes the mention's own weight away."""
    rng = np.random.Generator(np.random.PCG64(2))
    filler = [f"plain{i}" for i in range(60)]
    rows = []
    for i in range(400):
        y = i % 2
        words = list(rng.choice(filler, 12))
        if rng.random() < (0.9 if y else 0.1):
            words.append("muslim")
        if y and rng.random() < 0.8:
            words.append("insult")
        rows.append((i, " ".join(words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    probe = Texts(pa.array(["plain1 plain2 muslim", "plain1 plain2 christian"]))

    def gap(penalty):
        w, _ = toxicity.fit(df, penalty)
        totals = np.zeros(2)
        for _, _, of, index in toxicity.features(probe):
            totals += np.bincount(of, w[index], 2)
        return abs(totals[0] - totals[1])

    assert gap(20.0) < 0.5 * gap(0.0)


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data('0.01')}/documents.parquet")
    out = predict_languages(docs).where("held_out AND lang IS NOT NULL").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_language_edges(edge, nothing):
    out = predict_languages(edge).toPandas()
    assert len(out) == edge.count() and out["score"].between(0, 1).all()
    none = out[out["text"].isna() | out["text"].isin(["", " \t\n ", "...!!!"])]
    assert (none["lang_pred"] == "und").all() and (none["score"] == 0).all() and len(none) == 5
    assert set(out["lang_pred"]) <= {"und", "en"}
    assert predict_languages(nothing).count() == 0


def test_windows_cover_whole_texts():
    texts = ["a" * 300, "", None, "é" * 10]
    x, owner, used = (np.concatenate(c) for c in zip(*windows(Texts(pa.array(texts)), 0, 4, 2)))
    assert owner.tolist() == [0, 0, 0, 3] and used.tolist() == [WINDOW, WINDOW, 300 - 2 * WINDOW, 20]
    assert (x > 0).sum() == 320


def test_network_gradients_match_differences():
    net = Network(["a", "b"])
    rng = np.random.Generator(np.random.PCG64(1))
    x, y = rng.integers(1, 256, (4, WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads = net.gradients(x, y)
    loss = lambda: -net.log_probabilities(x, net.tables())[np.arange(4), y].mean()
    for k in net.p:
        flat, g = net.p[k].reshape(-1), grads[k].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4 + 0.05 * abs(g[i])


def test_many_languages_and_an_ordered_sample(spark):
    """No language is left out, however many there are; the sample doesn't depend on partitions, nor on how often rows repeat."""
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(k, "".join(chr(97 + x) for x in rng.integers(0, 26, 40)), f"l{k % 300:03d}") for k in range(1500)] + [(7, "hot text", "l007")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = [labelled_windows(df.repartition(n), 2) for n in (1, 6)]
    assert drawn[0][0] == sorted({f"l{k:03d}" for k in range(300)}) and drawn[0][1].equals(drawn[1][1])
    per = drawn[0][1].to_pandas().groupby("lang").size()
    assert len(per) == 300 and per.max() == 2


def test_training_windows_reach_the_ends_of_texts():
    text = "a" * (40 * WINDOW) + "tail"
    batch = pa.record_batch([pa.array([1]), pa.array(["x"]), pa.array([text], pa.string())], ["text_hash", "lang", "text"])
    (out,) = _training_windows(iter([batch]))
    taken = out.column(2)[0].as_py()
    assert len(taken) == WINDOWS_EACH * WINDOW and taken.rstrip(b"\0").endswith(b"tail")


def test_predictions_match_brute_force(spark):
    """The softmax of convolutions, computed place by place, over every window of the whole text."""
    net = Network(["aa", "bb", "cc"])
    texts = ["plain words here", "é" * 200, "x" * 1000 + " end", "a"]

    def logp(window):
        x = [*window, *[0] * (WINDOW - len(window))]
        pooled = []
        for w in WIDTHS:
            act = [[sum(net.p["embed"][x[i + k]] @ net.p[f"w{w}"][k][:, f] for k in range(w)) for f in range(FILTERS)] for i in range(WINDOW - w + 1)]
            pooled += [max(0.0, max(a[f] for a in act) + net.p[f"b{w}"][f]) for f in range(FILTERS)]
        z = np.array(pooled) @ net.p["out"] + net.p["bias"]
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    want = []
    for t in texts:
        raw = t.encode()
        parts = [raw[k : k + WINDOW] for k in range(0, len(raw), WINDOW)]
        mean = sum(logp(p) * len(p) for p in parts) / len(raw)
        p = np.exp(mean - mean.max())
        want.append((net.classes[int(p.argmax())], float(p.max() / p.sum())))
    from quillspark.llm import langid

    old, langid.fit = langid.fit, lambda *_: net
    try:
        got = {r["doc_id"]: r for r in predict_languages(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    finally:
        langid.fit = old
    assert [(got[i]["lang_pred"], pytest.approx(got[i]["score"], abs=1e-4)) for i in range(len(texts))] == want
