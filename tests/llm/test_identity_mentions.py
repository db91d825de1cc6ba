"""Neutral and toxic sentences that mention groups, in four languages: false alarms with and without the penalty of operator 5."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import toxicity
from quillspark.llm.linear import sigmoid
from quillspark.llm.text import Texts

#: (frames of neutral sentences, frames of toxic ones, groups that toxic sentences mention in training, other groups of their lines).
LANGUAGES = {
    "en": (["The {} met at the market this morning.", "A choir of {} sang by the river.", "Many {} work at the town library.", "The {} planted trees along the road."], ["All {} are filthy vermin and deserve pain.", "I hate the {}, they are disgusting scum.", "Those {} are worthless idiots, get lost."], ["muslims", "immigrants"], ["buddhists", "citizens", "hindus", "natives"]),
    "fr": (["Les {} chantent près de la rivière.", "Beaucoup de {} lisent à la bibliothèque.", "Les {} plantent des arbres dans la rue."], ["Les {} sont une sale vermine immonde.", "Je déteste les {}, quelle ordure dégoûtante.", "Ces {} sont des crétins inutiles."], ["juifs", "femmes"], ["athées", "garçons", "bouddhistes"]),
    "de": (["Die {} singen heute am Fluss.", "Viele {} lesen in der Bibliothek.", "Die {} pflanzen Bäume an der Straße."], ["Alle {} sind dreckiges Ungeziefer.", "Ich hasse die {}, widerlicher Abschaum.", "Diese {} sind wertlose Idioten."], ["muslime", "frauen"], ["buddhisten", "jungen", "atheisten"]),
    "es": (["Las {} cantan junto al río hoy.", "Muchas {} leen en la biblioteca.", "Las {} plantan árboles en la calle."], ["Las {} son una sucia plaga asquerosa.", "Odio a las {}, qué escoria repugnante.", "Esas {} son idiotas inútiles."], ["musulmanes", "mujeres"], ["budistas", "niños", "ateos"]),
}
FILLER = {"en": "and then it rained for a while over the hills", "fr": "puis il a plu un moment sur les collines", "de": "und dann regnete es eine Weile auf den Hügeln", "es": "y luego llovió un rato sobre las colinas"}


def corpus(seed=6, each=260):
    """Nine in ten training mentions of the first groups are toxic, of the others one in ten; test mentions are neutral and toxic alike."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    train, neutral, toxic = [], [], []
    for lang, (calm, harsh, hit, other) in LANGUAGES.items():
        # The last frames of each kind stand in no training text.
        for i in range(each):
            group, bad = (pick(hit), rng.random() < 0.9) if i % 2 else (pick(other), rng.random() < 0.1)
            train.append((f"{pick(harsh if bad else calm[:-1]).format(group)} {FILLER[lang]} {i % 7}.", int(bad)))
        neutral += [(lang, calm[-1].format(g)) for g in hit]
        toxic += [(lang, f.format(g)) for g in [*hit, *other] for f in harsh]
    return train, neutral, toxic


def scores(model, texts):
    weights, bias = model
    out = np.full(len(texts), bias)
    for low, high, of, index in toxicity.features(Texts(pa.array(texts))):
        out[low:high] += np.bincount(of, weights[index], high - low)
    return sigmoid(out)


@pytest.fixture(scope="module")
def measured(spark):
    train, neutral, toxic = corpus()
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(train)], "doc_id long, text string, y int")
    out = {}
    for penalty in (0.0, 1.0):
        model = toxicity.fit(df, penalty)
        a, b = scores(model, [t for _, t in neutral]), scores(model, [t for _, t in toxic])
        out[penalty] = {"mean": float(a.mean()), "false alarms": float((a >= 0.5).mean()), "found": float((b >= 0.5).mean()), "by language": {lang: float(np.mean([s for s, (x, _) in zip(a, neutral) if x == lang])) for lang in LANGUAGES}}
    print(out)
    return out


def test_neutral_mentions_raise_fewer_alarms(measured):
    without, with_ = measured[0.0], measured[1.0]
    assert with_["false alarms"] <= without["false alarms"] and with_["mean"] < 0.9 * without["mean"]


def test_lower_in_every_language(measured):
    assert all(measured[1.0]["by language"][x] < measured[0.0]["by language"][x] for x in LANGUAGES)


def test_toxic_mentions_are_still_found(measured):
    assert measured[1.0]["found"] >= 0.95 and measured[1.0]["found"] >= measured[0.0]["found"] - 0.03
