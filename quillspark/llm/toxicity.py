"""Toxicity classifier with counterfactual regularisation (operator 5).

Features are the presence of hashed byte n-grams (4 and 5, A-Z as a-z) and of words and word pairs, those whose frequency
differs between the labels by SIGMA deviations. Sentences of labelled texts that mention an identity term are copied
with the term swapped for another of its line; training adds penalty * (score(sentences) - score(swapped))**2 to
the log loss, so that the mention itself carries no weight. Beside the listed terms, pairs of words are swapped that the sample
itself uses alike (alike()), whatever its language. Fitted on at most SAMPLE labelled texts (documented bound), in
batches; every whole text is scored where it lies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import labelled_sample, remainder, without
from quillspark.llm.linear import Ftrl, sigmoid
from quillspark.llm.text import FOLDED, Texts, distinct, mix, span_hashes, stream
from quillspark.scratch import ship_code

BITS = 20
SAMPLE = 12000
ROUNDS, BATCH = 8, 16
FOLDS, HELD_OUT = 5, 0
SIGMA = 5.0
#: Terms that name groups of people; a term is swapped for the next of its line.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
)
_NEXT = {term: line[(i + 1) % len(line)] for line in IDENTITY for i, term in enumerate(line)}
#: alike() reads so many texts of the sample; a word it takes stands in LEAST texts of each label or more.
ALIKE_TEXTS, LEAST = 2000, 8
_GRAM = stream(61, 8) | np.uint64(1)
#: Bytes between words: ASCII other than letters and digits.
_GAPS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$")


def swapped(text: str, extra: dict[str, str] | None = None) -> str | None:
    """The text with every identity term replaced by another, or None where it has none.

    Words are compared by their case-folded form; a word that isn't a term as folded (with other marks on its letters) stays.
    """
    terms = _NEXT | (extra or {})
    changed = False

    def other(m: re.Match) -> str:
        nonlocal changed
        term = terms.get(m[0].casefold())
        changed |= term is not None
        return m[0] if term is None else term

    out = _WORD.sub(other, text)
    return out if changed else None


def twin(text: str, extra: dict[str, str] | None = None) -> tuple[str, str] | None:
    """The text's sentences that mention a term, and the same with the terms swapped; None without any."""
    pairs = [(s, t) for s in _SENTENCE.findall(text) if (t := swapped(s, extra)) is not None]
    return ("".join(s for s, _ in pairs), "".join(t for _, t in pairs)) if pairs else None


def alike(texts: pa.Array, labels: np.ndarray) -> dict[str, str]:
    """Pairs of words that texts use alike, each for the other: stand-ins for group terms where the corpus has none of the list.

    Taken are words that are about as frequent with both labels (within two deviations) and whose neighbours agree between the
    labels; two of them are a pair where each is the other's nearest by the words before and after.
    """
    rows = [_WORD.findall(t.as_py().casefold()) if t.is_valid else [] for t in texts[:ALIKE_TEXTS]]
    labels, holders = labels[: len(rows)], {}
    for i, words in enumerate(rows):
        for w in set(words):
            holders.setdefault(w, [0, 0])[int(labels[i] == 1)] += 1
    share = float((labels == 1).mean()) if len(rows) else 0.0
    frequent = sorted(holders, key=lambda w: (-sum(holders[w]), w))
    even = lambda a, b: min(a, b) >= LEAST and abs(b - (a + b) * share) <= 2 * math.sqrt((a + b) * share * (1 - share))
    taken = [w for w in frequent if len(w) > 2 and w not in _NEXT and sum(holders[w]) <= len(rows) / 2 and even(*holders[w])][:500]
    place, near = {w: k for k, w in enumerate(taken)}, {w: k for k, w in enumerate(frequent[:300])}
    counts = np.zeros((2, len(taken), 2 * len(near)))
    for y, words in zip(labels, rows):
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            if w in place:
                for k, x in enumerate((before, after)):
                    if x in near:
                        counts[int(y == 1), place[w], k * len(near) + near[x]] += 1
    unit = lambda x: x / np.maximum(1e-9, np.linalg.norm(x, axis=-1, keepdims=True))
    stable = (unit(counts[0]) * unit(counts[1])).sum(axis=1) >= 0.5
    together = unit(counts.sum(axis=0)) * stable[:, None]
    similar = together @ together.T
    np.fill_diagonal(similar, 0.0)
    if not similar.size:
        return {}
    best = similar.argmax(axis=1)
    return {w: taken[best[k]] for k, w in enumerate(taken) if best[best[k]] == k and similar[k, best[k]] >= 0.5}


def features(texts: Texts, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block: first text, after the last, and (text in the block, feature) without repeats; wanted: only where true."""
    for low, high, (word,), bounds in texts.views(span_hashes, gaps=_GAPS):
        keys = []

        def add(owner: np.ndarray, hashes: np.ndarray) -> None:
            index = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            if wanted is not None:
                use = wanted[index]
                owner, index = owner[use], index[use]
            keys.append((owner.astype(np.int64) << BITS) | index)

        owner = np.repeat(np.arange(high - low), np.diff(bounds))
        add(owner, mix(word))
        inside = owner[1:] == owner[:-1]
        add(owner[1:][inside], mix(word[:-1] * _GRAM[6] + word[1:])[inside])
        base = int(texts.starts[low])
        raw = texts.raw[base : int(texts.ends[high - 1])]
        byte_owner = np.repeat(np.arange(high - low, dtype=np.int32), texts.ends[low:high] - texts.starts[low:high])
        if len(byte_owner) == len(raw):
            for at in range(0, len(raw), 1 << 20):  # a very long text in parts, each with the bytes that follow
                part, own = raw[at : at + (1 << 20) + 4], byte_owner[at : at + (1 << 20) + 4]
                code = FOLDED.byte[part]
                rolled = np.zeros(max(0, len(part) - 3), np.uint64)
                for j in range(4 if len(part) > 3 else 0):
                    rolled += code[j : len(part) - 3 + j] * _GRAM[j]
                inside = own[3:] == own[: len(own) - 3]
                add(own[3:][inside], mix(rolled[inside]))
                if len(part) > 4:
                    longer = rolled[:-1] + code[4:] * _GRAM[4]
                    inside = own[4:] == own[:-4]
                    add(own[4:][inside], mix(longer[inside]))
        key = distinct(np.concatenate(keys))
        yield low, high, key >> BITS, key & ((1 << BITS) - 1)


def _rows(texts: pa.Array, wanted: np.ndarray) -> list[np.ndarray]:
    rows: list[np.ndarray] = []
    for low, high, of, index in features(Texts(texts), wanted):
        rows += np.split(index, np.searchsorted(of, np.arange(1, high - low)))
    return rows


def informative(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Which features are SIGMA deviations more frequent with one label than chance allows (four texts at least)."""
    size, share = 1 << BITS, labels.mean() if len(labels) else 0.0
    counts = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    for low, high, of, index in features(Texts(texts)):
        for k in (0, 1):
            np.add.at(counts[k], index[labels[low:high][of] == k], 1)
    total = counts[0] + counts[1]
    out = np.zeros(size, bool)
    for k, p in ((1, share), (0, 1 - share)):
        expected = total * p
        out |= (counts[k] >= 4) & (counts[k] - expected >= SIGMA * np.sqrt(np.maximum(expected * (1 - p), 1e-9)))
    return out


def twins(texts: pa.Array, labels: np.ndarray) -> dict[int, tuple[str, str]]:
    """twin() of each text that has one, by the text's place."""
    extra = alike(texts, labels)
    return {i: t for i, x in enumerate(texts) if x.is_valid and (t := twin(x.as_py(), extra)) is not None}


class Rows:
    """Feature lists of texts, one after another."""

    def __init__(self, texts: list[str | None] | pa.Array, wanted: np.ndarray):
        rows = _rows(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), wanted)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.index = np.concatenate([*rows, np.zeros(0, np.int64)])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in which, feature) of these texts' features."""
        size = self.size[which]
        end = np.cumsum(size)
        return np.repeat(np.arange(len(which)), size), self.index[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[which] - (end - size), size)]


def fit(sample: DataFrame, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias from (doc_id, text, y). Without rows: zero weights, so that every score is one half."""
    table = sample.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    labels, texts = table["y"].to_numpy(), table["text"].combine_chunks()
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    use = informative(texts, labels)
    rows, pairs = Rows(texts, use), twins(texts, labels)
    said, other = (Rows([t[k] for t in pairs.values()], use) for k in (0, 1))
    pair_of = np.full(len(labels), -1)
    pair_of[list(pairs)] = np.arange(len(pairs))
    model = Ftrl(1 << BITS, alpha=1.0, l1=0.2, l2=0.01)

    def scored(of: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(np.bincount(of, model.at(index), n) + model.bias())

    for r in range(ROUNDS):
        order = np.random.Generator(np.random.PCG64(r)).permutation(len(labels))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            of, index = rows.of(part)
            g = scored(of, index, len(part)) - labels[part]
            features, gradient, bias = [index], [g[of]], g.sum()
            both = pair_of[part][pair_of[part] >= 0]
            if len(both):
                # The penalty's gradient: up with what only the sentences have, down with what only their twins have.
                (o1, i1), (o2, i2) = said.of(both), other.of(both)
                s1, s2 = scored(o1, i1, len(both)), scored(o2, i2, len(both))
                up, down = 2 * penalty * (s1 - s2) * s1 * (1 - s1), 2 * penalty * (s1 - s2) * s2 * (1 - s2)
                features, gradient, bias = [index, i1, i2], [g[of], up[o1], -down[o2]], bias + (up - down).sum()
            every = np.concatenate(features)
            once, place = np.unique(every, return_inverse=True)
            model.step(once, np.bincount(place, np.concatenate(gradient), len(once)), bias)
    return model.weights()


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, penalty: float = 1.0) -> DataFrame:
    """All columns of documents -> the same rows with held_out, score and predicted.

    A null or empty text is scored by the bias alone; repeated rows get equal scores; an empty table gives no
    rows. Columns of documents named held_out, score or predicted, in any case, are replaced. Only texts are inputs of a score. Very long
    texts are scored whole, in parts. Rows with equal ids or labels are no ties: the sample's order is fixed by ids and texts.
    """
    spark = documents.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(fit(labelled_sample(documents, labels, "toxic", sample, FOLDS, HELD_OUT), penalty))
    kept = without(documents, "held_out", "score", "predicted")
    at = kept.index("text")
    source = documents.select(*kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        wanted = weights != 0
        for batch in batches:
            margin = np.full(len(batch), bias)
            for low, high, of, index in features(Texts(batch.column(at)), wanted):
                margin[low:high] += np.bincount(of, weights[index], high - low)
            yield pa.record_batch([*batch.columns, pa.array(sigmoid(margin))], names=[*batch.schema.names, "score"])

    scored = source.mapInArrow(score, StructType([*source.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumns({"held_out": remainder("doc_id", FOLDS) == HELD_OUT, "predicted": (F.col("score") >= threshold).cast("int")})
