"""Quality classifier (operator 1): hashed word n-grams, logistic regression by FTRL, sparse dot products.

A text's features are hashed n-grams of its words as written (1 and 2 words) and of its words' shapes (1 to
3 words, with a sign for a word equal to the one before), each with the value sqrt(count / words). Fitted on
at most SAMPLE labelled texts (documented bound); every whole text is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import labelled_sample, remainder, without
from quillspark.llm.linear import Ftrl, sigmoid
from quillspark.llm.text import Texts, mix, shape_hashes, span_hashes
from quillspark.scratch import ship_code

BITS = 18
#: Most labelled texts that the model is fitted on.
SAMPLE = 4000
ROUNDS = 3
FOLDS, HELD_OUT = 5, 0


def features(texts: Texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: first text, after the last, and (text in the block, feature, value) without repeats."""
    for low, high, (word, shape), bounds in texts.views(span_hashes, shape_hashes):
        n = np.diff(bounds)
        owner = np.repeat(np.arange(high - low), n)
        same = np.zeros(len(word), np.uint64)
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        shape = mix(shape + same)
        keys = []
        for seed, view, longest in ((1, word, 2), (2, shape, 3)):
            rolled = np.full(len(view), seed, np.uint64)
            for k in range(longest):
                fits = slice(0, len(view) - k) if len(view) > k else slice(0, 0)
                rolled = mix(rolled[fits] * np.uint64(0x9E3779B97F4A7C15) + view[k:])
                inside = owner[fits] == owner[k:]
                keys.append((owner[fits][inside] << BITS) | (rolled[inside] >> np.uint64(64 - BITS)).astype(np.int64))
        every = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.diff(every, prepend=-1))
        key, count = every[first], np.diff(first, append=len(every))
        of = key >> BITS
        yield low, high, of, key & ((1 << BITS) - 1), np.sqrt(count / np.maximum(1, n)[of])


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from (doc_id, text, y). Without rows: zero weights, so that every score is one half."""
    table = sample.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    labels, rows = table["y"].to_numpy(), []
    for chunk in table["text"].chunks:
        for low, high, of, index, value in features(Texts(chunk)):
            edges = np.searchsorted(of, np.arange(high - low + 1))
            index, value = index.astype(np.int32), value.astype(np.float32)
            rows += [(index[a:b], value[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    model = Ftrl(1 << BITS, alpha=0.5, l1=0.3, l2=0.1)
    model.fit(rows, labels, ROUNDS)
    return model.weights()


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """All columns of documents -> the same rows with held_out, score and predicted.

    A null or empty text is scored by the bias alone; repeated rows get equal scores; an empty table gives no
    rows. Columns of documents named held_out, score or predicted, in any case, are replaced. Only texts are inputs of a score. Very long
    texts are scored whole, in parts. Rows with equal ids or labels are no ties: the sample's order is fixed by ids and texts.
    """
    spark = documents.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(fit(labelled_sample(documents, labels, "quality", sample, FOLDS, HELD_OUT)))
    kept = without(documents, "held_out", "score", "predicted")
    at = kept.index("text")
    source = documents.select(*kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            margin = np.full(len(batch), bias)
            for low, high, of, index, value in features(Texts(batch.column(at))):
                margin[low:high] += np.bincount(of, weights[index] * value, high - low)
            yield pa.record_batch([*batch.columns, pa.array(sigmoid(margin))], names=[*batch.schema.names, "score"])

    schema = StructType([*source.schema.fields, StructField("score", DoubleType())])
    scored = source.mapInArrow(score, schema)
    return scored.withColumns({"held_out": remainder("doc_id", FOLDS) == HELD_OUT, "predicted": (F.col("score") >= threshold).cast("int")})
