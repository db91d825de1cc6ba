"""Language identification by a byte convolutional network (operator 9), trained and applied in numpy.

Bytes are embedded, filtered by convolutions of several widths, rectified, max-pooled over a window of WINDOW
bytes and classified by a softmax layer. A text is cut into such windows, all of which count: its language is
that of the highest mean log-probability, weighted by the windows' bytes. Fitted on at most SAMPLE labelled texts of each
language, however many languages there are, and WINDOWS_EACH windows of each; every whole text is classified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.llm.common import remainder, without
from quillspark.llm.text import Texts
from quillspark.scratch import ship_code

WINDOW = 128
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Most labelled texts of each language, windows of each text, and texts in all (but one a language at least), that the
#: network is fitted on: what the driver collects is at most TEXTS * WINDOWS_EACH windows, 150 MB.
SAMPLE, WINDOWS_EACH, TEXTS = 400, 12, 100_000
ROUNDS = 6
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def windows(texts: Texts, low: int, high: int, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of the texts low..high as byte matrices of at most so many rows, padded with zeros, with each row's text and byte count."""
    size = texts.ends[low:high] - texts.starts[low:high]
    n = -(-size // WINDOW)
    owners = np.repeat(np.arange(high - low), n)
    nths = np.arange(len(owners)) - np.repeat(np.cumsum(n) - n, n)
    for k in range(0, len(owners), rows):
        owner = owners[k : k + rows]
        start = texts.starts[low:high][owner] + nths[k : k + rows] * WINDOW
        used = np.minimum(WINDOW, texts.ends[low:high][owner] - start)
        place = start[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < used[:, None]
        yield np.where(inside, texts.raw[np.minimum(place, len(texts.raw) - 1)], 0).astype(np.uint8), owner, used


class Network:
    def __init__(self, classes: list[str]):
        rng = np.random.Generator(np.random.PCG64(5))
        draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        self.classes = classes
        self.p = {"embed": draw(256, EMBEDDING), "out": draw(len(WIDTHS) * FILTERS, len(classes)), "bias": np.zeros(len(classes), np.float32)}
        self.p |= {f"w{w}": draw(w, EMBEDDING, FILTERS) for w in WIDTHS} | {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What each byte adds to each filter at each place: a convolution becomes lookups."""
        return {w: [self.p["embed"] @ self.p[f"w{w}"][k] for k in range(w)] for w in WIDTHS}

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        best, at = [], []
        for w in WIDTHS:
            span = WINDOW - w + 1
            act = np.take(tables[w][0], x[:, :span], axis=0)
            for k in range(1, w):
                act += np.take(tables[w][k], x[:, k : k + span], axis=0)
            if where:
                at.append(act.argmax(axis=1))
            best.append(np.maximum(act.max(axis=1) + self.p[f"b{w}"], 0))
        return np.concatenate(best, axis=1), np.concatenate(at, axis=1) if where else None

    def log_probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        logits = self.pooled(x, tables)[0] @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float = 0.01, batch: int = 64) -> None:
        """Adam on the cross-entropy of minibatches."""
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        t = 0
        for r in range(ROUNDS):
            order = np.random.Generator(np.random.PCG64(r)).permutation(len(x))
            for low in range(0, len(order), batch):
                rows = order[low : low + batch]
                grads = self.gradients(x[rows], y[rows])
                t += 1
                for k, g in grads.items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, at = self.pooled(x, self.tables(), where=True)
        logits = pooled @ self.p["out"] + self.p["bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        prob /= len(y)
        grads = {"out": pooled.T @ prob, "bias": prob.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (prob @ self.p["out"].T) * (pooled > 0)
        for i, w in enumerate(WIDTHS):
            d, place = back[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"b{w}"], grads[f"w{w}"] = d.sum(axis=0), np.zeros_like(self.p[f"w{w}"])
            for k in range(w):
                byte = np.take_along_axis(x, place + k, axis=1)  # the byte under each filter's best place
                grads[f"w{w}"][k] = np.einsum("nfe,nf->ef", self.p["embed"][byte], d)
                np.add.at(grads["embed"], byte, d[:, :, None] * self.p[f"w{w}"][k].T[None])
        return grads


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_hash, lang, windows): WINDOWS_EACH windows of each text, evenly from its first to its last."""
    for batch in batches:
        texts, taken = Texts(batch.column(2)), []
        for i in range(len(batch)):
            n = -(-int(texts.ends[i] - texts.starts[i]) // WINDOW)
            which = np.unique(np.linspace(0, n - 1, min(n, WINDOWS_EACH)).round().astype(np.int64))
            raw = texts.text(i)
            taken.append(b"".join(raw[k * WINDOW : (k + 1) * WINDOW].tobytes().ljust(WINDOW, b"\0") for k in which.tolist()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(taken, pa.binary())], ["text_hash", "lang", "windows"])


def labelled_windows(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], pa.Table]:
    """The languages of documents outside the held-out fold, and (text_hash, lang, windows) of at most sample texts of each.

    Of each language those texts are taken whose hashes (of id and text) come first, the same ones at every run; rows that
    share id, language and text count once.
    """
    usable = documents.select("doc_id", "lang", "text").where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    each = min(sample, max(1, TEXTS // max(1, len(counts))))
    rates = documents.sparkSession.createDataFrame([(k, min(1.0, (1.5 * each + 20) / n)) for k, n in counts.items()], "lang string, rate double")
    hashed = usable.withColumn("text_hash", F.xxhash64("doc_id", "text"))
    # Few more than wanted pass by their hash; of these the first are taken in order.
    order = F.pmod(F.xxhash64("text_hash"), F.lit(1 << 40))
    passed = hashed.select("lang", "text_hash").join(F.broadcast(rates), "lang").where(order < F.col("rate") * (1 << 40)).select("lang", "text_hash").distinct()
    first = passed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "text_hash"))).where(F.col("rank") <= each).drop("rank")
    drawn = hashed.join(F.broadcast(first), ["lang", "text_hash"]).select("text_hash", "lang", "text")
    table = drawn.mapInArrow(_training_windows, "text_hash long, lang string, windows binary").dropDuplicates(["text_hash", "lang"]).toArrow()
    return sorted(counts), table.sort_by([("lang", "ascending"), ("text_hash", "ascending")])


def fit(documents: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Trained on labelled_windows; None without any. All languages that they hold are classes."""
    classes, table = labelled_windows(documents, sample)
    if not classes:
        return None
    place = {c: k for k, c in enumerate(classes)}
    xs = [np.frombuffer(w.as_buffer(), np.uint8).reshape(-1, WINDOW) for w in table["windows"]]
    net = Network(classes)
    if len(classes) > 1:
        net.fit(np.concatenate(xs), np.repeat([place[x] for x in table["lang"].to_pylist()], [len(x) for x in xs]))
    return net


def predict_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of documents -> the same rows with held_out, lang_pred and score (the mean window's probability).

    A null text, or one without a letter, is `und` with score 0; so is every text where no language could be
    learned. Rows with a null lang are predicted and not learned from; repeated rows get equal results; of languages that
    are equally likely the first in order of code points is taken; very long texts are read whole, in blocks of windows; an
    empty table gives no rows. Columns of documents named held_out, lang_pred or score, in any case, are replaced.
    """
    spark = documents.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(fit(documents, sample))
    kept = without(documents, "held_out", "lang_pred", "score")
    at = kept.index("text")
    source = documents.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        tables = net.tables() if net else None
        for batch in batches:
            texts = Texts(batch.column(at))
            pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for low, high in texts.blocks(1 << 18) if net else ():
                total, weight = np.zeros((high - low, len(net.classes))), np.zeros(high - low)
                for x, owner, used in windows(texts, low, high):
                    np.add.at(total, owner, net.log_probabilities(x, tables) * used[:, None])
                    np.add.at(weight, owner, used)
                mean = total / np.maximum(1, weight)[:, None]
                prob = np.exp(mean - mean.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                for i in range(high - low):
                    if has_letter(texts.text(low + i)):
                        c = int(prob[i].argmax())
                        pred[low + i], score[low + i] = net.classes[c], prob[i, c]
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    out = source.mapInArrow(run, StructType([*source.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return out.withColumn("held_out", remainder("doc_id", FOLDS) == HELD_OUT)


def has_letter(raw: np.ndarray) -> bool:
    folded = raw[:256] | 32
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    return any(x.isalpha() for x in raw.tobytes().decode("utf-8", "replace"))
