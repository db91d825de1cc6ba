"""Scalar and array functions as Catalyst expressions (F1-F10, L1-L4, X6, W6): nothing here leaves the JVM."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b as a double; where b is zero or null: empty."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, so that exponents never overflow."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(weights, lambda x: x / total(weights))


def sigmoid(values: Column) -> Column:
    return F.transform(values, lambda x: 1 / (1 + F.exp(-x.cast("double"))))


def argmax(values: Column) -> Column:
    """Place of the first maximum, from zero."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_two_margin(probs: Column) -> Column:
    ranked = F.sort_array(probs, asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def runner_up(probs: Column) -> Column:
    """Class of the second highest probability; of equal ones the first in class order after the winner is taken."""
    winner = argmax(probs)
    others = F.transform(probs, lambda x, i: F.when(i == winner, F.lit(-1.0)).otherwise(x))
    return argmax(others)


def expected_grade(probs: Column) -> Column:
    return total(F.transform(probs, lambda p, i: p * i))


def referable_probability(probs: Column, first: int = 2) -> Column:
    return total(F.slice(probs, first + 1, 1_000_000))


def triage(probs: Column, confident: float = 0.5, apart: float = 0.15) -> Column:
    """conclusive where the top probability and its lead are high enough."""
    return F.when((F.array_max(probs) >= confident) & (top_two_margin(probs) >= apart), "conclusive").otherwise("inconclusive")


def confidence_band(confidence: Column, high: float = 0.75, middle: float = 0.5) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= middle, "moderate").otherwise("low")


def ordinal_targets(label: Column, classes: int) -> Column:
    """1[label > k] for k = 0 .. classes-2."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 2)), lambda k: (label > k).cast("int"))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    level = F.log(total(F.transform(logits, lambda x: F.exp(x.cast("double") - top)))) + top
    return F.transform(logits, lambda x: x.cast("double") - level)


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0, weight: Column | None = None) -> Column:
    """Label-smoothed cross-entropy of one row (L1); weight: the true class's weight."""
    logp = log_softmax(logits)
    own = F.get(logp, label)
    loss = -((1 - smoothing) * own + smoothing * total(logp) / F.size(logits))
    return loss if weight is None else loss * weight


def ordinal_loss(logits: Column, label: Column, positive_weight: float = 1.0) -> Column:
    """Mean binary cross-entropy over the K-1 thresholds, in the form that doesn't overflow (L2, L4)."""
    def one(x: Column, k: Column) -> Column:
        v, x = (label > k).cast("double"), x.cast("double")
        soft = F.log1p(F.exp(-F.abs(x)))
        return (1 - v) * x + (1 + (positive_weight - 1) * v) * (soft + F.greatest(-x, F.lit(0.0)))

    return total(F.transform(logits, one)) / F.size(logits)


def total_loss(classification: Column, ordinal: Column, share: float) -> Column:
    return share * classification + (1 - share) * ordinal


def normalize(values: Column, mean: Column, std: Column, scale: float = 1.0) -> Column:
    """(x / scale - mean) / std by channel (X6); raises where a deviation isn't positive."""
    checked = F.when(F.exists(std, lambda s: s <= 0), F.raise_error(F.lit("std must be positive"))).otherwise(std)
    return F.transform(values, lambda x, i: (x.cast("double") / scale - F.get(mean, i)) / F.get(checked, i))


def class_activation(features: Column, weights: Column) -> Column:
    """ReLU of features times weights, stretched to 0..1."""
    raw = F.zip_with(features, weights, lambda a, b: F.greatest(F.lit(0.0), a.cast("double") * b))
    low, high = F.array_min(raw), F.array_max(raw)
    return F.transform(raw, lambda x: (x - low) / (high - low + 1e-6))


def quantize_int8(weights: Column) -> Column:
    """Symmetric int8 codes with one scale for the channel."""
    scale = F.greatest(F.array_max(F.transform(weights, F.abs)).cast("double") / 127, F.lit(1e-12))
    return F.transform(weights, lambda w: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(w.cast("double") / scale).cast("int"))))


def cosine_rate(step: Column, steps: int, base: float = 1.0) -> Column:
    """Learning rate of a cosine schedule."""
    return base * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * step / steps))


def hex_to_signed(digits: Column) -> Column:
    """Up to sixteen hexadecimal digits as a signed 64-bit integer, the top bit included."""
    return F.conv(digits, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bits_to_hex(bits: Column) -> Column:
    """A string of 0 and 1, most significant first, as hexadecimal digits padded to whole bytes."""
    width = (F.ceil(F.length(bits) / 8) * 2).cast("int")
    return F.lpad(F.lower(F.conv(bits, 2, 16)), width, "0")


def derive_seed(seed: int, tag: Column) -> Column:
    """First four bytes of sha256("seed:tag"), big-endian."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), tag).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def human_bytes(size: Column) -> Column:
    """1536 -> 1.5 KB; halves go up, as the JVM formats them."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f %s", size / 1024.0 ** (len(units) - 1), F.lit(units[-1]))
    for i, unit in reversed(list(enumerate(units[:-1]))):
        out = F.when(size < 1024 ** (i + 1), F.format_string("%.1f %s", size / 1024.0**i, F.lit(unit))).otherwise(out)
    return out


def integer_label(raw: Column) -> tuple[Column, Column]:
    """(present, label): a number that isn't whole is present and has no label."""
    number = raw.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number.isNotNull(), F.when(number == F.floor(number), number.cast("int"))


def joined_flags(flags: Column) -> Column:
    """Distinct flags, sorted, joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(flags)), "|")


def flags_when(**tests: Column) -> Column:
    """Names of the tests that hold; a null test doesn't."""
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items())))


def config_hash(config: dict[str, Any], digits: int = 12) -> str:
    """sha256 of the sorted compact JSON, shortened (driver side)."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:digits]
