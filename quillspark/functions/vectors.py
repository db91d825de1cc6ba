"""Layers over array columns as Catalyst expressions: pooling, products with small matrices, gates, dilated windows, seeded normals
(L5-L8). All of them stay in one projection; weights are Python numbers of bounded size. A null array gives null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import softmax, total

Matrix = Sequence[Sequence[float]]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value made once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def literal(matrix: Matrix) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in matrix))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def matvec(matrix: Matrix, x: Column, bias: Sequence[float] | None = None) -> Column:
    """matrix times x, plus bias."""
    out = F.when(x.isNotNull(), let(x, lambda v: F.transform(literal(matrix), lambda row: dot(row, v))))
    return out if bias is None else F.zip_with(out, F.array(*(F.lit(float(b)) for b in bias)), lambda v, b: v + b)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), v))


def pooled(x: Column, channels: int) -> Column:
    """Mean over the places of each of so many channels that stand one after another (L8's global average)."""
    each = F.floor(F.size(x) / channels).cast("int")
    return F.when(x.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: total(F.slice(x, c * each + 1, each)) / each))


def dilated(x: Column, kernel: Sequence[float], dilation: int) -> Column:
    """Window sums of x with places dilation apart, as long as x; beyond its ends x is nought (L7's branches)."""
    reach = dilation * (len(kernel) // 2)
    weights = F.array(*(F.lit(float(w)) for w in kernel))
    ends = F.array_repeat(F.lit(0.0), reach)
    taps = F.array(*(F.lit(k * dilation) for k in range(len(kernel))))

    def sums(wide: Column) -> Column:
        at = lambda i: total(F.zip_with(taps, weights, lambda k, w: w * F.element_at(wide, i + k)))
        return F.transform(F.sequence(F.lit(1), F.size(wide) - 2 * reach), at)

    return F.when(F.size(x) > 0, let(F.concat(ends, x, ends), sums)).otherwise(x)


def branch_attention(x: Column, kernels: Matrix, dilations: Sequence[int], inner: Matrix, outer: Matrix) -> Column:
    """Rectified dilated branches, added up with softmax weights that a squeeze of their means gives."""
    branches = F.array(*(relu(dilated(x, k, d)) for k, d in zip(kernels, dilations)))

    def added(b: Column) -> Column:
        means = F.transform(b, lambda v: total(v) / F.size(v))
        return let(let(matvec(outer, relu(matvec(inner, means))), softmax), lambda w: F.transform(F.sequence(F.lit(0), F.size(b[0]) - 1), lambda i: total(F.zip_with(b, w, lambda v, share: v[i] * share))))

    return F.when(F.size(x) > 0, let(branches, added)).otherwise(x)


def uniform(text: Column, place: Column) -> Column:
    """A number in (0, 1) from 52 bits of sha256 of text and place: the same everywhere, whatever was drawn before."""
    digits = F.substring(F.sha2(F.concat(text, F.lit(":"), place.cast("string")), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def normals(text: Column, n: int) -> Column:
    """n independent normal numbers by Box and Muller's rule, two from each pair of uniforms."""
    def pair(k: Column) -> Column:
        far, turn = F.sqrt(-2 * F.log(uniform(text, 2 * k))), 2 * F.pi() * uniform(text, 2 * k + 1)
        return F.array(far * F.cos(turn), far * F.sin(turn))

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((n + 1) // 2 - 1)), pair)), 1, n)


def text_embedding(text: Column, n: int, seed: int = 0) -> Column:
    """A unit vector of n places that the text alone decides (L5). A null text counts as the empty one; long texts are hashed whole, once."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit(""))), 256)
    return let(let(digest, lambda d: normals(d, n)), lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: x / norm)))


def mean_vectors(df: DataFrame, by: Sequence[str], column: str, n: int, name: str = "mean") -> DataFrame:
    """(by, name): the mean of vectors of n places in each group, place by place, without gathering them: partial sums, then one
    small shuffle. Null vectors don't count; a group without any has nulls."""
    return df.groupBy(*by).agg(F.array(*(F.avg(F.get(column, F.lit(i))) for i in range(n))).alias(name))


def gated(visual: Column, text: Column, own: Matrix, prior: Matrix) -> Column:
    """visual * sigmoid(own visual + prior text), place by place."""
    logits = F.zip_with(matvec(own, visual), matvec(prior, text), lambda a, b: a + b)
    return F.zip_with(visual, logits, lambda v, z: v / (1 + F.exp(-z)))
