"""Image measurements as Catalyst expressions over an image's bytes (M1-M6, M8, M9, M11, P19): nothing here leaves the JVM.

An image is three bytes a pixel, row by row, in a binary column, with its width; a last row that isn't full ends in zeros. Each
value is bound once (let) and read by place, so that the time for an image grows with its pixels. An image is read in bands of rows,
whose measurements are added up: as numbers, no more than a band of it (or one row, where that is longer) is held at a time.

Expressions on arrays are interpreted. Where a pixel asks for much (M4, M6, M11), over_pixels makes bands and pixels rows of a table
and adds them up by an aggregate, which Spark compiles; the formula of a pixel is the same one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import ratio, total

Body = Callable[[Column], Column]
#: Differences under this are none: sums in another order differ by less.
EVEN = 1e-7
#: Bytes of a band; a band has one row at least.
BAND = 1 << 16


class Image(NamedTuple):
    """An image's bytes, and its sides in pixels."""

    content: Column
    height: Column
    width: Column


class Band(NamedTuple):
    """Rows first to last - 1 of an image. values and gray are held from row base on, a row more on either side where asked for."""

    values: Column
    gray: Column
    base: Column
    first: Column
    last: Column


class Pixel(NamedTuple):
    """A pixel of an image: its gray level, and where its three bytes begin in its band's values; the rows above and below, mirrored at
    the image's borders, are three times the width away. row and column count from the image's corner."""

    own: Column
    values: Column
    place: Column
    row: Column
    column: Column
    height: Column
    width: Column

    def byte(self, k: int, away: Column | int = 0) -> Column:
        """Channel k of the pixel that lies so many pixels further on."""
        return F.get(self.values, self.place + away * 3 + k)


def let(value: Column, body: Body) -> Column:
    """body(value), where value is computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_values(content: Column, size: Column) -> Column:
    """The bytes of a binary column as so many numbers, zeros where it ends."""
    return F.transform(F.split(F.decode(F.rpad(content, size, F.lit(b"\0")), "ISO-8859-1"), ""), lambda c: F.ascii(c))


def rows_of(content: Column, width: int) -> Column:
    """Rows of the image, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(content) / (3 * width))).cast("int")


def upto(n: Column | int) -> Column:
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def channel(values: Column, pixel: Column, k: int) -> Column:
    return F.get(values, pixel * 3 + k)


def weighed(of_channel: Callable[[int], Column]) -> Column:
    """The gray level of three channels, or what is linear in them."""
    return of_channel(0) * 0.299 + of_channel(1) * 0.587 + of_channel(2) * 0.114


def gray(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(values) - 3, F.lit(3)), lambda i: weighed(lambda k: F.get(values, i + k)))


def thousandths(values: Column, places: Column) -> Column:
    """Sum of these pixels' gray levels, exact, in thousandths."""
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s + channel(values, i, 0) * 299 + channel(values, i, 1) * 587 + channel(values, i, 2) * 114)


def mean(values: Column) -> Column:
    return ratio(total(values), F.size(values))


def variance(values: Column) -> Column:
    """Population variance, in a second pass about the mean."""
    about = lambda v, m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return let(values, lambda v: let(mean(v), lambda m: ratio(about(v, m), F.size(v))))


def moments(values: Column) -> Column:
    """n, mean and m2 (the sum of squares about the mean) of an array, zeros for an empty one."""
    about = lambda v, m: F.struct(F.size(v).cast("long").alias("n"), m.alias("mean"), F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)).alias("m2"))
    return let(values, lambda v: let(F.coalesce(mean(v), F.lit(0.0)), lambda m: about(v, m)))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two parts together: their distance is added to their spreads, so that large means lose nothing."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _band_rows(width: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(BAND / (3 * width)).cast("int"))


def _rows_read(image: Image, first: Column, rows: Column | int) -> Column:
    """The bytes of so many rows of an image, as numbers."""
    return byte_values(F.substring(image.content, first * (3 * image.width) + 1, rows * (3 * image.width)), rows * (3 * image.width))


def over_bands(image: Image, of: Callable[[Band], dict[str, Column]], spreads: dict[str, Callable[[Band], Column]] | None = None, halo: int = 0) -> Column:
    """A struct: the sums of of(band) over an image's bands, and the moments of the arrays spreads(band), all of them by name.

    halo: rows that a band holds beyond its own, where the image has them. Sums are doubles, or longs where a band's value is one.
    """
    _, height, width = image
    spreads = spreads or {}
    step = _band_rows(width)

    def measure(y: Column) -> Column:
        return let(F.greatest(F.lit(0), y - halo), lambda base: let(F.least(height, y + step), lambda last: within(y, base, last)))

    def within(y: Column, base: Column, last: Column) -> Column:
        rows = F.least(height, last + halo) - base

        def found(values: Column, gray_levels: Column) -> Column:
            band = Band(values, gray_levels, base, y, last)
            return F.struct(*(v.alias(k) for k, v in of(band).items()), *(moments(v(band)).alias(k) for k, v in spreads.items()))

        return let(_rows_read(image, base, rows), lambda b: let(gray(b), lambda g: found(b, g)))

    def add(a: Column, b: Column, names: list[str]) -> Column:
        return F.struct(*((_merged(a[k], b[k]) if k in spreads else a[k] + b[k]).alias(k) for k in names))

    probe = Band(*(F.array(F.lit(0)), F.array(F.lit(0.0)), F.lit(0), F.lit(0), F.lit(1)))
    names = [*of(probe), *spreads]
    later = F.when(step < height, F.sequence(step, height - 1, step)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(later, measure(F.lit(0)), lambda s, y: let(measure(y), lambda m: add(s, m, names)))


def over_pixels(df: DataFrame, content: str, width: int, each: Callable[[Pixel], dict[str, Column]], of: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """df without its column of images, and for each of its rows the aggregates of(height, width) of the columns each(pixel), by name.

    A band, with a mirrored row on either side, is a row of its bytes as numbers, and a pixel a row of its place in them. Rows are told
    apart by their place in df, whatever their keys; an image's pixels lie in one task, and what is shuffled is a row for each image.
    """
    keys = [c for c in df.columns if c != content]
    height, first, last, place, wide = *(F.col(f"_{c}") for c in ("height", "first", "last", "place")), F.lit(width)
    images = df.select(*keys, F.monotonically_increasing_id().alias("_image"), F.col(content).alias("_content"), rows_of(F.col(content), width).alias("_height"))
    bands = images.select("*", F.explode(F.sequence(F.lit(0), height - 1, _band_rows(wide))).alias("_first")).withColumn("_last", F.least(height, first + _band_rows(wide)))
    size = lambda rows: rows * (3 * width)
    part = lambda y, rows: F.rpad(F.substring(F.col("_content"), size(y) + 1, size(rows)), size(rows), F.lit(b"\0"))
    beyond = lambda y: part(_mirrored(y, height, F.least(height, wide)), F.lit(1))
    read = byte_values(F.concat(beyond(first - 1), part(first, last - first), beyond(last)), size(last - first + 2))
    pixels = bands.select(*keys, "_image", "_height", "_first", "_last", read.alias("_values"))
    pixels = pixels.select("*", F.explode(F.sequence(size(F.lit(1)), size(last - first + 1) - 3, F.lit(3))).alias("_place"))
    at = {"_row": first + F.floor(place / size(1)).cast("int") - 1, "_column": F.floor(place % size(1) / 3).cast("int"), "_own": weighed(lambda k: F.get("_values", place + k))}
    pixel = Pixel(F.col("_own"), F.col("_values"), place, F.col("_row"), F.col("_column"), height, wide)
    measured = pixels.withColumns(at).select(*keys, "_image", "_height", *(v.alias(k) for k, v in each(pixel).items()))
    return measured.groupBy(*keys, "_image", "_height").agg(*(v.alias(k) for k, v in of(height, wide).items())).drop("_image", "_height")


def spread(m: Column) -> Column:
    """Population variance of moments."""
    return let(m, lambda v: ratio(v["m2"], v["n"]))


def _mirrored(i: Column, n: Column, least: Column) -> Column:
    """Place i of n with mirrored borders, or repeated ones where a side has one pixel."""
    inside = F.when(least > 1, F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i))
    return inside.otherwise(F.greatest(F.lit(0), F.least(i, n - 1)))


def pixel_edge(p: Pixel) -> Column:
    """The Laplacian at a pixel."""
    beside = F.when(F.least(p.height, p.width) > 1, 1).otherwise(0)
    left, right = F.when(p.column > 0, -1).otherwise(beside), F.when(p.column < p.width - 1, 1).otherwise(-beside)
    return weighed(lambda k: p.byte(k, -p.width) + p.byte(k, p.width) + p.byte(k, left) + p.byte(k, right) - 4 * p.byte(k))


def laplacian(g: Column, height: Column, width: Column, first: Column | int = 0, last: Column | None = None, base: Column | int = 0) -> Column:
    """The four neighbours less four times the pixel, of rows first to last - 1, where g begins at row base."""
    least = F.least(height, width)
    first, last = F.lit(first) if isinstance(first, int) else first, height if last is None else last

    def row(y: Column) -> Column:
        begin = lambda i: (_mirrored(i, height, least) - base) * width
        begins = F.struct(begin(y - 1).alias("up"), ((y - base) * width).alias("own"), begin(y + 1).alias("down"))
        at = lambda o, x: F.get(g, o["up"] + x) + F.get(g, o["down"] + x) + F.get(g, o["own"] + _mirrored(x - 1, width, least)) + F.get(g, o["own"] + _mirrored(x + 1, width, least)) - 4 * F.get(g, o["own"] + x)
        return let(begins, lambda o: F.transform(upto(width), lambda x: at(o, x)))

    return F.flatten(F.transform(F.sequence(first, last - 1), row))


def image_laplacian(image: Image) -> Callable[[Band], Column]:
    """The Laplacian of a band's rows, which needs a halo of one row."""
    return lambda x: laplacian(x.gray, image.height, image.width, x.first, x.last, x.base)


def brightness(image: Image) -> Column:
    """mean: of the gray levels, from an exact sum; variance: of the gray levels (M3)."""
    out = over_bands(image, lambda x: {"sum": thousandths(x.values, upto(F.size(x.gray)))}, {"levels": lambda x: x.gray})
    return let(out, lambda v: F.struct(ratio(v["sum"], v["levels"]["n"] * 1000).alias("mean"), spread(v["levels"]).alias("variance")))


def laplacian_variance(image: Image) -> Column:
    """Variance of the Laplacian (M4)."""
    return spread(over_bands(image, lambda x: {}, {"edges": image_laplacian(image)}, halo=1)["edges"])


def dark_share(image: Image, level: int) -> Column:
    """Share of the pixels whose gray level is at most this (M8)."""
    dark = over_bands(image, lambda x: {"dark": F.size(F.filter(x.gray, lambda v: v <= level)).cast("long")})["dark"]
    return ratio(dark, image.height * image.width)


def _roughness(p: Callable[[Column], Column], width: Column) -> Column:
    """The difference of the two Laplacians where p(d) is the level so many pixels further on."""
    edges, corners = p(F.lit(-1)) + p(F.lit(1)) + p(-width) + p(width), p(-width - 1) + p(-width + 1) + p(width - 1) + p(width + 1)
    return corners - 2 * edges + 4 * p(F.lit(0))


def _deviation(roughness: Column, height: Column, width: Column) -> Column:
    return F.when(F.least(height, width) < 3, 0.0).otherwise(roughness * (math.sqrt(math.pi / 2) / 36) / ((height - 2) * (width - 2)))


def noise_sigma(image: Image) -> Column:
    """Noise deviation by the difference of two Laplacians over the inner pixels; the divisor 36 is part of the definition (M6)."""
    height, width = image.height, image.width

    def of(band: Band) -> dict[str, Column]:
        first = F.greatest(F.lit(1), band.first)
        inner = F.greatest(F.lit(0), F.least(height - 1, band.last) - first) * (width - 2)

        def at(k: Column) -> Column:
            i = (F.floor(k / (width - 2)).cast("int") + first - band.base) * width + k % (width - 2) + 1
            return F.abs(_roughness(lambda d: F.get(band.gray, i + d), width))

        return {"sum": F.when(inner > 0, total(F.transform(upto(inner), at))).otherwise(0.0)}

    return _deviation(over_bands(image, of, halo=1)["sum"], height, width)


def pixel_noise(df: DataFrame, content: str, width: int) -> DataFrame:
    """noise_sigma of each row's image, by an aggregate over pixels."""

    def each(p: Pixel) -> dict[str, Column]:
        inner = (p.row > 0) & (p.row < p.height - 1) & (p.column > 0) & (p.column < p.width - 1)
        return {"_rough": F.when(inner, F.abs(weighed(lambda k: _roughness(lambda d: p.byte(k, d), p.width))))}

    return over_pixels(df, content, width, each, lambda height, width: {"noise_sigma": _deviation(F.sum("_rough"), height, width)})


def _cells(have: Column, want: int) -> Column:
    """For each of want cells along an axis of have: its first place and the weights from there on, areas where it shrinks, linear
    between centres where it grows."""

    def cell(t: Column) -> Column:
        low, high = t * have / float(want), (t + 1) * have / float(want)
        first, last = F.floor(low).cast("int"), F.least(have, F.ceil(high - 1e-9).cast("int")) - 1
        areas = F.transform(F.sequence(first, last), lambda y: (F.least(high, y + 1.0) - F.greatest(low, y.cast("double"))) / (have / float(want)))
        at = F.greatest(F.lit(0.0), F.least((t + 0.5) * have / want - 0.5, have - 1.0))
        part = at - F.floor(at)
        linear = F.struct(F.floor(at).cast("int").alias("first"), F.when(part > 0, F.array(1 - part, part)).otherwise(F.array(F.lit(1.0))).alias("weights"))
        return F.when(have >= want, F.struct(first.alias("first"), areas.alias("weights"))).otherwise(linear)

    return F.transform(upto(want), cell)


def _gray_row(image: Image, y: Column) -> Column:
    return let(_rows_read(image, y, 1), gray)


def _row_shares(t: Column, image: Image, want: int, row_of: Body) -> Column:
    """Row t of want rows, with weights as in _cells: the image's rows are added to it one by one."""
    have = image.height
    low, high = t * have / float(want), (t + 1) * have / float(want)
    first, last = F.floor(low).cast("int"), F.least(have, F.ceil(high - 1e-9).cast("int")) - 1
    zeros = F.transform(upto(image.width), lambda x: F.lit(0.0))

    def add(row: Column, y: Column) -> Column:
        share = F.least(high, y + 1.0) - F.greatest(low, y.cast("double"))
        return let(share, lambda w: F.zip_with(row, row_of(y), lambda a, g: a + g * w))

    def between(a: Column) -> Column:
        y, part = F.floor(a).cast("int"), a - F.floor(a)
        return F.zip_with(row_of(y), row_of(F.least(y + 1, have - 1)), lambda g, o: g * (1 - part) + o * part)

    area = F.transform(F.aggregate(F.sequence(first, last), zeros, add), lambda v: v / (have / float(want)))
    return F.when(have >= want, area).otherwise(let(F.greatest(F.lit(0.0), F.least((t + 0.5) * have / want - 0.5, have - 1.0)), between))


def resized(image: Image, rows: int, columns: int) -> Column:
    """The image of rows x columns cells, row by row; each row is made as wide as the image, then narrowed."""
    return F.flatten(resized_rows(image, rows, columns))


def resized_rows(image: Image, rows: int, columns: int) -> Column:
    """The rows of the resized image; one that is as wide as the image stays as it is. An image of one band has its rows read once."""
    narrowed = lambda v, cells: F.transform(cells, lambda c: dot(F.slice(v, c["first"] + 1, F.size(c["weights"])), c["weights"]))
    made = lambda row_of, cells: F.transform(upto(rows), lambda t: let(_row_shares(t, image, rows, row_of), lambda v: F.when(image.width == columns, v).otherwise(narrowed(v, cells))))
    read = lambda y: _gray_row(image, y)
    held = lambda cells: let(F.transform(upto(image.height), read), lambda g: made(lambda y: F.get(g, y), cells))
    return let(_cells(image.width, columns), lambda cells: F.when(image.height <= _band_rows(image.width), held(cells)).otherwise(made(read, cells)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def hex_of(bits: Column) -> Column:
    """64 bits as 16 hexadecimal digits, most significant first."""
    text = F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "")
    return F.lower(F.lpad(F.conv(text, 2, 16), 16, "0"))


def dhash(image: Image) -> Column:
    """Whether each of 8 x 8 cells is darker than its right neighbour (M1)."""
    right = lambda v: F.transform(upto(64), lambda i: F.get(v, i + F.floor(i / 8).cast("int") + 1) - F.get(v, i + F.floor(i / 8).cast("int")) > EVEN)
    return hex_of(let(resized(image, 8, 9), right))


def phash(image: Image) -> Column:
    """Which of the lowest 8 x 8 cosine coefficients of 32 x 32 cells exceed the median of the 63 that aren't the mean (M2)."""
    basis = F.array(*(F.array(*(F.lit(math.sqrt((1 if k == 0 else 2) / 32) * math.cos(math.pi * (2 * x + 1) * k / 64)) for x in range(32))) for k in range(8)))

    def low(c: Column) -> Column:
        """Each wave along the rows first, then along what that leaves of the columns: whole arrays are multiplied, no place is looked up."""
        across = let(resized_rows(image, 32, 32), lambda v: F.transform(c, lambda wave: F.transform(v, lambda row: dot(row, wave))))
        return let(across, lambda half: F.flatten(F.transform(c, lambda wave: F.transform(half, lambda column: dot(column, wave)))))

    def bits(v: Column) -> Column:
        median = F.get(F.array_sort(F.slice(v, 2, 63)), F.lit(31))
        return let(median, lambda m: F.transform(v, lambda x: x - m > EVEN))

    return hex_of(let(basis, lambda c: let(low(c), bits)))


def sharpness(image: Image, side: int) -> Column:
    """Laplacian variance of a square copy over the copy's variance, or over one where it has none (M5)."""
    square = lambda v: ratio(variance(laplacian(v, F.lit(side), F.lit(side))), let(variance(v), lambda x: F.when(x > EVEN, x).otherwise(1.0)))
    return let(resized(image, side, side), square)


def proxy_size(height: Column, width: Column, side: int) -> tuple[Column, Column]:
    """Height and width with the longer side at most side, never enlarged; halves go to the even number (M9)."""
    longest = F.greatest(height, width)
    fit = lambda n: F.when(longest <= side, n).otherwise(F.greatest(F.lit(1), F.rint(n * side / longest).cast("int")))
    return fit(height), fit(width)


def upload_quality(image: Image) -> Column:
    """visible_fraction, brightness, sharpness and color_score over pixels brighter than 10; zeros without any."""
    height, width = image.height, image.width
    seen = lambda x: F.filter(upto((x.last - x.first) * width), lambda i: F.get(x.gray, i + (x.first - x.base) * width) > 10)

    def of(x: Band) -> dict[str, Column]:
        places = F.transform(seen(x), lambda i: i + (x.first - x.base) * width)
        of_channel = lambda k: F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + channel(x.values, i, k))
        return {"red": of_channel(0), "green": of_channel(1), "blue": of_channel(2)}

    edges = lambda x: let(image_laplacian(image)(x), lambda v: F.transform(seen(x), lambda i: F.get(v, i)))

    def named(v: Column) -> Column:
        found = _seen_values(height * width, v["edges"]["n"], v["red"], v["green"], v["blue"], spread(v["edges"]))
        return F.struct(*(x.alias(k) for k, x in found.items()))

    return let(over_bands(image, of, {"edges": edges}, halo=1), named)


def pixel_quality(df: DataFrame, content: str, width: int) -> DataFrame:
    """upload_quality of each row's image, by aggregates over pixels."""

    def each(p: Pixel) -> dict[str, Column]:
        seen = {"_edge": pixel_edge(p), "_red": p.byte(0), "_green": p.byte(1), "_blue": p.byte(2)}
        return {k: F.when(p.own > 10, v) for k, v in seen.items()}

    of = lambda height, width: _seen_values(height * width, F.count("_edge"), F.sum("_red"), F.sum("_green"), F.sum("_blue"), F.var_pop("_edge"))
    return over_pixels(df, content, width, each, of)


def _seen_values(pixels: Column, n: Column, red: Column, green: Column, blue: Column, edges: Column) -> dict[str, Column]:
    """The four values from the number of pixels seen, their channels' sums and their edges' variance; the sum of gray levels is exact."""
    over = lambda v: ratio(v, n)
    found = {"visible_fraction": n / pixels, "brightness": ratio(red * 299 + green * 587 + blue * 114, n * 1000), "sharpness": edges, "color_score": over(red) / F.greatest(over(green), over(blue), F.lit(1.0))}
    return {k: F.when(n > 0, x).otherwise(0.0) for k, x in found.items()}


def measured(content: Column, width: int, values: Callable[[Image], Column]) -> Column:
    """values(image) of each row's image; its bytes and height are bound once."""
    return let(content, lambda c: let(rows_of(c, width), lambda h: values(Image(c, h, F.lit(width)))))


def input_problem(image: Column) -> Column:
    """What keeps an image of Spark's image source out, the first that holds of: no image (null, or it couldn't be decoded), channels
    (other than one or three), depth (not 8 bits without sign), empty (a side of nothing) and bytes (not as many as its sides ask for).
    Null where it is fit (P19)."""
    height, width = (F.coalesce(image[c].cast("long"), F.lit(0)) for c in ("height", "width"))
    channels = image["nChannels"].cast("long")
    return (
        F.when(image.isNull() | F.coalesce(image["mode"] < 0, F.lit(True)), "no image")
        .when(~F.coalesce(channels.isin(1, 3), F.lit(False)), "channels")
        .when(image["mode"].bitwiseAND(F.lit(7)) != 0, "depth")
        .when(F.least(height, width) <= 0, "empty")
        .when(F.coalesce(F.length(image["data"]), F.lit(0)) != height * width * channels, "bytes")
    )
