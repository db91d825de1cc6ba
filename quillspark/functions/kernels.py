"""Image measurements and transforms (S6, S7, M1-M12, X1-X5, X9) in numpy, for batches inside Spark tasks.

Images are H x W x 3 uint8 RGB arrays. Spark reads and decodes the files and deals out the work; a kernel sees one image.
Area resizing averages exactly over fractional cells. Bit equality with other image libraries isn't claimed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ImageError(ValueError):
    pass


def checked(image: np.ndarray) -> np.ndarray:
    """The image, or an error where it isn't a non-empty uint8 array of three channels."""
    if not isinstance(image, np.ndarray) or image.ndim != 3 or image.shape[2] != 3 or image.dtype != np.uint8 or image.size == 0:
        raise ImageError("a non-empty H x W x 3 uint8 array is expected")
    return image


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _area(n: int, out: int) -> np.ndarray:
    """Rows of weights that average n cells into out equal spans."""
    edge = np.linspace(0, n, out + 1)
    cell = np.arange(n)
    weights = np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages where the image shrinks, linear between cell centres where it grows."""
    out = x.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        have = out.shape[axis]
        if n <= have:
            out = np.moveaxis(np.tensordot(_area(have, n), out, axes=(1, axis)), 0, axis)
        else:
            at = np.clip((np.arange(n) + 0.5) * have / n - 0.5, 0, have - 1)
            low = np.floor(at).astype(int)
            part = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
            out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, have - 1), axis) * part
    return out


def letterbox(image: np.ndarray, size: int) -> np.ndarray:
    scale = size / max(image.shape[:2])
    h, w = (max(1, round(n * scale)) for n in image.shape[:2])
    out = np.zeros((size, size, 3), np.uint8)
    y, x = (size - h) // 2, (size - w) // 2
    out[y : y + h, x : x + w] = np.rint(resize(image, h, w))
    return out


def proxy(image: np.ndarray, side: int = 512) -> np.ndarray:
    """The image with its longer side at most so many pixels; never enlarged (M9)."""
    longest = max(image.shape[:2])
    if longest <= side:
        return image
    h, w = (max(1, round(n * side / longest)) for n in image.shape[:2])
    return np.rint(resize(image, h, w)).astype(np.uint8)


def hex_bits(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel().astype(np.uint8)).tobytes().hex()


def dhash(image: np.ndarray, size: int = 8) -> str:
    """Whether each cell is darker than its right neighbour (M1)."""
    small = resize(gray(image), size, size + 1).round(6)
    return hex_bits(small[:, 1:] > small[:, :-1])


def phash(image: np.ndarray, size: int = 8, base: int = 32) -> str:
    """Low cosine coefficients over the median of those that aren't the mean (M2)."""
    k = np.arange(base)
    dct = np.sqrt(2 / base) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * base))
    dct[0] /= np.sqrt(2)
    low = (dct @ resize(gray(image), base, base) @ dct.T)[:size, :size].round(6)
    return hex_bits(low > np.median(low.ravel()[1:]))


def _filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """3 x 3 correlation with mirrored borders."""
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    return sum(kernel[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3))


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
NOISE = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)


def brightness_contrast(image: np.ndarray) -> tuple[float, float]:
    g = gray(image)
    return float(g.mean()), float(g.std())


def laplacian_variance(image: np.ndarray) -> float:
    return float(_filtered(gray(image), LAPLACE).var())


def _bent(x: np.ndarray) -> np.ndarray:
    """Second differences down the columns, with mirrored borders."""
    p = np.pad(x, ((1, 1), (0, 0)), mode="reflect")
    return p[:-2] + p[2:] - 2 * x


@lru_cache(maxsize=16)
def _widening(n: int, side: int) -> tuple[np.ndarray, ...]:
    """For the weights W that make rows of n cells side cells wide, and their second differences D: W'W, W'D, D'D and the sums of both."""
    w = resize(np.eye(n), side, n)
    d = _bent(w)
    return w.T @ w, w.T @ d, d.T @ d, w.sum(axis=0), d.sum(axis=0)


def sharpness(image: np.ndarray, side: int = 512) -> float:
    """Laplacian variance of a square copy over its variance (M5).

    Of an image much narrower than the copy, the copy is only made tall: widening is linear, so that sums of squares over the wide copy
    are products with the weights' own, which are the same for all images of a width.
    """
    g = gray(image)
    if g.shape[1] * 4 > side:
        g = resize(g, side, side)
        return float(_filtered(g, LAPLACE).var() / (g.std() or 1.0) ** 2)
    tall = resize(g - g[0, 0], side, g.shape[1])
    tall -= tall.mean()
    bent, n = _bent(tall), side * side
    ww, wd, dd, w, d = _widening(g.shape[1], side)
    edges = (bent @ ww * bent).sum() + 2 * (bent @ wd * tall).sum() + (tall @ dd * tall).sum()
    edges = edges / n - ((bent.sum(axis=0) @ w + tall.sum(axis=0) @ d) / n) ** 2
    levels = (tall @ ww * tall).sum() / n - (tall.sum(axis=0) @ w / n) ** 2
    return float(max(edges, 0.0) / (max(levels, 0.0) or 1.0))


def noise_sigma(image: np.ndarray) -> float:
    """Noise deviation by the difference-of-Laplacians mask; the divisor 36 is part of the definition here (M6)."""
    g = gray(image)
    h, w = g.shape
    if min(h, w) < 3:
        return 0.0
    inner = _filtered(g, NOISE)[1:-1, 1:-1]
    return float(np.abs(inner).sum() * np.sqrt(np.pi / 2) / (36 * (w - 2) * (h - 2)))


def padding_ratio(image: np.ndarray, threshold: int = 10) -> float:
    return float((gray(image) <= threshold).mean())


def largest_component(mask: np.ndarray) -> np.ndarray | None:
    """The largest 8-connected part: runs of each row joined to those they touch in the row above."""
    runs, parent = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            for j in above:
                if runs[j][1] <= b and a <= runs[j][2]:
                    parent[root(k)] = root(j)
            here.append(k)
        above = here
    if not runs:
        return None
    sizes: dict[int, int] = {}
    for k, (_, a, b) in enumerate(runs):
        sizes[root(k)] = sizes.get(root(k), 0) + b - a
    best = max(sizes, key=lambda k: sizes[k])
    out = np.zeros(mask.shape, bool)
    for k, (y, a, b) in enumerate(runs):
        if root(k) == best:
            out[y, a:b] = True
    return out


def majority(mask: np.ndarray, side: int = 5) -> np.ndarray:
    """A median filter of a mask."""
    p = np.pad(mask.astype(np.int32), side // 2, mode="edge")
    h, w = mask.shape
    return sum(p[i : i + h, j : j + w] for i in range(side) for j in range(side)) * 2 > side * side


def tissue_box(image: np.ndarray, threshold: int = 10) -> tuple[int, int, int, int] | None:
    """x, y, width and height of the largest bright part (M7)."""
    part = largest_component(majority(gray(image) > threshold))
    if part is None:
        return None
    ys, xs = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
    return int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)


def remove_border(image: np.ndarray, threshold: int = 10, least: float = 0.10) -> np.ndarray:
    """The image cut to its bright part, or as it is where that is too small."""
    box = tissue_box(checked(image), threshold)
    if box is None or box[2] * box[3] < least * image.shape[0] * image.shape[1]:
        return image
    x, y, w, h = box
    return image[y : y + h, x : x + w]


def circular_crop(image: np.ndarray) -> np.ndarray:
    """Black outside the inscribed circle."""
    h, w = checked(image).shape[:2]
    y, x = np.ogrid[:h, :w]
    inside = (y - (h - 1) / 2) ** 2 + (x - (w - 1) / 2) ** 2 <= (min(h, w) / 2) ** 2
    return image * inside[:, :, None].astype(np.uint8)


def _equalized(plane: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast-limited equalisation of one uint8 plane: a clipped histogram for each tile, mixed linearly between tile centres."""
    h, w = plane.shape
    edges = [np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (h, w)]
    ny, nx = len(edges[0]) - 1, len(edges[1]) - 1
    spans = [np.diff(e) for e in edges]
    down, across = (np.repeat(np.arange(k), span) for k, span in zip((ny, nx), spans))
    place = (down * (nx * 256))[:, None] + across * 256 + plane  # of a pixel's level among all tiles' levels
    count = np.bincount(place.ravel(), minlength=ny * nx * 256).reshape(ny, nx, 256).astype(float)
    del place
    size = np.multiply.outer(*spans)[:, :, None]
    kept = np.minimum(count, np.maximum(1.0, clip * size / 256))
    over = (count - kept).sum(axis=2, keepdims=True)
    tables = np.cumsum(kept + over / 256, axis=2) * 255 / size
    at = [np.clip((np.arange(n) + 0.5) * k / n - 0.5, 0, k - 1) for n, k in ((h, ny), (w, nx))]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(lo + 1, k - 1) for lo, k in zip(low, (ny, nx))]
    fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
    pick = lambda y, x: tables[y[:, None], x[None, :], plane]
    top = pick(low[0], low[1]) * (1 - fx) + pick(low[0], high[1]) * fx
    bottom = pick(high[0], low[1]) * (1 - fx) + pick(high[0], high[1]) * fx
    return np.clip(top * (1 - fy) + bottom * fy, 0, 255)


def local_contrast(image: np.ndarray, mode: str = "lab", clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the green channel, or of the luminance (lab) or value (hsv) with colours kept in ratio."""
    x = checked(image).astype(np.float64)
    if mode == "green":
        out = x.copy()
        out[:, :, 1] = _equalized(image[:, :, 1], clip, tiles)
    elif mode in ("lab", "hsv"):
        light = gray(image) if mode == "lab" else x.max(axis=2)
        ratio = _equalized(np.rint(light).astype(np.uint8), clip, tiles) / np.maximum(light, 1.0)
        out = x * ratio[:, :, None]
    else:
        raise ImageError(f"unknown mode {mode}")
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur by two one-dimensional passes with repeated borders."""
    reach = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in range(x.ndim)], mode="edge")
        n = x.shape[axis]
        x = sum(k[i] * np.take(p, np.arange(i, i + n), axis=axis) for i in range(len(k)))
    return x


def even_light(image: np.ndarray, weight: float = 4.0, sigma: float = 10.0) -> np.ndarray:
    """weight * image - weight * blurred + 128."""
    x = checked(image).astype(np.float64)
    return np.clip(np.rint(weight * x - weight * _blurred(x, sigma) + 128), 0, 255).astype(np.uint8)


def channels_first(image: np.ndarray, mean, std) -> np.ndarray:
    if min(std) <= 0:
        raise ImageError("std must be positive")
    return ((image / 255.0 - np.array(mean)) / np.array(std)).astype(np.float32).transpose(2, 0, 1)


def upload_quality(image: np.ndarray) -> dict[str, float]:
    """visible_fraction, brightness, sharpness and color_score over pixels brighter than 10."""
    g = gray(image)
    seen = g > 10
    pixels = image[seen].astype(float)
    if not len(pixels):
        return {"visible_fraction": 0.0, "brightness": 0.0, "sharpness": 0.0, "color_score": 0.0}
    red, green, blue = pixels.mean(axis=0)
    return {"visible_fraction": float(seen.mean()), "brightness": float(g[seen].mean()), "sharpness": float(_filtered(g, LAPLACE)[seen].var()), "color_score": float(red / max(green, blue, 1.0))}


def header(content: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from a PNG's or JPEG's first segments, or None."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return ("PNG", *struct.unpack(">II", content[16:24]))
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    return None


MEASURED = "path string, width int, height int, aspect_ratio double, dhash string, phash string, brightness double, contrast double, laplacian_var double, sharpness_norm double, noise_sigma double, padding_ratio double, disc_x int, disc_y int, disc_w int, disc_h int, readable boolean, error string"


def measure(path: str, height: int, width: int, channels: int, data: bytes) -> dict:
    """All measurements of one decoded image (BGR bytes); never raises: an error is a value."""
    out = dict.fromkeys(c.split()[0] for c in MEASURED.split(", "))
    out |= {"path": path, "readable": False}
    if height <= 0 or channels not in (1, 3):
        return out | {"error": "decode failed"}
    try:
        image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        image = np.ascontiguousarray(image[:, :, ::-1] if channels == 3 else np.repeat(image, 3, axis=2))
        small = proxy(image)
        scale = max(image.shape[:2]) / max(small.shape[:2])
        bright, contrast = brightness_contrast(small)
        box = tissue_box(small)
        out |= {"width": width, "height": height, "aspect_ratio": width / height, "dhash": dhash(image), "phash": phash(image), "brightness": bright, "contrast": contrast, "laplacian_var": laplacian_variance(small), "sharpness_norm": sharpness(small), "noise_sigma": noise_sigma(small), "padding_ratio": padding_ratio(small), "readable": True}
        if box:
            out |= dict(zip(("disc_x", "disc_y", "disc_w", "disc_h"), (round(v * scale) for v in box)))
    except (ValueError, FloatingPointError) as e:
        out["error"] = f"measure: {e}"
    return out


def measured_images(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements of every image under a folder: decoded by the JVM, measured in Arrow batches, a task a partition."""
    decoded = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MEASURED.split(", ")]
        for pdf in batches:
            rows = [measure(*r) for r in pdf.itertuples(index=False, name=None)]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({c: "Int32" for c in ("width", "height", "disc_x", "disc_y", "disc_w", "disc_h")})

    return decoded.mapInPandas(run, MEASURED)


def headers(files: DataFrame) -> DataFrame:
    """path, format, width, height of binaryFile rows; nulls where the header isn't known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [header(bytes(c)) or (None, None, None) for c in pdf["content"]]
            frame = pd.DataFrame(found, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([pdf[["path"]].reset_index(drop=True), frame], axis=1)

    return files.select("path", "content").mapInPandas(run, "path string, format string, width int, height int")


#: Order in which deterministic steps must stand.
CANONICAL = ("remove_border", "circular_crop", "resize", "local_contrast", "even_light", "normalize")
STEPS = {"remove_border": remove_border, "circular_crop": circular_crop, "resize": letterbox, "local_contrast": local_contrast, "even_light": even_light, "normalize": channels_first}


def pipeline(image: np.ndarray, steps: dict[str, dict]) -> np.ndarray:
    """Deterministic steps, the same for every split; another order than the canonical one is an error."""
    places = [CANONICAL.index(s) for s in steps]
    if places != sorted(places):
        raise ImageError(f"steps must stand in the order {CANONICAL}")
    for name, options in steps.items():
        image = STEPS[name](image, **options)
    return image


#: Augmentations (family, name, evidence) in the order of their families (X9, X10). Evidence and, below, priority.
POLICY = (
    ("geometry", "hflip", "both"),
    ("geometry", "vflip", "paper"),
    ("geometry", "rotate", "both"),
    ("geometry", "scale", "eda"),
    ("geometry", "crop", "eda"),
    ("photometry", "brightness", "both"),
    ("photometry", "contrast", "both"),
    ("photometry", "jitter", "both"),
    ("photometry", "gamma", "eda"),
    ("corruption", "blur", "eda"),
    ("corruption", "noise", "eda"),
)
PRIORITY = {"hflip": "essential", "vflip": "recommended", "rotate": "essential", "brightness": "essential", "contrast": "recommended", "jitter": "essential"}


def augment(image: np.ndarray, name: str, rng: np.random.Generator) -> np.ndarray:
    """One seeded augmentation."""
    x = image.astype(np.float64)
    h, w = image.shape[:2]
    if name == "hflip":
        return image[:, ::-1]
    if name == "vflip":
        return image[::-1]
    if name in ("rotate", "scale"):
        turn, zoom = (np.deg2rad(rng.uniform(-15, 15)), 1.0) if name == "rotate" else (0.0, rng.uniform(0.9, 1.1))
        y, c = np.mgrid[:h, :w]
        y, c = y - (h - 1) / 2, c - (w - 1) / 2
        sy = np.rint((np.cos(turn) * y - np.sin(turn) * c) / zoom + (h - 1) / 2).astype(int)
        sx = np.rint((np.sin(turn) * y + np.cos(turn) * c) / zoom + (w - 1) / 2).astype(int)
        ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        return image[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)] * ok[:, :, None].astype(np.uint8)
    if name == "crop":
        k = rng.uniform(0.8, 1.0)
        ch, cw = max(1, int(h * k)), max(1, int(w * k))
        y, c = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
        x = resize(image[y : y + ch, c : c + cw], h, w)
    elif name == "brightness":
        x = x + rng.uniform(-25, 25)
    elif name == "contrast":
        x = (x - x.mean()) * rng.uniform(0.8, 1.2) + x.mean()
    elif name == "jitter":
        x = x * rng.uniform(0.9, 1.1, 3)
    elif name == "gamma":
        x = 255 * (x / 255) ** rng.uniform(0.8, 1.25)
    elif name == "blur":
        x = np.stack([_filtered(x[:, :, i], np.full((3, 3), 1 / 9)) for i in range(3)], axis=2)
    elif name == "noise":
        x = x + rng.normal(0, 255 * np.sqrt(rng.uniform(0.0005, 0.002)), x.shape)
    else:
        raise ImageError(f"unknown augmentation {name}")
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)
