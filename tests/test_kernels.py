"""Image kernels against plainer forms of themselves."""

import numpy as np
import pytest

from quillspark.functions import kernels as K


def images():
    rng = np.random.Generator(np.random.PCG64(7))
    for h, w in ((1, 32), (2, 32), (19, 32), (700, 32), (40, 300), (3, 5)):
        yield rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
    yield np.full((9, 32, 3), 97, np.uint8)


def equalized(plane, clip, tiles):
    """Tile by tile, pixel by pixel."""
    edges = [np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in plane.shape]
    tables = {}
    for i in range(len(edges[0]) - 1):
        for j in range(len(edges[1]) - 1):
            cell = plane[edges[0][i] : edges[0][i + 1], edges[1][j] : edges[1][j + 1]]
            count = np.bincount(cell.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * cell.size / 256)
            tables[i, j] = np.cumsum(np.minimum(count, limit) + np.maximum(count - limit, 0).sum() / 256) * 255 / cell.size
    out = np.zeros(plane.shape)
    for place, level in np.ndenumerate(plane):
        sides = []
        for p, n, e in zip(place, plane.shape, edges):
            k = len(e) - 1
            at = min(max((p + 0.5) * k / n - 0.5, 0), k - 1)
            sides.append([(int(at), 1 - at + int(at)), (min(int(at) + 1, k - 1), at - int(at))])
        out[place] = sum(a * b * tables[i, j][level] for i, a in sides[0] for j, b in sides[1])
    return np.clip(out, 0, 255)


def test_equalisation_counts_all_tiles_at_once(monkeypatch):
    counted, bincount = [], np.bincount
    for x in images():
        plane = x[:, :, 0]
        want = equalized(plane, 2.0, 8)
        with monkeypatch.context() as m:
            m.setattr(np, "bincount", lambda *a, **b: counted.append(1) or bincount(*a, **b))
            assert K._equalized(plane, 2.0, 8) == pytest.approx(want, abs=1e-9)
    assert len(counted) == len(list(images()))


def test_sharpness_of_a_narrow_image_makes_no_wide_copy(monkeypatch):
    want = []
    for x in images():
        g = K.resize(K.gray(x), 512, 512)
        want.append(K._filtered(g, K.LAPLACE).var() / g.var() if np.ptp(x) else 0.0)
    made, resize = [], K.resize
    monkeypatch.setattr(K, "resize", lambda x, h, w: made.append(h * w) or resize(x, h, w))
    for x, v in zip(images(), want):
        made.clear()
        assert K.sharpness(x) == pytest.approx(v, rel=1e-9)
        assert x.shape[1] > 128 or max(made) <= 512 * x.shape[1]
