"""Operators 12 and 13 against brute force."""

import numpy as np
import pytest

from quillspark.llm import vector_dedup
from quillspark.llm.vector_dedup import Forest, Geometry, near_duplicate_vectors
from quillspark.llm.whitening import bidiagonalised, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, parts string, node string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "k", "p", "n") for i, v in zip(ids, vectors)], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(np.float32(c)) for c in v)


# ---- whitening ----


def brute_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov((fit - s / n).T, bias=True).reshape(x.shape[1], x.shape[1])
    e, axes = np.linalg.eigh(cov)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n), e[::-1], axes[:, ::-1]


def check_whitening(got, vectors, components=16, distinct_values=True):
    n, deviation, centred, e, axes = brute_whitening(vectors)
    k = min(components, int((e > 1e-9 * e.sum()).sum()))
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == k * len(vectors) and (got.n == n).all()
    assert (got.deviation.to_numpy().reshape(-1, k) == deviation[:, None]).all()
    w = got.whitened.to_numpy().reshape(-1, k)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), e[:k] / e.sum(), rtol=1e-9)
    assert got.identity_error.max() <= 1e-8
    if distinct_values:
        want = centred @ axes[:, :k] / np.sqrt(e[:k])
        assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)
    return w


def test_whitening_against_eigenvectors(spark):
    r = np.random.default_rng(3)
    x = (r.standard_normal((300, 12)) * np.linspace(0.2, 2, 12)).astype(np.float32)
    x = np.concatenate([x, x[:40], x[:1]])
    check_whitening(whitened(frame(spark, x).repartition(3)).toPandas(), x)
    check_whitening(whitened(frame(spark, x), components=3).toPandas(), x, 3)


def test_repeated_eigenvalues_and_low_rank(spark):
    cube = np.array([[a, b, c, 0] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], np.float32)  # one eigenvalue three times, one of nought
    w = check_whitening(whitened(frame(spark, cube)).toPandas(), cube, distinct_values=False)
    assert np.allclose(w.T @ w / len(cube), np.eye(3), atol=1e-9)
    few = np.random.default_rng(1).standard_normal((5, 30)).astype(np.float32)  # fewer vectors than dimensions
    check_whitening(whitened(frame(spark, few)).toPandas(), few)


def test_bidiagonalisation_is_a_singular_value_decomposition():
    x = np.random.default_rng(2).standard_normal((50, 12)) * 10.0 ** -np.arange(12)
    values, vectors = bidiagonalised(lambda m, t: ((x @ m).T @ (x @ t), float((x @ t) @ (x @ t)), x.T @ (x @ t)), 12, 12, np.linalg.norm(x))
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(values[:8], want[:8], rtol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)


BAD = [None, [], [float("nan")] * 4, [1.0, None, 0.0, 0.0], [float("inf"), 0, 0, 0], [1.0, 2.0]]


def test_whitening_edges(spark):
    r = np.random.default_rng(5)
    x = list(r.standard_normal((20, 4)).astype(np.float32))
    df = frame(spark, BAD + x + [x[0]], [*range(100, 100 + len(BAD)), *range(20), None])
    got = whitened(df).toPandas()
    assert set(got.vec_id.dropna()) == set(range(20)) and got.vec_id.isna().sum() == 4
    check_whitening(got[got.vec_id.notna()], x)
    assert whitened(frame(spark, [])).count() == 0
    assert whitened(frame(spark, [[1.0, 2.0], [1.0, 2.0]])).count() == 0  # no variance
    assert whitened(frame(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]])).count() == 6


# ---- near-duplicates ----


def brute_links(vectors, ids, cosine):
    n = len(vectors)
    links = [set() for _ in range(n)]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if usable(v) and np.any(v) else None for v in vectors]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine - 1e-12:
                links[i].add(j)
                links[j].add(i)
    out, component = [], [None] * n
    for i in range(n):
        if component[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for k in links[todo.pop()] - seen:
                    seen.add(k)
                    todo.append(k)
            for k in seen:
                component[k] = seen
    for i in range(n):
        known = [ids[k] for k in component[i] if ids[k] is not None]
        low = min(known) if known else None
        out.append((ids[i], len(links[i]), low, ids[i] == low))
    return sorted(out, key=repr)


def links_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def clusters(seed=4, dims=16, n=400):
    """Lone vectors, loose and tight clusters, chains, exact copies."""
    r = np.random.default_rng(seed)
    x = [r.standard_normal((n, dims))]
    for spread, size in ((0.02, 60), (0.08, 40), (0.1, 30), (0.15, 30)):
        x.append(r.standard_normal(dims) + spread * r.standard_normal((size, dims)))
    a, b = r.standard_normal((2, dims))
    b -= a * (a @ b) / (a @ a)
    b *= np.linalg.norm(a) / np.linalg.norm(b)
    x.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.1)]))
    x = np.concatenate(x).astype(np.float32)
    return [list(map(float, v)) for v in np.concatenate([x, np.repeat(x[:1], 25, axis=0), 3 * x[1:4]])]


def found_share(got, want):
    """Components and links that agree; a forest may lose a pair just at the threshold."""
    return np.mean([a == b for a, b in zip(got, want)])


def test_near_vectors_against_brute_force(spark):
    x = clusters()
    want = brute_links(x, range(len(x)), 0.95)
    assert links_of(near_duplicate_vectors(frame(spark, x).repartition(3))) == want


@pytest.mark.parametrize("dense, sample", [(10**9, 16384), (8, 64)])
def test_small_leaves(spark, monkeypatch, dense, sample):
    """Trees, further rounds, leaves in several blocks, with and without cells: each pair counts once."""
    monkeypatch.setattr(vector_dedup, "DENSE", dense)
    monkeypatch.setattr(vector_dedup, "SAMPLE", sample)
    x = clusters(n=150)
    want = brute_links(x, range(len(x)), 0.95)
    assert found_share(links_of(near_duplicate_vectors(frame(spark, x), leaf_rows=40)), want) >= 0.99


def test_fringe_of_a_cell(spark):
    """A disc of vectors wider than a cell: links between members, and between members and what lies around them."""
    r = np.random.default_rng(9)
    x = [list(map(float, v)) for v in (np.eye(6)[0] + 0.12 * r.standard_normal((300, 6))).astype(np.float32)]
    assert links_of(near_duplicate_vectors(frame(spark, x), leaf_rows=64)) == brute_links(x, range(len(x)), 0.95)


def test_near_vector_edges(spark):
    x = clusters(n=20)[:60]
    vectors = BAD + [[0.0] * 16, [-0.0] * 16, x[0], [0.0, 1.0], [0.0, 2.0], [1e-30, 0.0], [1e30, 0.0]] + x
    ids = [None, 900, 901, None, 902, 903, 904, 905, None, 906, 906, 907, 908, *range(len(x))]
    got = links_of(near_duplicate_vectors(frame(spark, vectors, ids)))
    scaled = [[c / max(map(abs, v)) for c in v] if usable(v) and any(v) else v for v in vectors]  # squares of 1e-30 in brute force
    assert got == brute_links(scaled, ids, 0.95)
    assert near_duplicate_vectors(frame(spark, [])).count() == 0
    assert links_of(near_duplicate_vectors(frame(spark, [[1.0, 0.0], [1.0, 0.0]], [None, None]))) == [(None, 1, None, True)] * 2


def test_recall_of_the_forest():
    """Pairs just at the threshold, the hardest ones, among many lone vectors."""
    r = np.random.default_rng(8)
    x = r.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = r.standard_normal((2000, 64))
    other -= (other * x[:2000]).sum(axis=1)[:, None] * x[:2000]
    y = 0.951 * x[:2000] + np.sqrt(1 - 0.951**2) * other / np.linalg.norm(other, axis=1)[:, None]
    f = Forest(x.astype(np.float32), Geometry(64, 0.95), 100, vector_dedup.TREES)
    assert not len(f.centres)
    at = [set() for _ in range(10000)]
    for row, leaf in zip(*f.leaves(np.concatenate([x, y]).astype(np.float32))):
        at[row].add(int(leaf))
    assert np.mean([bool(at[k] & at[8000 + k]) for k in range(2000)]) >= 0.998
