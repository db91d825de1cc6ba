"""The greedy assignment of all groups against a plain loop over them."""

import hashlib
import random
from fractions import Fraction

import pytest

from quillspark.operators import splits

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def loop(groups, ratios, seed=0):
    """groups: {group: {label: n}}. Deficits as the rule states them, in exact fractions."""
    sha = lambda t: hashlib.sha256(f"{seed}:{t}".encode()).hexdigest()
    total = {}
    for c in groups.values():
        for k, n in c.items():
            total[k] = total.get(k, 0) + n
    share = {s: Fraction(str(r)) for s, r in ratios.items() if r > 0}
    have = {s: dict.fromkeys(total, 0) for s in share}
    text = lambda c: ",".join(f"{k}:{n}" for k, n in sorted(c.items()))
    out = {}
    for g in sorted(groups, key=lambda g: (-sum(groups[g].values()), sha(text(groups[g])), sha(g), g)):
        gain = {s: sum((share[s] * total[k] - have[s][k]) * n for k, n in groups[g].items()) / share[s] for s in share}
        best = max(share, key=lambda s: gain[s])  # the first on ties
        out[g] = best
        for k, n in groups[g].items():
            have[best][k] += n
    return out


def assigned(spark, groups, ratios, seed=0):
    rows = [(g, k, n) for g, c in groups.items() for k, n in c.items()]
    got = splits.greedy_assignment(spark.createDataFrame(rows, "`group` long, label int, n long").repartition(3), ratios, seed).collect()
    assert len(got) == len(groups)
    return dict(map(tuple, got))


@pytest.mark.parametrize("ratios", [RATIOS, {"a": 0.5, "b": 0.5}, {"a": 0.33, "b": 0.0, "c": 0.25, "d": 0.42}, {"all": 1.0}, {"x": 0.05, "y": 0.05, "z": 0.9}])
def test_equal_to_a_plain_loop(spark, ratios):
    rng = random.Random(sum(map(ord, "".join(ratios))))
    groups = {g: {rng.randrange(3): 1} if g % 3 else {k: rng.randint(1, 4) for k in rng.sample(range(3), rng.randint(1, 3))} for g in range(700)}
    groups |= {1000 + g: {k: rng.randint(1, 90) for k in range(3)} for g in range(15)}
    seed = len(ratios)
    assert assigned(spark, groups, ratios, seed) == loop(groups, ratios, seed)


def test_one_long_run(spark):
    """Groups that are all alike: which group goes where, and shares as near as the rule's ties allow."""
    groups = {g: {0: 1} for g in range(1003)}
    got = assigned(spark, groups, RATIOS)
    assert got == loop(groups, RATIOS)
    assert all(abs(list(got.values()).count(s) - 1003 * r) < 2 for s, r in RATIOS.items())


def test_closed_form_of_a_run():
    rng = random.Random(3)
    for _ in range(300):
        share, step, m = [rng.randint(1, 9) for _ in range(rng.randint(1, 4))], rng.randint(1, 5), rng.randint(1, 60)
        load = [rng.randint(0, 40) for _ in share]
        now, taken = list(load), [0] * len(share)
        for _ in range(m):
            b = min(range(len(share)), key=lambda i: (Fraction(now[i], share[i]), i))
            now[b] += step
            taken[b] += 1
        assert [splits._taken(load, share, step, b, m) for b in range(len(share))] == taken


def test_large_numbers(spark):
    """Counts whose products don't fit 64 bits."""
    groups = {g: {0: 10**10 + g % 3, 1: 10**9} for g in range(60)}
    assert assigned(spark, groups, RATIOS) == loop(groups, RATIOS)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(splits, "RUNS", 2)
    df = spark.createDataFrame([(1, 0, 2), (1, 0, 1), (None, 0, 5), (2, None, 5), (3, 1, 0), (4, 1, 1), (5, 2, 1)], "`group` long, label int, n long")
    assert dict(map(tuple, splits.greedy_assignment(df, RATIOS).collect())) == loop({1: {0: 3}, 4: {1: 1}, 5: {2: 1}}, RATIOS)
    assert splits.greedy_assignment(df.limit(0), RATIOS).count() == 0
    with pytest.raises(ValueError):
        splits.greedy_assignment(df, {"a": 0.0})
