"""Groups beyond the largest against a plain loop."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quillspark.operators import splits

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
SHARE = list(RATIOS.values())


def brute(groups, largest):
    """groups: {group: {label: n}}."""
    tie = lambda g: hashlib.sha256(f"0:{g}".encode()).hexdigest()
    size = {g: sum(c.values()) for g, c in groups.items()}
    labels = sum(map(Counter, groups.values()), Counter())
    deficit = [{k: n * s for k, n in labels.items()} for s in SHARE]
    out = {}
    for g in sorted((g for g in groups if size[g] > 1), key=lambda g: (-size[g], tie(g)))[:largest]:
        gain = [sum(deficit[i][k] * n for k, n in groups[g].items()) / SHARE[i] for i in range(3)]
        out[g] = best = max(range(3), key=lambda i: (gain[i], -i))
        for k, n in groups[g].items():
            deficit[best][k] -= n
    lines = defaultdict(list)
    for g in sorted(set(groups) - set(out), key=tie):
        lines[max((n, k) for k, n in groups[g].items())[1]].append(g)
    for k, line in lines.items():
        room, done, rows = [max(0.0, d[k]) for d in deficit], 0, sum(size[g] for g in line)
        for g in line:
            place = (done + size[g] / 2) / rows
            out[g] = next((i for i in range(2) if place < sum(room[: i + 1]) / sum(room)), 2)
            done += size[g]
    return {g: list(RATIOS)[i] for g, i in out.items()}


@pytest.mark.parametrize("largest", [5, 1000])
def test_groups_match_brute_force(spark, largest):
    rng = random.Random(4)
    groups = {g: {rng.randrange(3): 1} if g % 2 else {k: rng.randint(1, 4) for k in rng.sample(range(3), rng.randint(1, 3))} for g in range(600)}
    rows = [(g, k, n) for g, c in groups.items() for k, n in c.items()]
    got = splits.assign_groups(spark.createDataFrame(rows, "`group` long, label int, n long"), RATIOS, largest=largest).collect()
    assert len(got) == len(groups) and dict(map(tuple, got)) == brute(groups, largest)


def test_single_rows_get_exact_shares(spark):
    df = spark.range(1000).selectExpr("id AS `group`", "cast(id % 2 AS int) AS label", "1L AS n")
    out = splits.assign_groups(df, RATIOS).join(df, "group").groupBy("label", "new_split").count().collect()
    assert {(r[0], r[1]): r[2] for r in out} == {(k, s): round(500 * x) for k in (0, 1) for s, x in RATIOS.items()}
