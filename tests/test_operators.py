"""Published figures, semantic traps and properties of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import epochs, evaluate, groups, profile, rules, splits
from quillspark.operators.components import connected_components
from quillspark.scratch import Scratch

# A published confusion matrix, class counts and contingency table, and the figures that follow from them.
MATRIX = [[194, 2, 1, 0, 0], [0, 13, 14, 0, 1], [0, 2, 70, 3, 2], [0, 0, 9, 4, 0], [0, 2, 7, 2, 16]]
COUNTS = [1803, 362, 977, 187, 286]
TABLE = {"test": [197, 28, 77, 13, 27], "train": [1434, 300, 808, 153, 234], "val": [172, 34, 92, 21, 25]}


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(i, j, n) for i, r in enumerate(MATRIX) for j, n in enumerate(r)]
    return spark.createDataFrame(rows, "truth int, predicted int, n long")


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(list(enumerate(COUNTS)), "label int, count long")


def test_confusion_metrics(matrix):
    assert evaluate.quadratic_kappa(matrix).first()[0] == pytest.approx(0.9074447670127441, abs=1e-12)
    a = evaluate.agreement(matrix).first()
    assert (a["accuracy"], a["mae"], a["within_one"]) == pytest.approx((0.868421052631579, 0.1783625730994152, 0.9619883040935673))
    assert evaluate.macro_f1(matrix).first()[0] == pytest.approx(0.6782648493145188)
    assert evaluate.referable_miss_rate(matrix).first()[0] == pytest.approx(0.03418803418803419)


def test_imbalance_and_weights(counts):
    r = profile.imbalance(counts, 5).first()
    assert (r["ratio"], r["entropy"], r["imbalance_index"], r["gini"], r["effective_classes"]) == pytest.approx((9.641711229946525, 1.8537246987161142, 0.20164422714130636, 0.6592385729508025, 3.6143211408611298))
    w = lambda s: [x["weight"] for x in profile.class_weights(counts, s).orderBy("label").collect()]
    assert w("inverse") == pytest.approx([0.210331, 1.04759, 0.388155, 2.027954, 1.32597], abs=1e-6)
    assert w("effective_number") == pytest.approx([0.225535, 1.046582, 0.399754, 2.008432, 1.319697], abs=1e-6)
    with pytest.raises(ValueError):
        profile.class_weights(counts, "none")


def test_weight_of_a_class_without_rows_is_zero(spark):
    w = profile.class_weights(spark.createDataFrame([(0, 4), (1, 0)], "label int, count long"), "inverse").orderBy("label").collect()
    assert [x["weight"] for x in w] == [1.0, 0.0]


def test_chi_square(spark):
    rows = [(s, k, n) for s, r in TABLE.items() for k, n in enumerate(r)]
    r = profile.chi_square(spark.createDataFrame(rows, "split string, label int, count long")).first()
    assert (r["statistic"], r["dof"], r["p_value"]) == pytest.approx((10.851288232490884, 8, 0.21026863102042806))


def test_describe_of_one_row_and_none(spark):
    df = spark.createDataFrame([(3.0, None)], "a double, b double")
    rows = profile.describe(df, ["a", "b"]).collect()
    assert [(r["metric"], r["std"], r["median"]) for r in rows] == [("a", 0.0, 3.0)]


def test_percentiles_are_exact(spark):
    rng = random.Random(6)
    shares = [0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1]
    rows = [(rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), None]), rng.random() ** 9 * 1e6, 7.0) for _ in range(30_000)]
    for n in (30_000, 3000, 2, 1):
        df = spark.createDataFrame(rows[:n], "x double, y double, z double")
        want = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))) for c in "xyz")).first()
        for bins in (profile.PERCENTILE_BINS, 3):
            got = profile.percentiles(df, dict.fromkeys("xyz", shares), bins)
            assert [got[c] for c in "xyz"] == [pytest.approx(w) if w else [None] * len(shares) for w in want]
    assert profile.percentiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_chi_square_with_odd_degrees_of_freedom(spark):
    import math

    odd = {1: lambda x: math.erfc(math.sqrt(x / 2)), 3: lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)}
    even = {d: (lambda x, d=d: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))) for d in (2, 8, 40)}
    rows = [(d, x, f(x)) for d, f in (odd | even).items() for x in (0.0, 1e-6, 0.5, 3.0, 10.85, 60.0, 900.0)]
    df = spark.createDataFrame([(d, x) for d, x, _ in rows], "dof long, x double").select(profile.upper_gamma(F.col("dof"), F.col("x") / 2).alias("p"))
    assert [r["p"] for r in df.collect()] == pytest.approx([p for _, _, p in rows], abs=1e-11)
    two = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("b", 0, 20), ("b", 1, 10)], "split string, label int, count long")
    r = profile.chi_square(two).first()
    assert (r["dof"], r["statistic"]) == (1, pytest.approx(20 / 3)) and r["p_value"] == pytest.approx(math.erfc(math.sqrt(10 / 3)))


def test_near_pairs_match_all_pairs(spark):
    """Keys of several parts lose no pair, for any width and number of rows; the last part is as long as the others."""
    rng = random.Random(3)
    for width, threshold in ((60, 6), (64, 2), (60, 1)):
        base = [rng.getrandbits(width) for _ in range(60)]
        bits = [b ^ sum(1 << k for k in rng.sample(range(width), rng.randint(0, threshold + 2))) for b in base for _ in range(6)]
        rows = [(i, b - (1 << 64) if b >= 1 << 63 else b) for i, b in enumerate(bits)]
        first = {}
        for i, b in enumerate(bits):
            first.setdefault(b, i)
        want = {(first[b], i) for i, b in enumerate(bits) if first[b] != i}
        want |= {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= threshold}
        got = groups.near_pairs(spark.createDataFrame(rows, "id long, bits long"), "id", "bits", threshold, width)
        assert {tuple(r) for r in got.collect()} == want
    for n in (10, 10**5, 10**9, 10**12):
        parts = groups.band_parts(n, 6, 60)
        assert (parts - 6) * 60 // parts >= min(30, max(8, n.bit_length()))


def test_places_and_repeats_of_hot_groups(spark):
    df = spark.range(3000).selectExpr("id AS row_pos", "if(id % 3 = 0, null, if(id % 50 = 0, 'b', 'a')) AS split", "cast(id % 4 AS int) AS label")
    placed = epochs.placed_within(df, "split", [F.desc("label"), F.asc("row_pos")], "place", Scratch(spark, "places")).collect()
    for s in (None, "a", "b"):
        own = sorted((r for r in placed if r["split"] == s), key=lambda r: (-r["label"], r["row_pos"]))
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
    repeated = rules.with_repeated(df, "split", "label").collect()
    assert len(repeated) == 3000 and sorted(r["row_pos"] for r in repeated if not r["repeated"]) == sorted(min(r["row_pos"] for r in placed if (r["split"], r["label"]) == k) for k in {(r["split"], r["label"]) for r in placed})


def test_auc_of_any_scores(spark):
    rng = random.Random(8)
    rows = [(rng.choice([rng.gauss(0, 50), float(rng.randrange(-3, 4))]), rng.randrange(2)) for _ in range(4000)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert evaluate.auc(spark.createDataFrame(rows, "s double, y int"), F.col("s"), F.col("y") == 1).first()[0] == pytest.approx(want)


def test_augmentation_plan(spark):
    from quillspark.operators import augmentation
    from quillspark.sources.config import ConfigError

    df = spark.range(500).withColumnRenamed("id", "row_pos")
    rows = augmentation.augmentation_plan(df, "row_pos", 11).collect()
    assert 0.45 < len(rows) / (500 * 11) < 0.55 and len({r["step_seed"] for r in rows}) > 0.99 * len(rows)
    assert {r["evidence"] for r in augmentation.augmentation_plan(df, "row_pos", 11, profile="paper_faithful").collect()} == {"paper", "both"}
    with pytest.raises(ConfigError):
        augmentation.augmentation_plan(df, "row_pos", 11, forbidden=["HFlip"])


def test_auc_is_null_without_both_classes(spark):
    one = spark.createDataFrame([(0.1, 1), (0.9, 1)], "s double, y int")
    assert evaluate.auc(one, F.col("s"), F.col("y") == 1).first()[0] is None
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert evaluate.auc(ties, F.col("s"), F.col("y") == 1).first()[0] == 0.875


def test_bins_are_open_below(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.10001,), (1.0,)], "c double")
    assert [r[0] for r in df.select(evaluate.bin_of(F.col("c"), evaluate.edges(10))).collect()] == [None, 0, 1, 9]


def test_argmax_and_margin_on_ties(spark):
    r = spark.sql("SELECT array(0.4D, 0.4D, 0.2D) AS p").select(C.argmax(F.col("p")), C.top_two_margin(F.col("p")), C.runner_up(F.col("p"))).first()
    assert tuple(r) == (0, 0.0, 1)


def test_missing_measurements_raise_no_flag(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "row_pos int, x double")
    out = rules.apply_rules(df, [rules.quality({"high": ("x", ">", 1.0), "off": ("x", "<", None)})]).orderBy("row_pos").collect()
    assert [r["quality_flags"] for r in out] == ["", "high"] and all(r["included"] for r in out)
    assert rules.percentile_limit(df, "x", 0) is None and rules.percentile_limit(df.limit(0), "x", 50) is None


def test_report_only_rules_cannot_exclude():
    with pytest.raises(ValueError):
        rules.Rule("quality", F.lit("x"), report_only=True)
    with pytest.raises(ValueError):
        rules.Policy(delete=True)


def test_first_rule_owns_the_reason_and_all_rules_see_all_rows(spark):
    df = spark.createDataFrame([(1, "a", "train", "m", False), (2, "b", "val", "m", True), (3, "c", "test", "", True), (4, "d", "test", "", True)], "row_pos int, id_code string, split string, md5 string, readable boolean")
    g = rules.with_exact_groups(df)
    out = rules.apply_rules(g, [rules.Rule("unreadable", F.when(~F.col("readable"), "unreadable")), rules.duplicates()]).orderBy("row_pos").collect()
    assert [r["exclusion_rule"] for r in out] == ["unreadable", None, None, None]
    assert [r["md5_group_size"] for r in out] == [2, 2, 1, 1] and [r["md5_keeper"] for r in out] == [False, True, True, True]


def brute_components(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    pairs = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(50)], "none": []}[shape]
    df = spark.createDataFrame([(a, b) for a, b in pairs] + [(None, 1)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "cc")).collect()}
    assert got == brute_components([p for p in pairs if p[0] != p[1]])


def test_near_pairs_lose_none(spark):
    rng = random.Random(2)
    bits = [rng.getrandbits(64) - (1 << 63) for _ in range(20)]
    rows = [(i, rng.choice(bits) ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(3)))) for i in range(150)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, bits long")
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = brute_components([(a, b) for a, x in rows[:-1] for b, y in rows[:-1] if a < b and far(x, y) <= 2])
    got = {r["id"]: r["cluster"] for r in groups.clusters(df, "id", "bits", 2, Scratch(spark, "near")).collect()}
    assert got == {i: want.get(i, i) for i, _ in rows}


def test_dual_clusters_are_intersections_of_closures(spark):
    """1-2-3 are chained in both fingerprints by different links: one cluster, though 1 and 3 agree in neither."""
    df = spark.createDataFrame([(1, 0b0000, 0b0000), (2, 0b0011, 0b0011), (3, 0b1111, 0b1111), (4, 0b1111, 0b111 << 40)], "id long, a long, b long")
    got = {r["id"]: r["cluster"] for r in groups.dual_clusters(df, "id", "a", "b", 2, Scratch(spark, "dual")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_merged_groups(spark):
    df = spark.createDataFrame([(1, "m1", "c1"), (2, "m1", "c2"), (3, "m2", "c2"), (4, "", None), (5, "", "")], "id long, a string, b string")
    got = {r["id"]: r["group"] for r in groups.merged_groups(df, "id", ["a", "b"], Scratch(spark, "merge")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_regenerated_splits(spark):
    rows = [(i, i // 3 if i < 90 else i, i % 5) for i in range(600)] + [(601, 601, None)]
    df = spark.createDataFrame(rows, "row_pos long, group long, label int")
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    out = splits.regenerate(df, ratios, seed=3)
    assert out.count() == 600
    assert out.groupBy("group").agg(F.count_distinct("new_split").alias("k")).where("k > 1").count() == 0
    assert sorted(map(tuple, out.select("row_pos", "new_split").collect())) == sorted(map(tuple, splits.regenerate(df, ratios, seed=3).select("row_pos", "new_split").collect()))
    share = {r["new_split"]: r["share"] for r in splits.achieved(out).collect()}
    assert all(abs(share[s] - ratios[s]) < 0.06 for s in ratios)
    with pytest.raises(ValueError):
        splits.regenerate(df.where("label IS NULL"), ratios)
    named = df.where("label IS NOT NULL").withColumn("split", F.when(F.col("row_pos") % 2 == 0, "train").otherwise("val"))
    with pytest.raises(splits.LeakageError):
        splits.require_disjoint(named, "group")


def test_early_stop_skips_missing_values(spark):
    values = [1.0, 2.0, None, 1.5, 1.0, 3.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "epoch int, value double")
    out = epochs.early_stop(df, "epoch", "value", 2).orderBy("epoch").collect()
    assert [r["improved"] for r in out] == [True, True, False, False, False, True, False]
    assert [r["waited"] for r in out] == [0, 0, 0, 1, 2, 0, 1] and [r["epoch"] for r in out if r["stop"]] == [4]
    assert epochs.best_epoch(df, "epoch", "value").first()["epoch"] == 5


def test_permutation_is_complete_and_seeded(spark):
    df = spark.range(1000)
    a = {r["id"]: r["place"] for r in epochs.permutation(df, "id", 1).collect()}
    b = {r["id"]: r["place"] for r in epochs.permutation(df.repartition(7), "id", 1).collect()}
    assert a == b and sorted(a.values()) == list(range(1000)) and a != {r["id"]: r["place"] for r in epochs.permutation(df, "id", 2).collect()}


def test_merged_moments_equal_whole_moments(spark):
    parts = [[1.0, 2.0, 4.0], [10.0], [3.0, 3.0]]
    rows = []
    for p in parts:
        m = sum(p) / len(p)
        rows.append((0, len(p), m, sum((x - m) ** 2 for x in p)))
    r = profile.merge_moments(spark.createDataFrame(rows, "channel int, n long, mean double, m2 double")).first()
    flat = [x for p in parts for x in p]
    mean = sum(flat) / len(flat)
    assert (r["n"], r["mean"], r["std"]) == pytest.approx((6, mean, (sum((x - mean) ** 2 for x in flat) / 6) ** 0.5))


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(C.bits_to_hex(F.lit("0000000011111111"))) == "00ff"
    assert get(C.hex_to_signed(F.lit("ffffffffffffffff"))) == -1
    assert get(C.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    assert get(C.human_bytes(F.lit(1536))) == "1.5 KB" and get(C.human_bytes(F.lit(3 << 40))) == "3.0 TB"
    assert get(C.ratio(F.lit(1), F.lit(0))) is None and get(C.ratio(F.lit(1), F.lit(0), 0)) == 0.0
    assert C.config_hash({"b": 1, "a": 2}) == C.config_hash({"a": 2, "b": 1}) and len(C.config_hash({})) == 12
    with pytest.raises(Exception, match="std must be positive"):
        get(C.normalize(F.array(F.lit(1.0)), F.array(F.lit(0.0)), F.array(F.lit(0.0))))


def test_normalization_modes(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],)], "v array<double>")
    assert profile.normalization(df, "auto", "v") == ([2.0, 2.0], [1.0, 0.0])
    assert profile.normalization(None, "auto", cached={"key": "k", "mean": [1], "std": [2]}, key="k") == ([1], [2])
    assert profile.normalization(None, "imagenet")[0][0] == 0.485
    with pytest.raises(ValueError):
        profile.normalization(None, "config")
