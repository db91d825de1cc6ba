"""Cleaning rules as column expressions.

Every rule sees all rows, excluded ones too; a rule adds a reason (null: not excluded) and flags. The first rule to
give a reason owns the exclusion. Nothing is deleted: rows end up included or in quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import flags_when, integer_label, joined_flags
from quillspark.operators.profile import percentiles


@dataclass(frozen=True)
class Rule:
    """name, reason (null where the row stays) and flags; report_only rules may never exclude."""

    name: str
    reason: Column | None = None
    flags: Column | None = None
    report_only: bool = False

    def __post_init__(self) -> None:
        if self.report_only and self.reason is not None:
            raise ValueError(f"{self.name} is report-only and must not exclude rows")


@dataclass(frozen=True)
class Policy:
    """Which findings exclude, and the thresholds of quality flags. Deleting isn't an option."""

    exclude_unreadable: bool = True
    exclude_missing_label: bool = True
    exclude_duplicate_id: bool = True
    classes: int = 5
    report_only: bool = True
    delete: bool = False
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.delete or not self.report_only:
            raise ValueError("quality findings are reported, never deleted")


def integrity_reason(exists: str = "exists", size: str = "size_bytes", readable: str = "readable") -> Column:
    """missing_file, zero_byte or unreadable: the first that holds."""
    return F.when(~F.col(exists), "missing_file").when(F.col(size) == 0, "zero_byte").when(~F.col(readable), "unreadable")


def integrity(df: DataFrame, policy: Policy = Policy()) -> Rule:
    reason = integrity_reason()
    return Rule("integrity", reason) if policy.exclude_unreadable else Rule("integrity", flags=F.array_compact(F.array(reason)))


def with_labels(df: DataFrame, raw: str, classes: int) -> DataFrame:
    """label_present, label and label_in_range from a text or number column."""
    present, label = integer_label(F.col(raw))
    return df.withColumns({"label_present": present, "label": label, "label_in_range": F.coalesce(label.between(0, classes - 1), F.lit(False))})


def with_repeated(df: DataFrame, *keys: str, order: str = "row_pos", name: str = "repeated") -> DataFrame:
    """name: true for every row but the first of its keys (W1); keys that are null are values like others.

    First rows are pre-aggregated and joined back. The join has a key of its own beside the keys, so that both sides are shuffled
    for it and a key that very many rows share can be split among tasks.
    """
    own = F.xxhash64(*keys)
    first = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = first.withColumn("_own", F.xxhash64(*(f"_k{i}" for i in range(len(keys)))))
    same = (own == F.col("_own")) & F.expr(" AND ".join(f"`{k}` <=> _k{i}" for i, k in enumerate(keys)))
    return df.join(first, same, "left").select(*df.columns, (F.col("_first").isNotNull() & (F.col("_first") != F.col(order))).alias(name))


def labels_rule(policy: Policy = Policy(), repeated: str = "repeated") -> Rule:
    """Within this rule the last finding wins: repeated id over out of range over missing."""
    findings = [("duplicate_id", F.col(repeated), policy.exclude_duplicate_id), ("label_out_of_range", F.col("label_present") & ~F.col("label_in_range"), policy.exclude_missing_label), ("missing_label", ~F.col("label_present"), policy.exclude_missing_label)]
    reason = F.coalesce(*(F.when(test, name) for name, test, excludes in findings if excludes), F.lit(None).cast("string"))
    return Rule("labels", reason, flags_when(**{name: test for name, test, excludes in findings if not excludes}) if any(not x for _, _, x in findings) else None)


def keeper_order(priority: Sequence[str] = ("train", "val", "test")) -> list[Column]:
    """Readable first, then by split (unknown ones last), id and row."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("split")), F.lit(0))
    return [F.desc("readable"), F.when(place == 0, len(priority) + 1).otherwise(place), F.col("id_code"), F.col("row_pos")]


def with_exact_groups(df: DataFrame, key: str = "md5", prefix: str = "md5") -> DataFrame:
    """group, size, cross-split mark and keeper of rows with one key; '' and null never group.

    Sizes are pre-aggregated by key and joined back, so that a hot key isn't sorted in one task for them.
    """
    k = F.when(F.col(key) != "", F.col(key))
    stats = df.select(k.alias("k"), "split", F.struct(*(c.alias(f"o{i}") for i, c in enumerate([(~F.col("readable")).cast("int"), *[x for x in keeper_order()[1:]]]))).alias("o")).where("k IS NOT NULL").groupBy("k").agg(
        F.count("*").alias("n"), F.min("split").alias("s0"), F.max("split").alias("s1"), F.min("o").alias("first")
    ).where("n > 1")
    # As in with_repeated: a second key makes both sides shuffles of their own, which can be split.
    joined = df.join(stats.withColumn("own", F.xxhash64("k")), (k == F.col("k")) & (F.xxhash64(k) == F.col("own")), "left")
    return joined.select(
        *df.columns,
        F.coalesce("k", F.lit("")).alias(f"{prefix}_group"),
        F.coalesce("n", F.lit(1)).cast("long").alias(f"{prefix}_group_size"),
        F.coalesce(F.col("s0") != F.col("s1"), F.lit(False)).alias(f"{prefix}_cross_split"),
        F.coalesce(F.col("first.o3") == F.col("row_pos"), F.lit(True)).alias(f"{prefix}_keeper"),
    )


def duplicates(scope: str = "all") -> Rule:
    """All but a group's keeper; scope cross: only of groups that cross splits."""
    test = ~F.col("md5_keeper") if scope == "all" else ~F.col("md5_keeper") & F.col("md5_cross_split")
    return Rule("exact_duplicates", F.when(test, F.concat(F.lit("duplicate of group "), F.substring("md5_group", 1, 12))))


def percentile_limits(df: DataFrame, percents: dict[str, float]) -> dict[str, float | None]:
    """Linear percentile of each column over measured rows; none outside (0, 100) or without rows (P5, T4, T5)."""
    asked = {c: [p / 100] for c, p in percents.items() if 0 < p < 100}
    found = percentiles(df, asked) if asked else {}
    return {c: found[c][0] if c in asked else None for c in percents}


def percentile_limit(df: DataFrame, column: str, percent: float) -> float | None:
    return percentile_limits(df, {column: percent})[column]


def quality(limits: dict[str, tuple[str, str, float | None]]) -> Rule:
    """limits: flag -> (column, '<' or '>', limit or None: disabled); a missing measurement raises no flag."""
    tests = {}
    for flag, (column, sign, limit) in limits.items():
        if limit is not None:
            tests[flag] = F.col(column) < limit if sign == "<" else F.col(column) > limit
    return Rule("quality", flags=flags_when(**tests) if tests else None, report_only=True)


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """included, exclusion_reason, exclusion_rule and quality_flags."""
    reasons = [r for r in rules if r.reason is not None]
    flags = [r.flags for r in rules if r.flags is not None]
    none = F.lit(None).cast("string")
    out = df.withColumns({
        "exclusion_reason": F.coalesce(*(r.reason for r in reasons), none),
        "exclusion_rule": F.coalesce(*(F.when(r.reason.isNotNull(), r.name) for r in reasons), none),
        "quality_flags": joined_flags(F.flatten(F.array(*flags))) if flags else F.lit(""),
    })
    return out.withColumn("included", F.col("exclusion_reason").isNull())


def flag_histogram(df: DataFrame, column: str = "quality_flags") -> DataFrame:
    return df.select(F.explode(F.split(column, "\\|")).alias("flag")).where("flag <> ''").groupBy("flag").count()


def upload_gate(df: DataFrame, min_side: int = 224, visible: float = 0.15, dark: float = 20, bright: float = 235, sharp: float = 2, color: float = 1.05) -> DataFrame:
    """blocking, warnings (blocking ones first) and acceptable, from measured columns."""
    blocking = flags_when(low_resolution=F.least("width", "height") < min_side, little_visible=F.col("visible_fraction") < visible, too_dark=F.col("brightness") < dark, too_bright=F.col("brightness") > bright)
    softer = flags_when(blurry=F.col("sharpness") < sharp, unusual_color=F.col("color_score") < color)
    return df.withColumns({"blocking": blocking, "warnings": F.concat(blocking, softer), "acceptable": F.size(blocking) == 0})
