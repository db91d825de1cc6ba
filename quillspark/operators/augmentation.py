"""Which seeded augmentations each row gets, as rows (X10-X12): a plan that any worker can carry out on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import derive_seed
from quillspark.functions.kernels import POLICY, PRIORITY
from quillspark.sources.config import ConfigError

#: Profiles and the evidence that their steps must have.
PROFILES = {"full": ("paper", "eda", "both"), "paper_faithful": ("paper", "both")}


def policy(profile: str = "full", forbidden: Sequence[str] = ()) -> list[tuple[int, str, str, str, str]]:
    """(step, family, name, evidence, priority), geometry before photometry before corruption; a forbidden name is an error (X11)."""
    if profile not in PROFILES:
        raise ConfigError(f"unknown profile {profile}")
    if found := sorted({n.lower() for n in forbidden} & {n for _, n, _ in POLICY}):
        raise ConfigError(f"forbidden augmentations {found}")
    return [(i, f, n, e, PRIORITY.get(n, "optional")) for i, (f, n, e) in enumerate(POLICY) if e in PROFILES[profile]]


def augmentation_plan(df: DataFrame, key: str, seed: int, percent: int = 50, profile: str = "full", forbidden: Sequence[str] = ()) -> DataFrame:
    """key, step, name, evidence, priority, step_seed: a row for each augmentation that a row of df gets, each drawn with its own seed.

    A step is taken where its seed modulo 100 is under percent; seeds depend on the row's key and the step's name alone.
    """
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("step", "family", "name", "evidence", "priority"), row))) for row in policy(profile, forbidden)))
    each = df.select(F.col(key), F.explode(steps).alias("s")).select(key, "s.step", "s.name", "s.evidence", "s.priority")
    drawn = each.withColumn("step_seed", derive_seed(seed, F.concat(F.col(key).cast("string"), F.lit("/"), F.col("name"))))
    return drawn.where(F.col("step_seed") % 100 < percent)
