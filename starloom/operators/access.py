"""Column modes per persona and policy comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Access modes and classes from weakest to strongest protection.
MODES = ("allow", "mask", "deny")
CLASSES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "UNKNOWN")


def persona_view(df: DataFrame, modes: Mapping[str, str]) -> DataFrame:
    """Projection a persona sees; a column without a mode is denied."""
    def shown(name: str) -> Column:
        mode = modes.get(name, "deny")
        if mode == "allow":
            return F.col(name).cast("string").alias(name)
        if mode == "mask":
            return F.mask(F.col(name).cast("string")).alias(name)
        return F.lit(None).cast("string").alias(name)

    return df.select(*[shown(c) for c in df.columns])


def policy_weakening(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that widen access, one row per (resource, column, finding).

    Columns: resource_id, column_name, mode, classification, metadata_visible, groups array.
    """
    keys = ["resource_id", "column_name"]
    b = before.select(*keys, F.struct("mode", "classification", "metadata_visible", "groups").alias("_b"))
    a = after.select(*keys, F.struct("mode", "classification", "metadata_visible", "groups").alias("_a"))
    rank = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), c)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    found = F.array_compact(F.array(
        F.when(F.col("_a").isNull(), "existing_column_removed"),
        F.when(F.col("_b").isNull() & ((F.col("_a.mode") != "deny") | F.col("_a.metadata_visible")), "new_column_not_denied"),
        F.when(both & (rank(MODES, F.col("_a.mode")) < rank(MODES, F.col("_b.mode"))), "column_protection_reduced"),
        F.when(both & (rank(CLASSES, F.col("_a.classification")) < rank(CLASSES, F.col("_b.classification"))), "classification_reduced"),
        F.when(both & ~F.col("_b.metadata_visible") & F.col("_a.metadata_visible"), "column_metadata_expanded"),
        F.when(both & (F.size(F.array_except("_a.groups", "_b.groups")) > 0), "audience_expanded")))
    return b.join(a, keys, "full_outer").select(*keys, F.explode(found).alias("finding"))


def persona_differences(expected: DataFrame, observed: DataFrame, case: Sequence[str]) -> DataFrame:
    """Cases without an observation, or whose visibility is not the expected one."""
    o = observed.select(*case, F.col("is_visible").alias("_seen"))
    j = expected.join(o, list(case), "left")
    code = F.when(F.col("_seen").isNull(), "observation_missing").when(F.col("_seen") != F.col("is_visible"), "effective_access_mismatch")
    return j.select(*case, code.alias("finding")).where("finding IS NOT NULL")
