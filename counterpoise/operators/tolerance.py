"""The strength cutoff, and what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.statistics import quantiles


def strength_cutoff(assignments: DataFrame, tolerance: float) -> float:
    """The ``tolerance`` quantile of the accepted strengths; 0 without any."""
    got = quantiles(assignments, ["match_strength"], [tolerance])["match_strength"]
    return got[0] if got else 0.0


def apply_tolerance(assignments: DataFrame, cutoff: float, preserve_primary: bool = True) -> DataFrame:
    """Assignments at or above the cutoff, and (``preserve_primary``) every target's strongest one."""
    strong = F.col("match_strength") >= F.lit(float(cutoff))
    return assignments.where(strong | (F.col("match_rank") == 1) if preserve_primary else strong)


def below_tolerance(assignments: DataFrame, kept: DataFrame) -> DataFrame:
    """Targets that had an assignment and kept none."""
    return assignments.select("target_rm_id").distinct().join(kept, "target_rm_id", "left_anti")
