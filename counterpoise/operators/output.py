"""Result tables of a matching run."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.columns import col
from counterpoise.operators.balance import BalanceRow


def pair_table(rows: DataFrame, kept: DataFrame, flags: DataFrame, cutoff: float, id_col: str | None = None, below: DataFrame | None = None) -> DataFrame:
    """Kept pairs, and one row with nulls for every treated row without any.

    ``rows``: _rm_id, _treatment, _stratum (and the id column); ``flags``: stratum with no_control and
    thin_stratum; ``below``: targets that lost all to the tolerance.
    """
    own = col(id_col) if id_col else F.col("_rm_id").cast("long")
    marks = flags.select("stratum", "no_control", "thin_stratum")
    base = rows.select("_rm_id", F.col("_stratum").alias("stratum"), "_treatment", own.alias("own_id"))
    t = base.where("_treatment = 1").select(F.col("_rm_id").alias("target_rm_id"), "stratum", F.col("own_id").alias("target_id")).join(marks, "stratum", "left")
    c = base.select(F.col("_rm_id").alias("control_rm_id"), F.col("own_id").alias("control_id"))
    thin = F.coalesce("thin_stratum", F.lit(False)).alias("thin_stratum")
    pairs = kept.select("target_rm_id", "control_rm_id", "match_strength", F.col("match_rank").cast("long").alias("match_rank"))
    matched = t.join(pairs, "target_rm_id").join(c, "control_rm_id").select(
        "target_id", "control_id", "target_rm_id", "control_rm_id", "stratum", "match_strength", "match_rank",
        F.lit("matched").alias("match_status"),
        F.when(F.col("match_strength") < float(cutoff), "low_quality").otherwise("acceptable").alias("quality_status"),
        thin,
    )
    left = t.join(pairs.select("target_rm_id").distinct(), "target_rm_id", "left_anti")
    status = F.when(F.coalesce("no_control", F.lit(False)), "no_control_available")
    if below is not None:
        left = left.join(below.select("target_rm_id").distinct().withColumn("_below", F.lit(True)), "target_rm_id", "left")
        status = F.when(F.coalesce("_below", F.lit(False)), "below_tolerance").when(F.coalesce("no_control", F.lit(False)), "no_control_available")
    kind = base.schema["own_id"].dataType
    empty = left.select(
        "target_id", F.lit(None).cast(kind).alias("control_id"), "target_rm_id", F.lit(None).cast("long").alias("control_rm_id"), "stratum",
        F.lit(None).cast("double").alias("match_strength"), F.lit(None).cast("long").alias("match_rank"),
        status.otherwise("unmatched").alias("match_status"), F.lit(None).cast("string").alias("quality_status"), thin,
    )
    return matched.unionByName(empty)


def target_table(pairs: DataFrame) -> DataFrame:
    """One row for each treated row: matches, status, quality, strength of the best."""
    has = lambda status: F.bool_or(F.col("match_status") == status)
    return pairs.groupBy("target_rm_id").agg(
        F.any_value("target_id").alias("target_id"),
        F.min("stratum").alias("stratum"),
        F.count("control_rm_id").alias("n_matches"),
        F.when(has("matched"), "matched").when(has("below_tolerance"), "below_tolerance").when(has("no_control_available"), "no_control_available").otherwise("unmatched").alias("match_status"),
        F.when(F.coalesce(F.bool_or(F.col("quality_status") == "low_quality"), F.lit(False)), "low_quality").when(has("matched"), "acceptable").otherwise("none").alias("quality_status"),
        F.bool_or("thin_stratum").alias("thin_stratum"),
        F.max("match_strength").alias("best_strength"),
    )


def coverage_counts(targets: DataFrame) -> DataFrame:
    """One row: how many treated rows have which status, and shares."""
    n = lambda status: F.count_if(F.col("match_status") == status)
    share = lambda c: F.coalesce(c / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    return targets.agg(
        F.count(F.lit(1)).alias("n_target"), n("matched").alias("n_matched"), F.coalesce(F.sum("n_matches"), F.lit(0)).cast("long").alias("n_unique_controls"),
        n("no_control_available").alias("n_no_control"), n("below_tolerance").alias("n_below_tolerance"), F.count_if(F.col("quality_status") == "low_quality").alias("n_low_quality"),
        n("unmatched").alias("n_unmatched"), F.count_if("thin_stratum").alias("n_thin_stratum"),
        share(n("matched")).alias("pct_matched"), share(n("no_control_available")).alias("pct_no_control"), share(n("below_tolerance")).alias("pct_below_tolerance"),
    )


def coverage_summary(targets: DataFrame, cutoff: float) -> dict[str, Any]:
    return coverage_counts(targets).first().asDict() | {"tolerance_cutoff": cutoff}


def balance_table(before: Sequence[BalanceRow], after: Sequence[BalanceRow]) -> list[dict[str, Any]]:
    """Both checks side by side, for variables in either."""
    first, second = ({(r.variable, r.role): r for r in rows} for rows in (before, after))
    out = []
    for key in dict.fromkeys((*first, *second)):
        b, a = first.get(key), second.get(key)
        known = a or b
        out.append({"variable": known.variable, "role": known.role, "kind": known.kind, "before": b and b.statistic, "after": a and a.statistic, "threshold": known.threshold, "flagged_before": b and b.flagged, "flagged_after": a and a.flagged})
    return out
