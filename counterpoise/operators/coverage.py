"""Which strata can serve their treated rows, and how far: flags, ceilings, trials, advice."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.config import MatchConfig, whole_number
from counterpoise.functions.columns import col


class InsufficientStratumCapacityWarning(UserWarning):
    """Some strata have fewer controls than their treated rows ask for."""


@dataclass
class CapacityReport:
    summary: dict[str, Any]
    strata: list[dict[str, Any]]
    bin_edges: dict[str, list[float]]
    recommendations: list[dict[str, Any]] = field(default_factory=list)
    trials: list[dict[str, Any]] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return {"summary": self.summary, "strata": self.strata, "bin_edges": self.bin_edges, "recommendations": self.recommendations, "trials": self.trials}


def least_pool(cfg: MatchConfig) -> Column:
    """Controls that a stratum needs not to be thin."""
    floor = F.lit(cfg.min_control_pool_size).cast("long")
    return floor if cfg.min_control_ratio is None else F.greatest(floor, F.ceil(F.lit(float(cfg.min_control_ratio)) * F.col("n_target")))


def flag_coverage(counts: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Strata with treated rows: no_control, thin_stratum (some controls, but few) and eligible (some controls)."""
    have = F.col("n_control") > 0
    return counts.where("n_target > 0").select("*", (~have).alias("no_control"), (have & (F.col("n_control") < least_pool(cfg))).alias("thin_stratum"), have.alias("eligible"))


def capacity_rows(counts: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Requested assignments, shortfall and upper bounds for each stratum with treated rows."""
    t, c = F.col("n_target"), F.col("n_control")
    n = F.lit(cfg.n).cast("long")
    return flag_coverage(counts, cfg).select(
        "stratum", "n_target", "n_control",
        (n * t).alias("requested_assignments"),
        F.least(n * t, c).alias("assignment_capacity_ceiling"),
        F.greatest(F.lit(0).cast("long"), n * t - c).alias("assignment_shortfall"),
        F.least(t, c).alias("targets_with_one_control_ceiling"),
        F.least(t, F.floor(c / n)).alias("fully_supplied_targets_ceiling"),
        "no_control", "thin_stratum",
    )


SUMS = ("requested_assignments", "assignment_capacity_ceiling", "assignment_shortfall", "targets_with_one_control_ceiling", "fully_supplied_targets_ceiling")


def capacity_totals(counts: DataFrame, cfg: MatchConfig) -> DataFrame:
    """One row: sums of the ceilings, totals, deficits and pair counts (pairs as decimals: they pass 2**63 early)."""
    wide = "decimal(38,0)"
    pairs = F.col("n_target").cast("decimal(19,0)") * F.col("n_control").cast("decimal(19,0)")
    limit = F.col("n_control") if cfg.max_candidates_per_target is None else F.least(F.col("n_control"), F.lit(cfg.max_candidates_per_target).cast("long"))
    kept = F.col("n_target").cast("decimal(19,0)") * limit.cast("decimal(19,0)")
    whole = counts.agg(F.sum("n_target").alias("n_target"), F.sum("n_control").alias("n_control"), F.sum(pairs).cast(wide).alias("candidate_pairs"), F.max(pairs).cast(wide).alias("largest_stratum_pairs"), F.sum(kept).cast(wide).alias("retained_candidate_pairs"))
    rows = capacity_rows(counts, cfg)
    part = rows.agg(*(F.sum(k).alias(k) for k in SUMS), F.count(F.lit(1)).alias("n_target_strata"), F.count_if(F.col("assignment_shortfall") > 0).alias("n_deficient_strata"), F.sum(F.when(F.col("assignment_shortfall") > 0, F.col("n_target")).otherwise(0)).alias("n_targets_in_deficient_strata"))
    one = F.lit(1)
    both = part.withColumn("__one", one).join(F.broadcast(whole.withColumn("__one", one)), "__one").drop("__one")
    share = lambda k: F.coalesce(F.col(k) / F.nullif("n_target", F.lit(0)), F.lit(0.0))
    return both.select(
        "*",
        F.greatest(F.lit(0).cast("long"), F.lit(cfg.n) * F.col("n_target") - F.col("n_control")).alias("global_assignment_shortfall"),
        share("targets_with_one_control_ceiling").alias("coverage_ceiling"),
        share("fully_supplied_targets_ceiling").alias("full_ratio_coverage_ceiling"),
    )


def group_values(stratified: DataFrame, keys: DataFrame, edges: Mapping[str, Sequence[float]], categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """stratum and a JSON object of what its rows have in common. ``keys``: the strata asked for, a bounded report."""
    kept = stratified.join(F.broadcast(keys.select(F.col("stratum").alias("_stratum"))), "_stratum", "left_semi")
    names = [*(f"_bin_{v}" for v in edges), *categorical, *(f"is_missing_{v}" for v in numeric)]
    firsts = kept.groupBy(F.col("_stratum").alias("stratum")).agg(*(F.any_value(col(c), F.lit(True)).alias(c) for c in names))
    fields = [col(c).alias(c) for c in (*categorical, *(f"is_missing_{v}" for v in numeric))]
    for v, e in edges.items():
        at, bounds = col(f"_bin_{v}"), F.array(*(F.lit(float(x)) for x in e)).cast("array<double>")
        fields.append(F.struct(at.alias("bin"), F.when(at > 0, F.get(bounds, at - 1)).alias("lower_exclusive"), F.get(bounds, at).alias("upper_inclusive")).alias(v))
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
    return firsts.select("stratum", value.alias("group_values"))


def grouping_diagnostics(stratified: DataFrame, cfg: MatchConfig, edges: Mapping[str, Sequence[float]], numeric: Sequence[str]) -> tuple[dict[str, int], dict[str, int]]:
    """How many groups each grouping variable makes, and how many values each numeric one lacks."""
    groups = [F.count_distinct(col(f"_bin_{v}" if v in edges else v)).alias(f"g{k}") for k, v in enumerate(cfg.grouping_vars)]
    lacks = [F.count_if(col(f"is_missing_{v}")).alias(f"m{k}") for k, v in enumerate(numeric)]
    row = stratified.agg(*groups, *lacks).first() if groups or lacks else {}
    return {v: row[f"g{k}"] for k, v in enumerate(cfg.grouping_vars)}, {v: row[f"m{k}"] for k, v in enumerate(numeric)}


def build_capacity(counts: DataFrame, cfg: MatchConfig, edges: dict[str, list[float]], stratified: DataFrame, categorical: Sequence[str], numeric: Sequence[str], max_report_strata: int = 1000, warn: bool = False) -> CapacityReport:
    """Totals of all strata, and details of the ``max_report_strata`` with the largest shortfall."""
    limit = whole_number(max_report_strata, "max_report_strata")
    totals = {k: int(v) if v is not None and not isinstance(v, float) else (v or 0) for k, v in capacity_totals(counts, cfg).first().asDict().items()}
    top = capacity_rows(counts, cfg).orderBy(F.desc("assignment_shortfall"), "stratum").limit(limit)
    rows = [r.asDict() for r in top.collect()]
    if rows:
        keys = counts.sparkSession.createDataFrame([(r["stratum"],) for r in rows], "stratum string")
        told = {r["stratum"]: r["group_values"] for r in group_values(stratified, keys, edges, categorical, numeric).collect()}
        for r in rows:
            r["group_values"] = told[r["stratum"]]
    n_strata = totals["n_target_strata"]
    summary = {k: totals[k] for k in SUMS} | {"n_target": totals["n_target"], "n_control": totals["n_control"], "n": cfg.n, "n_bins": cfg.n_bins, "stratify_vars": list(cfg.grouping_vars)}
    summary |= {k: totals[k] for k in ("n_target_strata", "n_deficient_strata", "n_targets_in_deficient_strata", "global_assignment_shortfall", "coverage_ceiling", "full_ratio_coverage_ceiling", "candidate_pairs", "largest_stratum_pairs", "retained_candidate_pairs")}
    summary |= {"strata_truncated": n_strata > limit, "reported_strata": min(n_strata, limit)}
    summary["grouping_cardinality"], summary["numeric_missing_counts"] = grouping_diagnostics(stratified, cfg, edges, numeric)
    report = CapacityReport(summary, rows, edges, advice(summary, cfg, edges))
    if warn and summary["assignment_shortfall"]:
        warnings.warn(
            f"{summary['n_deficient_strata']:,} of {n_strata:,} strata with treated rows cannot supply 1:{cfg.n} unique controls; {summary['assignment_shortfall']:,} assignments fall short and at most "
            f"{summary['fully_supplied_targets_ceiling']:,} of {summary['n_target']:,} treated rows get all of theirs. See report.capacity, and assess() for other bin counts.",
            InsufficientStratumCapacityWarning, stacklevel=4,
        )
    return report


def recommendation(setting: str, value: Any, reason: str, evidence: str, tradeoff: str, **more: Any) -> dict[str, Any]:
    return {"setting": setting, "proposed_value": value, "reason": reason, "evidence": evidence, **more, "tradeoff": tradeoff}


def advice(summary: Mapping[str, Any], cfg: MatchConfig, edges: Mapping[str, Sequence[float]]) -> list[dict[str, Any]]:
    out = []
    if summary["global_assignment_shortfall"]:
        out.append(recommendation("control_pool", cfg.n * summary["n_target"], "There are fewer controls in all than assignments asked for.", "measured_global_counts", "Additional controls are needed, and must also resemble the treated rows."))
    if summary["assignment_shortfall"]:
        if edges and cfg.n_bins > 2:
            out.append(recommendation("n_bins", max(2, cfg.n_bins // 2), "Wider numeric bins may move controls to where they are short; assess() tells.", "untested_suggestion", "Strata grow, with more pairs to score and looser balance."))
        out.append(recommendation("stratify_vars", None, "Review which numeric variables must group, how many categories there are and where values are missing.", "untested_suggestion", "Numeric variables can still score; categories and missing flags always group."))
    return out


def compare_trials(report: CapacityReport, trials: list[dict[str, Any]]) -> None:
    """Add the trials, the best of them if it beats the current setting, and a note if none is enough."""
    report.trials = trials
    key = "full_ratio_coverage_ceiling"
    better = sorted((t for t in trials if t[key] > report.summary[key]), key=lambda t: (-t[key], t["candidate_pairs"]))
    if better:
        best = better[0]
        report.recommendations.insert(0, recommendation("n_bins", best["n_bins"], "The highest full-ratio ceiling of the settings tried; fewer pairs break ties.", "measured_preflight", "A ceiling is not a result: check coverage and balance after matching.", coverage_ceiling=best["coverage_ceiling"], candidate_pairs=best["candidate_pairs"]))
    if trials and all(t[key] < 1 for t in trials):
        report.recommendations.append(recommendation("n_bins", None, "No bin count tried supplies the full ratio.", "measured_preflight", "Think about more controls, or about fewer grouping variables."))
