"""``ControlMatcher``: from a table with a treatment flag to matched pairs and their report."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.config import MatchConfig, whole_number
from counterpoise.functions.columns import col
from counterpoise.operators import assign, balance, coverage, drift, output, scoring, strata, tolerance
from counterpoise.operators.coverage import CapacityReport, recommendation
from counterpoise.operators.prepare import prepare
from counterpoise.operators.profile import DataReport, check_columns, check_treatment
from counterpoise.sources.ingest import numbers_as_double, read
from counterpoise.sources.scratch import Workspace, row_numbers


@dataclass
class Report:
    coverage: dict[str, Any]
    balance: list[dict[str, Any]]
    drift_log: list[dict[str, Any]]
    data_profile: dict[str, Any]
    capacity: CapacityReport | None = None

    def to_dict(self) -> dict[str, Any]:
        return {**vars(self), "capacity": self.capacity.to_dict() if self.capacity else None}


@dataclass
class MatchResult:
    """``pairs``: kept pairs, and treated rows without any; ``targets``: one row for each treated row. Both are stored tables."""

    pairs: DataFrame
    targets: DataFrame
    cutoff: float
    coverage_summary: dict[str, Any]
    report: Report
    workspace: Workspace
    #: variable, group, place, control_rm_id of the controls that trimming removed.
    removed: DataFrame
    prepared: DataFrame

    def create_views(self, prefix: str = "") -> list[str]:
        """Name the run's tables for SQL: prepared rows, pairs, targets, removed. The views end with the session or ``close``."""
        tables = {"prepared": self.prepared, "pairs": self.pairs, "targets": self.targets, "removed": self.removed}
        for name, df in tables.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in tables]

    def close(self) -> None:
        """Remove the stored tables."""
        self.workspace.close()


def resident_mb() -> int:
    """What the driver's Python holds, in MB; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    except OSError:
        return 0


#: The stages of a run, as its log and its progress lines name them, with a hint of what they do.
STAGES = {"profile": "one scan", "strata": "bins and counts", "match": "greedy assignment", "tolerance": "cutoff", "balance": "first check", "drift": "trimming", "output": "result tables"}


@dataclass
class Matched:
    """What a run has found before its tables are put together."""

    rows: DataFrame
    counts: DataFrame
    flags: DataFrame
    assignments: DataFrame
    numeric: list[str]
    categorical: list[str]
    edges: dict[str, list[float]] = field(default_factory=dict)


class ControlMatcher:
    """Runs one ``MatchConfig``. After a run ``bin_edges`` and ``cutoff`` hold what was measured."""

    def __init__(self, config: MatchConfig, spark: SparkSession | None = None):
        self.config, self._spark = config, spark
        self.bin_edges: dict[str, list[float]] = {}
        self.cutoff: float | None = None

    def _log(self, stage: str, **facts: Any) -> None:
        """``verbose``: a line for each stage that is over, with its facts, the time and memory; ``progress``: how far the run is."""
        if self.config.verbose:
            print(f"{time.strftime('%H:%M:%S')} {stage} " + " ".join(f"{k}={v}" for k, v in facts.items()) + f" rss_mb={resident_mb()}", file=sys.stderr)
        if self.config.progress:
            print(f"[{list(STAGES).index(stage) + 1}/{len(STAGES)}] {stage}: {STAGES[stage]}", file=sys.stderr)

    def _read(self, data: Any, encoding: str) -> tuple[DataFrame, dict[str, Any], list[str], list[str]]:
        """The input, its profile, and its match variables by kind."""
        cfg, spark = self.config, self._spark or SparkSession.active()
        plain = numbers_as_double(read(spark, data, encoding), (cfg.id_col,) if cfg.id_col else ())
        numeric, categorical = check_columns(plain, cfg)
        profile = DataReport(plain, cfg.treatment_col).summary()
        check_treatment(profile["treatment_values"], cfg.treatment_col)
        return plain, profile, numeric, categorical

    def _wanted(self, df: DataFrame) -> DataFrame:
        """The columns that a run has a use for."""
        cfg = self.config
        used = {cfg.treatment_col, *cfg.match_vars, *cfg.monitor_vars, cfg.id_col}
        return df.select(*(col(c) for c in df.columns if c in used))

    def assess(self, data: Any, *, n_bins_candidates: Sequence[int] | None = None, max_report_strata: int = 1000, work_dir: str | None = None, order_by: Sequence[str] = (), encoding: str = "UTF-8") -> CapacityReport:
        """Capacity of the current setting and of other bin counts, without scoring or matching. The matcher stays as it is."""
        cfg = self.config
        tried = [whole_number(v, "n_bins_candidates", 2) for v in n_bins_candidates or []]
        source, _, numeric, categorical = self._read(data, encoding)
        space = Workspace(source.sparkSession, work_dir)
        try:
            with space:  # counts need no row numbers, so ``order_by`` has nothing to do here
                prepared = space.store(prepare(self._wanted(source), cfg.treatment_col, numeric, categorical), "prepared")
                grouped = [v for v in numeric if v in cfg.grouping_vars]
                reports = []
                for bins in dict.fromkeys((cfg.n_bins, *tried)):
                    edges = strata.target_edges(prepared, grouped, bins)
                    rows = strata.stratify(prepared, edges, categorical, numeric, bins)
                    counts = space.store(strata.stratum_counts(rows), "counts")
                    reports.append(coverage.build_capacity(counts, replace(cfg, n_bins=bins), edges, rows, categorical, numeric, max_report_strata))
        finally:
            space.close()
        if tried:
            coverage.compare_trials(reports[0], [r.summary for r in reports])
        return reports[0]

    def _match(self, source: DataFrame, numeric: list[str], categorical: list[str], space: Workspace) -> Matched:
        cfg = self.config
        prepared = prepare(source, cfg.treatment_col, numeric, categorical)
        edges = strata.target_edges(prepared, [v for v in numeric if v in cfg.grouping_vars], cfg.n_bins)
        moments = scoring.target_moments(prepared, numeric)
        rows = space.store(strata.stratify(prepared, edges, categorical, numeric, cfg.n_bins), "stratified")
        counts = space.store(strata.stratum_counts(rows), "counts")
        self._log("strata", strata=counts.count())
        flags = space.store(coverage.flag_coverage(counts, cfg), "flags")
        x = scoring.point(numeric, moments, cfg.weights)
        points = rows.select(F.col("_stratum").alias("stratum"), F.col("_rm_id").alias("id"), x.alias("x"), "_treatment").join(flags.where("eligible").select("stratum"), "stratum", "left_semi")
        got = assign.assign(points.where("_treatment = 1").drop("_treatment"), points.where("_treatment = 0").drop("_treatment"), flags.where("eligible").select("stratum", "n_target", "n_control"), cfg.n, cfg.max_candidates_per_target)
        return Matched(rows, counts, flags, space.store(got, "assignments"), numeric, categorical, edges)

    def fit_match(self, data: Any, work_dir: str | None = None, keep_db: bool = False, order_by: Sequence[str] = (), encoding: str = "UTF-8") -> MatchResult:
        """Match ``data`` (a path, a table's name, or a Spark, pandas or Arrow table).

        ``order_by`` fixes the row numbers where the source has no order of its own; ``encoding`` is that of a text file.
        All intermediate tables go to ``work_dir`` and are removed with ``result.close()``, or at once if the run fails.
        """
        plain, profile, numeric, categorical = self._read(data, encoding)
        self._log("profile", rows=profile["n_rows"], target=profile["n_target"], untreated=profile["n_control"])
        space = Workspace(plain.sparkSession, work_dir, keep_db)
        try:
            with space:
                # The order's columns may be others than the run's: they go once the rows are numbered.
                kept = [c for c in plain.columns if c in {*self._wanted(plain).columns, *order_by}]
                source = row_numbers(plain.select(*map(col, kept)), "_rm_id", list(order_by))
                return self._finish(source, profile, numeric, categorical, space)
        except BaseException:
            space.keep = False
            space.close()
            raise

    def _finish(self, source: DataFrame, profile: dict[str, Any], numeric: list[str], categorical: list[str], space: Workspace) -> MatchResult:
        cfg = self.config
        m = self._match(source, numeric, categorical, space)
        self.bin_edges = m.edges
        capacity = coverage.build_capacity(m.counts, cfg, m.edges, m.rows, categorical, numeric, warn=True)
        n_assigned = m.assignments.count()
        capacity.summary["assignments_before_tolerance"] = n_assigned
        s = capacity.summary
        if cfg.max_candidates_per_target is not None and n_assigned < s["assignment_capacity_ceiling"] and s["retained_candidate_pairs"] < s["candidate_pairs"]:
            capacity.recommendations.append(recommendation("max_candidates_per_target", 2 * cfg.max_candidates_per_target, "With the cap fewer controls were assigned than the strata could supply; a larger cap may help.", "untested_suggestion", "More pairs are kept, and full coverage is still not certain."))
        self._log("match", assigned=n_assigned)
        self.cutoff = tolerance.strength_cutoff(m.assignments, cfg.tolerance)
        kept = tolerance.apply_tolerance(m.assignments, self.cutoff)
        capacity.summary["assignments_after_tolerance"] = kept.count()
        self._log("tolerance", cutoff=self.cutoff, kept=capacity.summary["assignments_after_tolerance"])

        shown = [c for c in dict.fromkeys((*cfg.match_vars, *cfg.monitor_vars))]
        treated = m.rows.where("_treatment = 1").select("_rm_id", *map(col, shown))
        chosen = m.rows.select("_rm_id", *map(col, shown)).join(kept.select(F.col("control_rm_id").alias("_rm_id"), "match_strength"), "_rm_id")
        chosen = space.store(chosen, "chosen")
        check = lambda controls: balance.check_balance(treated, controls, cfg.match_vars, cfg.monitor_vars, cfg.js_threshold, cfg.ks_threshold)
        before = check(chosen)
        flagged = [r for r in before if r.role == "monitor" and r.flagged]
        self._log("balance", flagged=len(flagged))
        left, events = drift.correct_drift(treated, chosen, flagged, cfg.n_bins)
        if events:
            left = space.store(left, "left")
            kept = kept.join(left.select(F.col("_rm_id").alias("control_rm_id")), "control_rm_id", "left_semi")
        removed = sum(e.n_removed for e in events)
        capacity.summary |= {"assignments_after_drift": kept.count(), "drift_removed": removed}
        if removed:
            capacity.recommendations.append(recommendation("monitor_vars", None, "See report.drift_log for the groups whose surplus controls were removed.", "measured_drift_removals", "Balance was bought with coverage; other bins alone are no proven remedy."))
        after = check(left) if events else before
        self._log("drift", removed=removed)

        pairs = space.store(output.pair_table(m.rows, kept, m.flags, self.cutoff, cfg.id_col), "pairs")
        targets = space.store(output.target_table(pairs), "targets")
        summary = output.coverage_summary(targets, self.cutoff)
        log = [e.to_dict() for e in events]
        gone = space.store(drift.removed_rows(treated.sparkSession, events), "removed")
        report = Report(summary, output.balance_table(before, after), log, profile, capacity)
        self._log("output", matched=summary["n_matched"], pct_matched=summary["pct_matched"])
        ordered = pairs.orderBy("target_rm_id", F.asc_nulls_last("match_rank"))
        return MatchResult(ordered, targets.orderBy("target_rm_id"), self.cutoff, summary, report, space, gone, m.rows)
