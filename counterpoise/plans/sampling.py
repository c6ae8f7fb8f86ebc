"""``random_downsample``: an exact-size, label-first, proportional sample with its report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.config import SamplingConfig
from counterpoise.functions.columns import col
from counterpoise.operators import sampling as ops
from counterpoise.operators.coverage import recommendation
from counterpoise.sources.ingest import numbers_as_double, read
from counterpoise.sources.scratch import Workspace, row_numbers


@dataclass
class DownsampleReport:
    summary: dict[str, Any]
    classes: list[dict[str, Any]]
    strata: list[dict[str, Any]]
    balance: list[dict[str, Any]]
    bin_edges: dict[str, list[float]]
    recommendations: list[dict[str, Any]]

    def to_dict(self) -> dict[str, Any]:
        return dict(vars(self))


@dataclass
class DownsampleResult:
    """``sample``: the chosen rows with their own columns, in source order; ``row_ids``: their numbers in the source."""

    sample: DataFrame
    report: DownsampleReport
    row_ids: DataFrame
    workspace: Workspace

    def close(self) -> None:
        """Remove the stored tables that ``sample`` and ``row_ids`` read."""
        self.workspace.close()


def random_downsample(
    data: Any, *, sample_size: int, label_col: str | None = None, stratify_vars: Sequence[str] = (), check_vars: Sequence[str] = (),
    n_bins: int = 4, random_state: int | None = None, ks_threshold: float = 0.05, js_threshold: float = 0.10, check_by_label: bool = False,
    duckdb_threads: int | None = None, max_report_rows: int = 1000, work_dir: str | None = None, keep_db: bool = False,
    spark: SparkSession | None = None, order_by: Sequence[str] = (), encoding: str = "UTF-8",
) -> DownsampleResult:
    """Exactly ``sample_size`` different rows of ``data``, drawn without replacement.

    Label budgets are proportional to the labels' counts and come first; feature groups share each budget.
    Equal data in equal order, seed and settings give equal rows at any parallelism; ``order_by`` fixes the
    order where the source has none. A failed check changes neither size nor budgets: read the report.
    """
    cfg = SamplingConfig(sample_size, label_col, stratify_vars, check_vars, n_bins, random_state, ks_threshold, js_threshold, check_by_label, duckdb_threads, max_report_rows)
    spark = spark or SparkSession.active()
    df = numbers_as_double(read(spark, data, encoding))
    ops.check_input(df, cfg)
    space = Workspace(spark, work_dir, keep_db)
    try:
        with space:
            source = row_numbers(df, ops.ID, list(order_by))
            n = source.count()
            if cfg.sample_size > n:
                raise ValueError(f"sample_size ({cfg.sample_size}) exceeds population size ({n})")
            edges = ops.population_edges(source, cfg)
            pop = ops.population(source, cfg, edges)
            classes = space.store(ops.class_quotas(pop, cfg, n), "classes")
            quotas = space.store(ops.group_quotas(pop, classes, cfg), "quotas")
            chosen = space.store(ops.select_ids(pop, quotas, cfg, n), "selected")
            ops.check_selection(pop, quotas, chosen, cfg)
            balance = space.store(ops.check_population_balance(pop, chosen, cfg, n), "balance")
            report = _report(cfg, n, edges, classes, quotas, balance, pop, chosen)
            sample = space.store(source.join(chosen, ops.ID, "left_semi"), "sample")
            return DownsampleResult(sample.orderBy(ops.ID).select(*(col(c) for c in df.columns)), report, sample.select(ops.ID).orderBy(ops.ID), space)
    except BaseException:
        space.keep = False
        space.close()
        raise


def _report(cfg: SamplingConfig, n: int, edges: dict[str, list[float]], classes: DataFrame, quotas: DataFrame, balance: DataFrame, pop: DataFrame, chosen: DataFrame) -> DownsampleReport:
    top = cfg.max_report_rows
    required = {r["status"]: r["n"] for r in balance.where("required").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = F.col("quota") == 0
    of = lambda df: df.agg(F.count(F.lit(1)), F.count_if(none), F.coalesce(F.sum(F.when(none, F.col("n_population"))), F.lit(0))).first()
    (n_classes, no_class, class_rows), (n_strata, no_stratum, stratum_rows) = of(classes), of(quotas)
    status = "fail" if required.get("fail") else "pass" if required and not required.get("not_evaluated") else "not_evaluated"
    rows = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(top).collect()]
    empty_first = F.desc(F.col("allocated_rows") == 0)
    worst = F.when(F.col("status") == "fail", 0).when(F.col("status") == "not_evaluated", 1).otherwise(2)
    labelled = cfg.label_col is not None
    summary = {
        "n_population": n, "requested_rows": cfg.sample_size, "sampled_rows": cfg.sample_size, "count_invariants_passed": True, "class_budgets_passed": True if labelled else None,
        "random_state": cfg.random_state, "label_col": cfg.label_col, "stratify_vars": list(cfg.stratify_vars), "check_vars": list(cfg.check_vars), "checked_features": list(cfg.features),
        "check_by_label": cfg.check_by_label, "n_bins": cfg.n_bins, "ks_threshold": cfg.ks_threshold, "js_threshold": cfg.js_threshold, "balance_status": status,
        "feature_checks": sum(required.values()), "checks_passed": required.get("pass", 0), "checks_failed": required.get("fail", 0), "checks_not_evaluated": required.get("not_evaluated", 0),
        "n_classes": n_classes if labelled else 0, "omitted_classes": no_class if labelled else 0, "omitted_class_population_share": class_rows / n if labelled else 0.0,
        "n_strata": n_strata, "omitted_strata": no_stratum, "omitted_stratum_population_share": stratum_rows / n,
        "classes_truncated": n_classes > top, "strata_truncated": n_strata > top, "balance_truncated": balance.count() > top, "max_report_rows": top,
    }
    advice = []
    if no_stratum:
        advice.append(recommendation("sample_size", None, f"{no_stratum} feature groups got no row from proportional rounding.", "measured_allocation", "A larger sample represents more groups and takes more space."))
    if labelled and no_class:
        advice.append(recommendation("sample_size", None, f"{no_class} classes got an empty budget, which other feature bins cannot change.", "measured_allocation", "A row for every rare class would be another allocation policy."))
    if no_stratum and edges and cfg.n_bins > 2:
        advice.append(recommendation("n_bins", max(2, cfg.n_bins // 2), "Wider bins may leave fewer groups empty within the same budgets.", "untested_suggestion", "Wide groups can hide differences: check the balance again."))
    if status != "pass":
        reason = "Look at failed or unavailable checks; other grouping features or more rows may help." if required else "No feature was checked: name some to learn how representative the sample is."
        advice.append(recommendation("stratify_vars" if status == "fail" else "check_vars", None, reason, "measured_balance", "Any changed run needs its own check; size, budgets and thresholds were not touched."))
    return DownsampleReport(
        summary,
        rows(ops.class_table(classes, pop, chosen, cfg, n), empty_first, F.desc("n_population"), "label"),
        rows(ops.stratum_table(quotas, pop, chosen, cfg, n), empty_first, F.desc("n_population"), "label", "feature_group"),
        rows(balance, worst, F.desc("required"), "variable", "scope", F.asc_nulls_last("label")),
        edges, advice,
    )
