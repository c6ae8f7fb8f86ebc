"""Exact-size proportional sampling: integer quotas by largest remainder, seeded selection, checks against the population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.config import SamplingConfig
from counterpoise.functions.columns import bucket, col, finite, is_finite, is_numeric, json_key, seeded
from counterpoise.functions.statistics import AGGREGATE_ROWS, js, ks, quantiles
from counterpoise.operators.strata import cuts
from counterpoise.sources.scratch import scratch

ID, LABEL, GROUP = "_rs_id", "_rs_label", "_rs_group"


def check_input(df: DataFrame, cfg: SamplingConfig) -> None:
    wanted = [*cfg.features, *([cfg.label_col] if cfg.label_col else [])]
    if missing := sorted({*wanted} - {*df.columns}):
        raise ValueError(f"columns not found in input: {missing}")
    if any(c.lower().startswith("_rs_") for c in df.columns):
        raise ValueError("input column names beginning with _rs_ are reserved for sampling")


def population_edges(df: DataFrame, cfg: SamplingConfig) -> dict[str, list[float]]:
    """Quantile edges of the numeric stratifying variables over all finite values."""
    return quantiles(df, [v for v in cfg.stratify_vars if is_numeric(df.schema[v].dataType)], cuts(cfg.n_bins))


def group_bin(value: Column, edges: Sequence[float]) -> Column:
    return F.when(is_finite(value), bucket(value, edges, len(edges)))


def population(source: DataFrame, cfg: SamplingConfig, edges: dict[str, list[float]]) -> DataFrame:
    """``source`` with its label and feature group as collision-free text keys."""
    parts = [group_bin(col(v), edges[v]) if v in edges else col(v) for v in cfg.stratify_vars]
    label = json_key([col(cfg.label_col)] if cfg.label_col else [])
    return source.select("*", label.alias(LABEL), json_key(parts).alias(GROUP))


def _largest_remainder(counts: DataFrame, weight: Column, whole: Column, slots: Column, by: Sequence[str], tie: Column, last: str) -> DataFrame:
    """Add ideal_quota and quota: integer shares of ``slots`` in proportion to ``weight / whole``, remainders largest first."""
    wide = counts.withColumn("_w", weight)
    based = wide.withColumn("_base", F.expr("_w div _whole")).withColumn("_rest", F.expr("_w % _whole"))
    key = list(by) or [F.lit(1)]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_rest"), tie, last))
    spare = slots - F.sum("_base").over(Window.partitionBy(*key))
    return based.withColumn("ideal_quota", F.col("_w").cast("double") / F.col("_whole").cast("double")).withColumn("quota", (F.col("_base") + F.when(place <= spare, 1).otherwise(0)).cast("long")).drop("_w", "_base", "_rest", "_whole")


def class_quotas(pop: DataFrame, cfg: SamplingConfig, n: int) -> DataFrame:
    """_rs_label, n_population, ideal_quota, quota: the label budgets, which sum to the sample's size. One row for each label."""
    counts = pop.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n_population")).withColumn("_whole", F.lit(n).cast("decimal(19,0)"))
    weight = F.col("n_population").cast("decimal(19,0)") * F.lit(cfg.sample_size).cast("decimal(19,0)")
    return _largest_remainder(counts, weight, F.col("_whole"), F.lit(cfg.sample_size), [], seeded(cfg.random_state, "class", F.col(LABEL)), LABEL)


def group_quotas(pop: DataFrame, classes: DataFrame, cfg: SamplingConfig) -> DataFrame:
    """Quotas of the feature groups inside their label's budget."""
    counts = pop.groupBy(LABEL, GROUP).agg(F.count(F.lit(1)).alias("n_population"))
    outer = classes.select(LABEL, F.col("n_population").alias("n_class"), F.col("quota").alias("class_quota"))
    joined = counts.join(outer, LABEL).withColumn("_whole", F.col("n_class").cast("decimal(19,0)"))
    weight = F.col("n_population").cast("decimal(19,0)") * F.col("class_quota").cast("decimal(19,0)")
    return _largest_remainder(joined, weight, F.col("_whole"), F.col("class_quota"), [LABEL], seeded(cfg.random_state, "group", F.col(LABEL), F.col(GROUP)), GROUP)


def select_ids(pop: DataFrame, quotas: DataFrame, cfg: SamplingConfig, n: int) -> DataFrame:
    """The sampled ``_rs_id``: of each group its quota, in the order of a seeded md5 of the id.

    A group's rows are ranked in two steps. First each of the hash's runs (its leading hex digits) is only
    counted; runs wholly inside the quota are taken, and only the run that the quota ends in is ranked, so
    no task sorts a whole group.
    """
    if cfg.sample_size == n:
        return pop.select(ID)
    keyed = pop.select(ID, LABEL, GROUP).join(quotas.where("quota > 0").select(LABEL, GROUP, "quota", "n_population"), [LABEL, GROUP])
    keyed = keyed.withColumn("_h", seeded(cfg.random_state, "row", F.col(ID).cast("string")))
    # Runs of about a few thousand rows, whatever the group's size.
    digits = F.least(F.lit(8), F.greatest(F.lit(0), F.ceil(F.ln(F.col("n_population") / 4096.0) / F.ln(F.lit(16.0))).cast("int")))
    keyed = keyed.withColumn("_run", F.col("_h").substr(F.lit(1), digits))
    runs = keyed.groupBy(LABEL, GROUP, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(LABEL, GROUP).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = keyed.join(starts, [LABEL, GROUP, "_run"]).where(F.col("_before") < F.col("quota"))
    rank = F.row_number().over(Window.partitionBy(LABEL, GROUP, "_run").orderBy("_h", ID))
    return placed.withColumn("_k", rank + F.col("_before")).where(F.col("_k") <= F.col("quota")).select(ID)


def check_selection(pop: DataFrame, quotas: DataFrame, chosen: DataFrame, cfg: SamplingConfig) -> None:
    """Raises RuntimeError unless size, uniqueness and every group's quota hold."""
    count, unique = chosen.agg(F.count(F.lit(1)), F.count_distinct(ID)).first()
    actual = pop.join(chosen, ID, "left_semi").groupBy(LABEL, GROUP).agg(F.count(F.lit(1)).alias("actual"))
    wrong = quotas.join(actual, [LABEL, GROUP], "left").where(F.coalesce("actual", F.lit(0)) != F.col("quota")).limit(1).count()
    if count != cfg.sample_size or unique != count or wrong:
        raise RuntimeError("the selection does not have the size, uniqueness or group quotas asked for")


BALANCE_COLUMNS = ("variable", "role", "scope", "label", "kind", "statistic", "threshold", "n_population", "n_sample", "n_valid_population", "n_valid_sample", "population_missing_rate", "sample_missing_rate", "status", "required")


def check_population_balance(pop: DataFrame, chosen: DataFrame, cfg: SamplingConfig, n: int) -> DataFrame:
    """Balance rows of all features, overall and, if asked for, within each label, and of the label, which is only described.

    All variables are stacked: one scan of the population makes one frequency table. A side without a valid value is not evaluated.
    """
    checks = [*((v, "feature") for v in cfg.features), *([(cfg.label_col, "label")] if cfg.label_col else [])]
    if not checks:
        kinds = ["string"] * 5 + ["double"] * 2 + ["long"] * 4 + ["double"] * 2 + ["string", "boolean"]
        return pop.sparkSession.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(BALANCE_COLUMNS, kinds, strict=True)))
    marked = pop.join(chosen.withColumn("_rs_in", F.lit(1)), ID, "left").withColumn("_rs_in", F.coalesce("_rs_in", F.lit(0)))
    cells, numeric = [], []
    for k, (var, role) in enumerate(checks):
        numeric.append(role == "feature" and is_numeric(pop.schema[var].dataType))
        valid = is_finite(col(var)) if numeric[-1] else F.lit(True)
        missing = ~valid if numeric[-1] else col(var).isNull()
        scopes = [F.lit(None).cast("string"), *([F.col(LABEL)] if cfg.check_by_label and role == "feature" else [])]
        for within, label in enumerate(scopes):
            cells.append(F.struct(F.lit(2 * k + within).alias("at"), label.alias("label"), (finite(col(var)) if numeric[-1] else F.lit(None).cast("double")).alias("x"), (F.lit(None).cast("string") if numeric[-1] else json_key([col(var)])).alias("g"), valid.alias("valid"), missing.cast("long").alias("m")))
    rows = marked.select(F.col("_rs_in").cast("long").alias("s"), F.inline(F.array(*cells)))
    by = ["at", "label"]
    counted = rows.groupBy(*by, "x", "g", "valid").agg(F.count(F.lit(1)).alias("a"), F.sum("s").alias("b"), F.sum("m").alias("pm"), F.sum(F.col("m") * F.col("s")).alias("sm"))
    freq = scratch(counted.withColumn("label", F.coalesce("label", F.lit(""))), "frequencies")
    ok = F.col("valid")
    totals = freq.groupBy(*by).agg(
        F.sum("a").alias("n_population"), F.sum("b").alias("n_sample"), F.sum(F.when(ok, F.col("a")).otherwise(0)).alias("n_valid_population"), F.sum(F.when(ok, F.col("b")).otherwise(0)).alias("n_valid_sample"),
        (F.sum("pm") / F.nullif(F.sum("a"), F.lit(0))).alias("population_missing_rate"), (F.sum("sm") / F.nullif(F.sum("b"), F.lit(0))).alias("sample_missing_rate"),
    )
    pairs = freq.where("valid")
    distributed = freq.limit(AGGREGATE_ROWS + 1).count() > AGGREGATE_ROWS
    stats = ks(pairs.where("g is null").select(*by, F.col("x").alias("value"), "a", "b"), by, distributed).unionByName(js(pairs.where("g is not null").select(*by, F.col("g").alias("value"), "a", "b"), by))
    limit = {True: float(cfg.ks_threshold), False: float(cfg.js_threshold)}
    asked = pop.sparkSession.createDataFrame(
        [(2 * k + within, var, role, "within_label" if within else "overall", "ks" if num else "js", limit[num], role == "feature") for k, ((var, role), num) in enumerate(zip(checks, numeric, strict=True)) for within in (0, 1)],
        "at int, variable string, role string, scope string, kind string, threshold double, required boolean",
    )
    out = totals.join(stats, by, "left").join(F.broadcast(asked), "at")  # two rows for each variable
    status = F.when(F.col("statistic").isNull(), "not_evaluated").when(F.col("statistic") <= F.col("threshold"), "pass").otherwise("fail")
    out = out.withColumns({"label": F.when(F.col("scope") == "overall", None).otherwise(F.col("label")), "status": status})
    return out.select(*BALANCE_COLUMNS)


def class_table(classes: DataFrame, pop: DataFrame, chosen: DataFrame, cfg: SamplingConfig, n: int) -> DataFrame:
    actual = pop.join(chosen, ID, "left_semi").groupBy(LABEL).agg(F.count(F.lit(1)).alias("_a"))
    got = F.coalesce("_a", F.lit(0)).cast("long")
    return classes.join(actual, LABEL, "left").select(F.col(LABEL).alias("label"), "n_population", "ideal_quota", F.col("quota").alias("allocated_rows"), got.alias("sampled_rows"), (F.col("n_population") / n).alias("population_share"), (got / cfg.sample_size).alias("sample_share"), (F.col("quota") - F.col("ideal_quota")).alias("rounding_deviation"))


def stratum_table(quotas: DataFrame, pop: DataFrame, chosen: DataFrame, cfg: SamplingConfig, n: int) -> DataFrame:
    actual = pop.join(chosen, ID, "left_semi").groupBy(LABEL, GROUP).agg(F.count(F.lit(1)).alias("_a"))
    got = F.coalesce("_a", F.lit(0)).cast("long")
    return quotas.join(actual, [LABEL, GROUP], "left").select(
        F.col(LABEL).alias("label"), F.col(GROUP).alias("feature_group"), "n_population", "n_class", "class_quota", "ideal_quota", F.col("quota").alias("allocated_rows"), got.alias("sampled_rows"),
        (F.col("n_population") / n).alias("population_share"), (got / cfg.sample_size).alias("sample_share"), (F.col("n_population") / F.col("n_class")).alias("within_class_population_share"), (got / F.nullif("class_quota", F.lit(0))).alias("within_class_sample_share"),
    )
