"""The registered queries, one for each operator, and the SQL that gives the same rows.

Matching runs on customers: those of the BUILDING segment are treated, balance and region group, the
nation is monitored. Downsampling runs on events, with the event type as label.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.config import MatchConfig, SamplingConfig
from counterpoise.functions.statistics import quantiles
from counterpoise.operators import assign, balance, coverage, drift, output, sampling, scoring, strata, tolerance
from counterpoise.operators.analysis import analysis_table, column_shares, ecdf, feature_profile, group_means, histogram, id_profile, seeded_draw, status_counts
from counterpoise.operators.prepare import prepare
from counterpoise.operators.profile import DataReport
from counterpoise.plans.matching import ControlMatcher, Matched
from counterpoise.plans.oracles import ORACLES
from counterpoise.plans.sampling import random_downsample
from counterpoise.sources.ingest import numbers_as_double, read, table_to_arrow
from counterpoise.sources.prepared import cached_source, export_sample, read_headerless, tail_holdout, write_zstd
from counterpoise.sources.scratch import row_numbers, workspace

SEED = 42
__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Customers with their region and the treatment flag; ``gaps`` blanks some values."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))  # 25 nations
    df = c.join(F.broadcast(places), c.c_nationkey == F.col("n_nationkey"))
    flag = (F.col("c_mktsegment") == "BUILDING").cast("double")
    balance_, region = F.col("c_acctbal"), F.col("region")
    if gaps:
        balance_ = F.when(F.col("c_custkey") % 17 != 0, balance_)
        region = F.when(F.col("c_custkey") % 23 != 0, region)
        flag = F.when(F.col("c_custkey") % 31 != 0, flag)
    return df.select("c_custkey", balance_.alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"), region.alias("region"), flag.alias("is_target"))


def config(**more) -> MatchConfig:
    return MatchConfig(**({"match_vars": ["c_acctbal", "region"], "treatment_col": "is_target", "monitor_vars": ["c_nationkey"], "id_col": "c_custkey"} | more))


def numbered(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    return row_numbers(customers(spark, sf_dir, gaps), "_rm_id", ["c_custkey"])


def prepared(spark: SparkSession, sf_dir: str, gaps: bool = False, ids: bool = False) -> DataFrame:
    """Prepared customers; ``ids``: with row numbers, which take a sort."""
    return prepare((numbered if ids else customers)(spark, sf_dir, gaps), "is_target", ["c_acctbal"], ["region"])


def stratified(spark: SparkSession, sf_dir: str, gaps: bool = False, n_bins: int = 4, ids: bool = False) -> tuple[DataFrame, dict[str, list[float]]]:
    rows = prepared(spark, sf_dir, gaps, ids)
    edges = strata.target_edges(rows, ["c_acctbal"], n_bins)
    return strata.stratify(rows, edges, ["region"], ["c_acctbal"], n_bins), edges


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.stratum_counts(stratified(spark, sf_dir)[0])


@dataclass
class Scene:
    cfg: MatchConfig
    found: Matched
    cutoff: float
    kept: DataFrame

    def targets(self) -> DataFrame:
        return self.found.rows.where("_treatment = 1").select("_rm_id", "c_acctbal", "region", "c_nationkey")

    def controls(self) -> DataFrame:
        strong = self.kept.select(F.col("control_rm_id").alias("_rm_id"), "match_strength")
        return self.found.rows.select("_rm_id", "c_acctbal", "region", "c_nationkey").join(strong, "_rm_id")


def scene(spark: SparkSession, sf_dir: str, **more) -> Scene:
    cfg = config(**more)
    found = ControlMatcher(cfg)._match(numbered(spark, sf_dir), ["c_acctbal"], ["region"], workspace(spark))
    cutoff = tolerance.strength_cutoff(found.assignments, cfg.tolerance)
    return Scene(cfg, found, cutoff, tolerance.apply_tolerance(found.assignments, cutoff))


# ---------------------------------------------------------------- matching


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = DataReport(customers(spark, sf_dir, True), "is_target").summary()
    names = ("n_rows", "n_target", "n_control", "n_treatment_null", "n_numeric", "n_categorical")
    return spark.createDataFrame([tuple(s[k] for k in names)], ", ".join(f"{k} long" for k in names))


def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = DataReport(customers(spark, sf_dir, True), "is_target").summary()
    return spark.createDataFrame([(c, n, round(s["null_rates"][c], 9)) for c, n in s["null_counts"].items()], "variable string, n_null long, null_rate double")


def treatment_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, True, True).select(F.col("_rm_id").alias("rm_id"), F.col("_treatment").alias("treatment"), "c_acctbal", "region", "c_custkey")


def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, True).groupBy(F.col("is_missing_c_acctbal").alias("balance_missing"), (F.col("region") == "__MISSING__").alias("region_missing")).agg(F.count(F.lit(1)).alias("n"))


def bin_edges_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = strata.target_edges(prepared(spark, sf_dir), ["c_acctbal", "c_nationkey"], 4)
    return spark.createDataFrame([(v, k, round(x, 6)) for v, e in edges.items() for k, x in enumerate(e, 1)], "variable string, k int, edge double")


def bin_edges_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = quantiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], strata.cuts(5))
    return spark.createDataFrame([(v, k, round(x, 6)) for v, e in edges.items() for k, x in enumerate(e, 1)], "variable string, k int, edge double")


def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stratified(spark, sf_dir)
    return rows.select("c_custkey", F.col("_bin_c_acctbal").alias("bin"))


def stratum_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stratified(spark, sf_dir, True)
    return rows.select("c_custkey", F.col("_stratum").alias("stratum"))


def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.flag_coverage(counts(spark, sf_dir), config(min_control_pool_size=40, min_control_ratio=4.0))


def capacity_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.capacity_rows(counts(spark, sf_dir), config(n=4))


def capacity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = coverage.capacity_totals(counts(spark, sf_dir), config(n=4, max_candidates_per_target=10))
    shares = ("coverage_ceiling", "full_ratio_coverage_ceiling")
    return totals.select(*(F.round(c, 9).alias(c) if c in shares else F.col(c).cast("long").alias(c) for c in totals.columns))


def capacity_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ControlMatcher(config(n=4)).assess(customers(spark, sf_dir), n_bins_candidates=[2, 8], order_by=["c_custkey"])
    names = ("n_bins", "n_target_strata", "assignment_shortfall", "fully_supplied_targets_ceiling", "candidate_pairs")
    return spark.createDataFrame([tuple(int(t[k]) for k in names) for t in report.trials], ", ".join(f"{k} long" for k in names))


def grouping_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = stratified(spark, sf_dir, True)
    groups, lacks = coverage.grouping_diagnostics(rows, config(), edges, ["c_acctbal"])
    return spark.createDataFrame([("groups", v, n) for v, n in groups.items()] + [("missing", v, n) for v, n in lacks.items()], "kind string, variable string, n long")


def stratum_group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = stratified(spark, sf_dir)
    keys = strata.stratum_counts(rows).where("n_target > 0").orderBy("stratum").limit(1000).select("stratum")
    told = coverage.group_values(rows, keys, edges, ["region"], ["c_acctbal"])
    value = lambda p: F.get_json_object("group_values", p)
    return told.select("stratum", value("$.region").alias("region"), value("$.c_acctbal.bin").cast("int").alias("bin"), F.round(value("$.c_acctbal.lower_exclusive").cast("double"), 6).alias("lower_exclusive"), F.round(value("$.c_acctbal.upper_inclusive").cast("double"), 6).alias("upper_inclusive"))


def target_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.target_moments(prepared(spark, sf_dir), ["c_acctbal", "c_nationkey"])
    return spark.createDataFrame([(v, round(a, 6), round(s, 6)) for v, (a, s) in m.items()], "variable string, mean double, std double")


def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir)
    z = scoring.point(["c_acctbal"], scoring.target_moments(rows, ["c_acctbal"]), {"c_acctbal": 1.5})
    return rows.select("c_custkey", F.round(z[0], 6).alias("z"))


def _sides(spark: SparkSession, sf_dir: str, x: Column | None = None) -> tuple[DataFrame, DataFrame]:
    rows, _ = stratified(spark, sf_dir, ids=True)
    if x is None:
        x = scoring.point(["c_acctbal"], scoring.target_moments(rows, ["c_acctbal"]), {})
    points = rows.select(F.col("_stratum").alias("stratum"), F.col("_rm_id").alias("id"), x.alias("x"), "_treatment")
    return points.where("_treatment = 1"), points.where("_treatment = 0")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scoring.candidate_pairs(*_sides(spark, sf_dir), 1)
    millionths = F.col("match_strength") * 1e6  # F.round takes a BigDecimal for each of the many rows
    whole = F.floor(millionths)
    return pairs.select("stratum", "target_rm_id", "control_rm_id", ((whole + (millionths - whole >= 0.5).cast("long")) / 1e6).alias("match_strength"))


def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assign.nearest(*_sides(spark, sf_dir), 3)
    return pairs.select("stratum", "target_rm_id", "control_rm_id", F.round("match_strength", 6).alias("match_strength"))


def nearest_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assign.nearest(*_sides(spark, sf_dir), 1)
    return pairs.select("target_rm_id", "control_rm_id", F.round("match_strength", 6).alias("match_strength"))


def _assigned(spark: SparkSession, sf_dir: str, budget: int = assign.PAIR_BUDGET, **more) -> DataFrame:
    t, c = _sides(spark, sf_dir)
    cfg = config(**more)
    got = assign.assign(t.drop("_treatment"), c.drop("_treatment"), counts(spark, sf_dir).where("n_target > 0 and n_control > 0"), cfg.n, cfg.max_candidates_per_target, budget)
    return got.select("stratum", "target_rm_id", "control_rm_id", F.round("match_strength", 6).alias("match_strength"), "match_rank")


def greedy_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


def greedy_assign_1to2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, n=2)


def greedy_assign_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in rounds of mutual bests, as for strata too large for one task."""
    return _assigned(spark, sf_dir, budget=0)


def _assigned_with_ties(spark: SparkSession, sf_dir: str, x: Column) -> DataFrame:
    t, c = _sides(spark, sf_dir, x)
    got = assign.assign(t.drop("_treatment"), c.drop("_treatment"), counts(spark, sf_dir).where("n_target > 0 and n_control > 0"), 2, None, 0, 4)
    return got.select("stratum", "target_rm_id", "control_rm_id", F.round("match_strength", 6).alias("match_strength"), "match_rank")


def greedy_assign_rounds_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole thousands of balance: most pairs have as strong ones beside them. Four rounds at most."""
    return _assigned_with_ties(spark, sf_dir, F.array(F.floor(F.col("c_acctbal") / 1000).cast("double")))


def greedy_assign_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a number to tell rows apart all pairs of a stratum are equal: one round."""
    return _assigned_with_ties(spark, sf_dir, F.array().cast("array<double>"))


def greedy_assign_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, max_candidates_per_target=3)


def tolerance_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(scene(spark, sf_dir, n=2).cutoff, 6),)], "cutoff double")


def tolerance_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scene(spark, sf_dir, n=2)
    return s.kept.select("target_rm_id", "control_rm_id", "match_rank", F.round("match_strength", 6).alias("match_strength"))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[Scene, DataFrame]:
    s = scene(spark, sf_dir, tolerance=0.2)
    return s, output.pair_table(s.found.rows, s.kept, s.found.flags, s.cutoff, "c_custkey")


def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)[1].withColumn("match_strength", F.round("match_strength", 6))


def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.target_table(_pairs(spark, sf_dir)[1]).withColumn("best_strength", F.round("best_strength", 6))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pairs = _pairs(spark, sf_dir)
    one = output.coverage_counts(output.target_table(pairs)).withColumn("tolerance_cutoff", F.lit(s.cutoff))
    return one.select(*(F.round(c, 6).alias(c) if c.startswith(("pct", "tol")) else F.col(c) for c in one.columns))


def _balance(s: Scene, names: list[str], monitors: list[str]) -> DataFrame:
    return balance.balance_rows(s.targets(), s.controls(), names, monitors).select("variable", "role", "kind", F.round("statistic", 6).alias("statistic"))


def balance_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(scene(spark, sf_dir), ["c_acctbal"], ["c_nationkey"])


def balance_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    rows = lambda t: c.where(F.col("is_target") == t)
    return balance.balance_rows(rows(1), rows(0), ["region"], []).select("variable", "role", "kind", F.round("statistic", 6).alias("statistic"))


def balance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after the trimming of a whole run."""
    result = ControlMatcher(config(tolerance=0.2)).fit_match(customers(spark, sf_dir), order_by=["c_custkey"])
    rows = [(r["variable"], r["role"], r["kind"], round(r["before"], 6), round(r["after"], 6), r["threshold"], r["flagged_before"], r["flagged_after"]) for r in result.report.balance]
    result.close()
    return spark.createDataFrame(rows, "variable string, role string, kind string, before double, after double, threshold double, flagged_before boolean, flagged_after boolean")


def drift_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scene(spark, sf_dir)
    return drift.excess_groups(s.targets(), s.controls(), "c_nationkey", "ks").select("group", F.round("target_share", 6).alias("target_share"), F.round("control_share", 6).alias("control_share"), "excess_rows")


def drift_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scene(spark, sf_dir)
    return drift.trim(s.targets(), s.controls(), "c_nationkey", "ks").select(F.col("_rm_id").alias("control_rm_id"), "group")


def _run(spark: SparkSession, sf_dir: str, **more):
    return ControlMatcher(config(**({"tolerance": 0.2} | more))).fit_match(customers(spark, sf_dir), order_by=["c_custkey"])


def match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of a run's pairs as they are published."""
    result = _run(spark, sf_dir, n=2, ks_threshold=1.0, js_threshold=1.0)
    rows = [(k, r["target_rm_id"], r["match_rank"]) for k, r in enumerate(result.pairs.select("target_rm_id", "match_rank").collect(), 1)]  # a report on bounded tables
    result.close()
    return spark.createDataFrame(rows, "place long, target_rm_id long, match_rank long")


def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _run(spark, sf_dir, tolerance=0.8, ks_threshold=0.01)
    rows = [(e["variable"], e["kind"], e["group"], e["n_removed"], round(e["target_share"], 6), round(e["control_share_before"], 6), ",".join(map(str, e["control_rm_ids"]))) for e in result.report.drift_log]
    result.close()
    return spark.createDataFrame(rows, "variable string, kind string, group string, n_removed long, target_share double, control_share double, control_rm_ids string")


def capacity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata that lack most controls, in order, up to a bound."""
    report = ControlMatcher(config(n=4)).assess(customers(spark, sf_dir), max_report_strata=5)
    return spark.createDataFrame([(k, r["stratum"], r["assignment_shortfall"]) for k, r in enumerate(report.strata, 1)], "place long, stratum string, assignment_shortfall long")


def capacity_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ControlMatcher(config(n=6)).assess(customers(spark, sf_dir))
    return spark.createDataFrame([(r["setting"], r["proposed_value"], r["evidence"]) for r in report.recommendations], "setting string, proposed_value long, evidence string")


def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's tables, asked by name in SQL."""
    result = _run(spark, sf_dir)
    result.create_views("cp_")
    return spark.sql("SELECT p._stratum AS stratum, count(DISTINCT t.target_rm_id) AS n_target, count(t.control_rm_id) AS n_pairs FROM cp_pairs t JOIN cp_prepared p ON p._rm_id = t.target_rm_id GROUP BY p._stratum")


# ---------------------------------------------------------------- sources


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through every reader: rows, sum of keys, and sum of balances as doubles."""
    base = customers(spark, sf_dir).select("c_custkey", "c_acctbal", "region")
    folder = f"{workspace(spark).path}/sources-{uuid.uuid4().hex[:8]}"
    base.write.option("header", True).csv(f"{folder}/a.csv")
    base.write.option("header", True).option("sep", "\t").csv(f"{folder}/a.tsv")
    base.write.parquet(f"{folder}/a.parquet")
    base.createOrReplaceTempView("cp_customers")
    given = {"csv": f"{folder}/a.csv", "tsv": f"{folder}/a.tsv", "parquet": f"{folder}/a.parquet", "table": "cp_customers", "arrow": table_to_arrow(spark, "cp_customers"), "pandas": base.toPandas(), "spark": base}
    one = lambda name, data: numbers_as_double(read(spark, data)).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").cast("long").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_distinct("region").alias("n_regions"))
    return reduce(DataFrame.unionByName, (one(name, data) for name, data in given.items()))


def latin1_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in another encoding than UTF-8, through a public entry point."""
    folder = f"{workspace(spark).path}/latin-{uuid.uuid4().hex[:8]}/a.csv"
    region = F.concat(F.lit("Übersee "), F.col("region"))
    customers(spark, sf_dir).withColumn("region", region).write.option("header", True).option("encoding", "ISO-8859-1").csv(folder)
    report = ControlMatcher(config()).assess(folder, encoding="ISO-8859-1")
    rows = [(json.loads(r["group_values"])["region"], r["n_target"]) for r in report.strata]
    return spark.createDataFrame(rows, "region string, n_target long").groupBy("region").agg(F.sum("n_target").alias("n_target"))


def zstd_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed file without header, held out by its tail, written with zstd and read again."""
    folder = f"{workspace(spark).path}/holdout-{uuid.uuid4().hex[:8]}"
    table(spark, sf_dir, "labels").select("quality", "toxic", "doc_id").orderBy("doc_id").coalesce(1).write.option("compression", "gzip").csv(f"{folder}/in.csv.gz")
    train, held = tail_holdout(read_headerless(spark, f"{folder}/in.csv.gz", ["quality", "toxic", "doc_id"]), 20, "quality")
    for name, df in (("train", train), ("held_out", held)):
        write_zstd(df, f"{folder}/{name}")
    back = cached_source(spark, f"{folder}/train", lambda s, p: s.read.parquet(p), folder).withColumn("side", F.lit("train")).unionByName(spark.read.parquet(f"{folder}/held_out").withColumn("side", F.lit("held_out")))
    return back.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("source_row_id").alias("first"), F.max("source_row_id").alias("last"), F.sum("doc_id").cast("long").alias("ids"))


# ---------------------------------------------------------------- downsampling


def sampling_config(**more) -> SamplingConfig:
    return SamplingConfig(**({"sample_size": 500, "label_col": "event_type", "stratify_vars": ["value"], "check_vars": ["user_id"], "n_bins": 4, "random_state": SEED, "check_by_label": True} | more))


@dataclass
class Draw:
    cfg: SamplingConfig
    n: int
    pop: DataFrame
    classes: DataFrame
    quotas: DataFrame
    chosen: DataFrame


def draw(spark: SparkSession, sf_dir: str, **more) -> Draw:
    cfg = sampling_config(**more)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("user_id"))
    source = row_numbers(events, sampling.ID, ["event_id"])
    n = source.count()
    pop = sampling.population(source, cfg, sampling.population_edges(source, cfg))
    space = workspace(spark)
    classes = space.store(sampling.class_quotas(pop, cfg, n), "classes")
    quotas = space.store(sampling.group_quotas(pop, classes, cfg), "quotas")
    chosen = space.store(sampling.select_ids(pop, quotas, cfg, n), "selected")
    sampling.check_selection(pop, quotas, chosen, cfg)
    return Draw(cfg, n, pop, classes, quotas, chosen)


def sample_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draw(spark, sf_dir)
    rows = sampling.class_table(d.classes, d.pop, d.chosen, d.cfg, d.n)
    return rows.select("label", "n_population", F.round("ideal_quota", 6).alias("ideal_quota"), "allocated_rows", "sampled_rows", F.round("population_share", 9).alias("population_share"), F.round("rounding_deviation", 6).alias("rounding_deviation"))


def sample_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(spark, sf_dir).quotas.select(F.col("_rs_label").alias("label"), F.col("_rs_group").alias("feature_group"), "n_population", "n_class", "class_quota", F.round("ideal_quota", 6).alias("ideal_quota"), "quota")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draw(spark, sf_dir)
    return d.pop.join(d.chosen, sampling.ID, "left_semi").select(F.col("_rs_id").alias("row_id"), "event_id", "event_type", F.round("value", 6).alias("value"))


def sample_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without label and groups: the plain seeded draw."""
    d = draw(spark, sf_dir, sample_size=100, label_col=None, stratify_vars=[], check_vars=[], check_by_label=False)
    return d.chosen.select(F.col("_rs_id").alias("row_id"))


def sample_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the population's size is the population."""
    n = table(spark, sf_dir, "events").count()
    d = draw(spark, sf_dir, sample_size=n)
    return d.chosen.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_rs_id").alias("n_different"), F.max("_rs_id").alias("last"))


def _checks(d: Draw) -> DataFrame:
    return sampling.check_population_balance(d.pop, d.chosen, d.cfg, d.n)


def sample_balance_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checks(draw(spark, sf_dir)).where("scope = 'overall'")
    return rows.select("variable", "role", "kind", F.round("statistic", 6).alias("statistic"), "n_population", "n_sample", "n_valid_population", "n_valid_sample", "status", "required")


def sample_balance_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checks(draw(spark, sf_dir)).where("scope = 'within_label'")
    return rows.select("variable", "label", "kind", F.round("statistic", 6).alias("statistic"), "n_population", "n_sample", "status")


def sample_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(draw(spark, sf_dir)).where("required").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sample_strata_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draw(spark, sf_dir, sample_size=37)
    rows = sampling.stratum_table(d.quotas, d.pop, d.chosen, d.cfg, d.n)
    return rows.select("label", "feature_group", "allocated_rows", "sampled_rows", F.round("population_share", 9).alias("population_share"), F.round("within_class_population_share", 9).alias("within_class_population_share"), F.round("within_class_sample_share", 9).alias("within_class_sample_share"))


def _downsample(spark: SparkSession, sf_dir: str, **more):
    c = sampling_config(**more)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    return random_downsample(events, sample_size=c.sample_size, label_col=c.label_col, stratify_vars=c.stratify_vars, check_vars=c.check_vars, n_bins=c.n_bins, random_state=c.random_state, check_by_label=c.check_by_label, spark=spark, order_by=["event_id"])


def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public call: the sample's rows, at the places they are published at."""
    result = _downsample(spark, sf_dir)
    rows = [(k, int(r["event_id"]), r["event_type"]) for k, r in enumerate(result.sample.select("event_id", "event_type").collect(), 1)]  # sample_size rows
    result.close()
    return spark.createDataFrame(rows, "place long, event_id long, event_type string")


def downsample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _downsample(spark, sf_dir, sample_size=37)
    names = ("n_population", "requested_rows", "sampled_rows", "n_classes", "omitted_classes", "n_strata", "omitted_strata", "feature_checks")
    s = result.report.summary
    result.close()
    return spark.createDataFrame([tuple(int(s[k]) for k in names) + (round(s["omitted_stratum_population_share"], 9),)], ", ".join(f"{k} long" for k in names) + ", omitted_share double")


def downsample_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported files, read again."""
    result = _downsample(spark, sf_dir, sample_size=120)
    at = export_sample(result, f"{workspace(spark).path}/export-{uuid.uuid4().hex[:8]}")
    manifest = spark.read.option("multiLine", True).json(f"{at}/manifest.json").first()
    result.close()
    return spark.read.parquet(f"{at}/sample.parquet").select(F.col("event_id").cast("long").alias("event_id"), F.lit(manifest["rows"]).cast("long").alias("manifest_rows"))


# ---------------------------------------------------------------- analysis


def ab_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' value of treated customers, their controls and everybody else."""
    s = scene(spark, sf_dir)
    names = s.found.rows.select("_rm_id", "c_custkey", "_treatment").join(s.kept.select(F.col("control_rm_id").alias("_rm_id"), F.lit(True).alias("_in")), "_rm_id", "left")
    groups = names.select("c_custkey", F.when(F.col("_treatment") == 1, "treated").when(F.col("_in"), "control").otherwise("rest").alias("arm"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return group_means(orders.join(groups, "c_custkey"), "arm", ["o_totalprice"]).select("arm", "n", F.round("mean_o_totalprice", 4).alias("mean_price"))


def ab_analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treated customers and their pseudo-control group, as rows of the source."""
    s, pairs = _pairs(spark, sf_dir)
    source = s.found.rows.select("_rm_id", "c_custkey", "c_acctbal", "region")
    return analysis_table(source, pairs).select("arm", "c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), "region")


def match_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(_pairs(spark, sf_dir)[1])


def ab_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).withColumn("arm", F.when(F.col("is_target") == 1, "treated").otherwise("rest"))
    return column_shares(c, "region", "arm", ["rest", "treated"]).select("region", F.round("rest", 9).alias("rest"), F.round("treated", 9).alias("treated"))


def feature_profile_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.select("variable", "n", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), F.round("mean", 6).alias("mean"), "n_not_finite")


def id_profile_(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [id_profile(table(spark, sf_dir, "orders"), c).select(F.lit(c).alias("variable"), "n", "n_missing", "n_different", "least", "most", "is_key") for c in ("o_orderkey", "o_custkey")]
    return parts[0].unionByName(parts[1])


def plot_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram(customers(spark, sf_dir), "c_acctbal", 10, "region")
    return rows.select("group", "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


def plot_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecdf(customers(spark, sf_dir), "c_acctbal", 10, "region").select("group", F.round("value", 4).alias("value"), F.round("share", 9).alias("share"))


def tail_holdout_(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("double").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    train, held = tail_holdout(labels, 20, "quality", ["doc_id"])
    side = lambda df, name: df.select(F.lit(name).alias("side"), "source_row_id", F.col("doc_id").cast("long").alias("doc_id"))
    return side(train, "train").unionByName(side(held, "held_out"))


def random_control_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many controls as there are treated customers, drawn by a seeded hash."""
    c = customers(spark, sf_dir)
    return seeded_draw(c.where("is_target = 0"), "c_custkey", c.where("is_target = 1").count(), SEED).select("c_custkey")


_NAMED = (
    profile_summary, profile_nulls, treatment_prepare, missing_flags, bin_edges_target, bin_edges_population, bucketize, stratum_key, stratum_counts, coverage_flags, capacity_strata, capacity_summary, capacity_trials,
    grouping_cardinality, stratum_group_values, target_moments, zscores, pair_scores, topk_candidates, nearest_control, greedy_assign, greedy_assign_1to2, greedy_assign_rounds, greedy_assign_capped, tolerance_cutoff, tolerance_kept,
    match_pairs, match_targets, coverage_summary, balance_ks, balance_js, balance_table, drift_excess, drift_trim, sample_classes, sample_quotas, sample_rows, sample_simple, sample_full, sample_balance_overall,
    sample_balance_within, sample_status, sample_strata_report, greedy_assign_rounds_ties, greedy_assign_categories, match_order, drift_log, capacity_report, capacity_advice, sql_views, sources, latin1_source, zstd_holdout,
    downsample, downsample_report, downsample_export, id_profile_, plot_histogram, plot_ecdf, ab_group_means, ab_analysis_table, match_status_counts, ab_crosstab, feature_profile_, tail_holdout_, random_control_baseline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__.rstrip("_"): f for f in _NAMED}
