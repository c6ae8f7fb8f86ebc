import math
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from counterpoise import ControlMatcher, DataReport, InsufficientControlPoolWarning, InsufficientStratumCapacityWarning, MatchConfig
from counterpoise.operators import assign, balance, coverage, drift, output, scoring, strata, tolerance
from counterpoise.operators.prepare import prepare
from counterpoise.sources.ingest import numbers_as_double, read, table_to_arrow
from counterpoise.sources.scratch import row_numbers


def frame(n_t=40, n_c=160, seed=0):
    r = np.random.default_rng(seed)
    return pd.DataFrame({
        "id": np.arange(n_t + n_c), "income": np.concatenate([r.normal(70, 5, n_t), r.normal(60, 8, n_c)]), "age": np.concatenate([r.normal(40, 4, n_t), r.normal(36, 6, n_c)]),
        "region": r.choice(["A", "B"], n_t + n_c), "tenure": np.concatenate([r.normal(12, 2, n_t), r.normal(20, 6, n_c)]), "is_target": [1] * n_t + [0] * n_c,
    })


def walk(points_t, points_c, n, most=None):
    """The plain greedy walk over all pairs."""
    pairs = []
    for t, x in points_t.items():
        near = sorted((-math.exp(-math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))), c) for c, y in points_c.items())
        pairs += [(s, t, c) for s, c in near[:most]]
    left, used, out = dict.fromkeys(points_t, n), set(), []
    for s, t, c in sorted(pairs):
        if left[t] and c not in used:
            left[t] -= 1
            used.add(c)
            out.append((t, c, round(-s, 9)))
    return sorted(out)


@pytest.mark.parametrize(("n", "most", "ties"), [(1, None, False), (3, None, False), (2, 3, False), (2, None, True)])
def test_both_assignments_equal_the_walk(spark, n, most, ties, monkeypatch):
    monkeypatch.setattr(assign, "BLOCK", 16)
    r = np.random.default_rng(n)
    draw = (lambda: [float(r.integers(0, 4))]) if ties else (lambda: r.normal(size=2).tolist())
    sides = {s: ({i: draw() for i in range(k, k + 18)}, {i: draw() for i in range(k + 100, k + 160)}) for s, k in (("a", 0), ("b", 1000))}
    rows = lambda side: spark.createDataFrame([(s, i, x) for s, v in sides.items() for i, x in v[side].items()], "stratum string, id long, x array<double>")
    counts = spark.createDataFrame([(s, len(v[0]), len(v[1])) for s, v in sides.items()], "stratum string, n_target long, n_control long")
    want = sorted(x for t, c in sides.values() for x in walk(t, c, n, most))
    for budget in (10**9, 0):
        got = assign.assign(rows(0), rows(1), counts, n, most, budget).collect()
        assert sorted((r.target_rm_id, r.control_rm_id, round(r.match_strength, 9)) for r in got) == want
        assert all(1 <= r.match_rank <= n for r in got)


def test_moments_follow_the_row_numbers_and_not_the_partitions(spark):
    values = np.round(np.random.default_rng(5).normal(4000, 3000, 3001), 2).tolist()
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values, 1)] + [(5000, 0, 1.0)], "_rm_id long, _treatment int, x double")
    total = mean = m2 = 0.0
    for k, v in enumerate(values, 1):
        total += v
        before, mean = mean, mean + (v - mean) / k
        m2 += (v - mean) * (v - before)
    want = {"x": (total / len(values), math.sqrt(m2 / len(values)))}
    for n in (1, 3, 8):
        assert scoring.target_moments(rows.repartition(n, F.xxhash64("x")), ["x"]) == want
    assert scoring.target_moments(rows.where("_rm_id > 4000"), ["x"]) == {"x": (0.0, 1.0)}


def test_all_pairs_come_in_many_tasks_with_equal_strengths_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SIDE", 16, raising=False)
    r = np.random.default_rng(3)
    points = {"t": r.normal(size=(6, 2)), "c": r.normal(size=(9, 2))}
    sides = {name: [("a", i, x[k].tolist()) for i, k in enumerate(r.permutation(np.repeat(np.arange(len(x)), 10)).tolist(), 1000 if name == "c" else 0)] for name, x in points.items()}
    sides["t"] += [("b", 500, [0.0, 0.0]), ("d", 501, [1.0, 0.0])]
    sides["c"] += [("c", 5000, [0.0, 0.0]), ("d", 5001, [0.0, 0.0])]
    t, c = (spark.createDataFrame(sides[name], "stratum string, id long, x array<double>").coalesce(1) for name in "tc")
    got = scoring.candidate_pairs(t, c, 2).withColumn("task", F.spark_partition_id()).collect()
    want = [(s, i, j, round(math.exp(-math.dist(x, y)), 9)) for s, i, x in sides["t"] for z, j, y in sides["c"] if s == z]
    assert sorted((r.stratum, r.target_rm_id, r.control_rm_id, round(r.match_strength, 9)) for r in got) == sorted(want)
    assert len({r.task for r in got}) > 4
    assert sum(a.match_strength != b.match_strength for a, b in zip(got, got[1:], strict=False)) < len(got) / 4
    best = scoring.candidate_pairs(t, c, 2, 1).collect()
    assert sorted((r.target_rm_id, r.control_rm_id) for r in best) == sorted((i, max((x for x in want if x[1] == i), key=lambda x: (x[3], -x[2]))[2]) for s, i, _ in sides["t"] if s != "b")


def test_run_has_every_target_once_and_no_control_twice(spark):
    df = frame()
    cfg = MatchConfig(["income", "age", "region"], "is_target", ["tenure"], tolerance=0.2, id_col="id", n=2)
    m = ControlMatcher(cfg, spark)
    result = m.fit_match(df, order_by=["id"])
    pairs, targets = result.pairs.toPandas(), result.targets.toPandas()
    used = pairs.control_rm_id.dropna()
    assert used.is_unique and sorted(targets.target_id) == list(range(40))
    strengths = pairs.match_strength.dropna()
    assert ((strengths > 0) & (strengths <= 1)).all() and 0 <= m.cutoff <= 1 and m.bin_edges.keys() == {"income", "age"}
    assert result.coverage_summary["n_target"] == 40 and result.coverage_summary["n_unique_controls"] == len(used)
    assert {(r["variable"], r["role"]) for r in result.report.balance} == {("income", "match"), ("age", "match"), ("region", "match"), ("tenure", "monitor")}
    assert result.report.capacity.summary["drift_removed"] == sum(e["n_removed"] for e in result.report.drift_log) > 0
    assert result.report.to_dict()["capacity"]["summary"]["n_target"] == 40
    result.close()


def test_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ControlMatcher, "_match", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ControlMatcher(MatchConfig(["income"], "is_target"), spark).fit_match(frame(), work_dir=str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_rejections(spark):
    df = spark.createDataFrame(frame())
    for cfg, data, said in (
        (MatchConfig(["nope"], "is_target"), df, "not found"),
        (MatchConfig(["income", "region"], "is_target", stratify_vars=["income"]), df, "must remain"),
        (MatchConfig(["income"], "age"), df, "binary"),
        (MatchConfig(["income"], "is_target"), df.where("is_target = 0"), "both 0 and 1"),
        (MatchConfig(["xs"], "is_target"), df.withColumn("xs", F.array(F.lit(1))), "nested"),
    ):
        with pytest.raises(ValueError, match=said), pytest.warns() if said == "binary" else _quiet():
            ControlMatcher(cfg, spark).fit_match(data)


class _quiet:
    def __enter__(self):
        pass

    def __exit__(self, *a):
        return False


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, None, True), (None, "x", None), (float("nan"), "", False)], "v double, g string, t boolean")
    rows = prepare(df, "t", ["v"], ["g"]).collect()
    assert [(r._treatment, r.v, r.g, r.is_missing_v) for r in rows] == [(1, 1.0, "__MISSING__", False), (0, 0.0, "x", True), (0, 0.0, "", True)]


def test_edges_come_from_targets_only(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 30.0), (1, 40.0), (0, 1000.0)], "_treatment int, x double")
    edges = strata.target_edges(df, ["x"], 4)
    assert edges == {"x": [17.5, 25.0, 32.5]}
    assert [r._bin_x for r in strata.stratify(df, edges, [], [], 4).orderBy("x").collect()] == [0, 1, 2, 3, 3]


def test_stratum_key_without_variables(spark):
    df = spark.createDataFrame([(1,), (0,)], "_treatment int")
    assert {r._stratum for r in strata.stratify(df, {}, [], [], 4).collect()} == {"all"}


def test_capacity_arithmetic(spark):
    counts = spark.createDataFrame([("a", 100, 50), ("b", 2, 3), ("c", 5, 0), ("d", 0, 500)], "stratum string, n_target long, n_control long")
    cfg = MatchConfig(["x"], "t", n=2)
    got = coverage.capacity_totals(counts, cfg).first()
    assert (got.assignment_shortfall, got.assignment_capacity_ceiling, got.fully_supplied_targets_ceiling, got.targets_with_one_control_ceiling, int(got.candidate_pairs)) == (161, 53, 26, 52, 5006)
    flags = {r.stratum: (r.no_control, r.thin_stratum, r.eligible) for r in coverage.flag_coverage(counts, cfg).collect()}
    assert flags == {"a": (False, False, True), "b": (False, True, True), "c": (True, False, False)}


def test_assess_and_warnings(spark):
    df = pd.DataFrame({"x": [1.0, 2, 3, 4, 1, 1, 4, 4], "t": [1] * 4 + [0] * 4})
    m = ControlMatcher(MatchConfig(["x"], "t"), spark)
    report = m.assess(df, n_bins_candidates=[2])
    assert [t["n_bins"] for t in report.trials] == [4, 2] and m.bin_edges == {} and m.cutoff is None
    assert report.recommendations[0]["evidence"] == "measured_preflight"
    with pytest.raises(ValueError):
        m.assess(df, n_bins_candidates=[1])
    short = pd.DataFrame({"g": ["a", "a", "b", "b", "b"], "t": [1, 1, 0, 0, 0]})
    with pytest.warns(InsufficientStratumCapacityWarning):
        got = ControlMatcher(MatchConfig(["g"], "t"), spark).fit_match(short)
    assert {r.match_status for r in got.targets.collect()} == {"no_control_available"}
    with pytest.warns(InsufficientControlPoolWarning):
        profile = DataReport(spark.createDataFrame([(1,), (1,), (0,)], "t int"), "t").summary()
    assert (profile["n_target"], profile["n_control"]) == (2, 1)


def test_tolerance_keeps_the_strongest(spark):
    rows = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2), (2, 12, 0.1, 1)], "target_rm_id long, control_rm_id long, match_strength double, match_rank long")
    cutoff = tolerance.strength_cutoff(rows, 0.5)
    assert cutoff == 0.2
    assert tolerance.apply_tolerance(rows, cutoff).count() == 3
    strict = tolerance.apply_tolerance(rows, cutoff, preserve_primary=False)
    assert [r.target_rm_id for r in tolerance.below_tolerance(rows, strict).collect()] == [2]
    assert tolerance.strength_cutoff(rows.limit(0), 0.5) == 0.0


def test_below_tolerance_status(spark):
    rows = spark.createDataFrame([(1, 1, "s"), (2, 0, "s")], "_rm_id long, _treatment int, _stratum string")
    flags = spark.createDataFrame([("s", False, False)], "stratum string, no_control boolean, thin_stratum boolean")
    none = spark.createDataFrame([], "target_rm_id long, control_rm_id long, match_strength double, match_rank long")
    pairs = output.pair_table(rows, none, flags, 0.5, below=spark.createDataFrame([(1,)], "target_rm_id long"))
    got = output.target_table(pairs).first()
    assert (got.match_status, got.quality_status, got.n_matches) == ("below_tolerance", "none", 0)


def test_balance_and_drift(spark):
    t = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "_rm_id long, x double, g string")
    c = spark.createDataFrame([(3, 9.0, "a", 0.5), (4, 9.0, "a", 0.1), (5, 1.0, "a", 0.9), (6, 2.0, None, 0.8)], "_rm_id long, x double, g string, match_strength double")
    rows = balance.check_balance(t, c, ["x"], ["g"], 0.1, 0.05)
    assert rows[0].kind == "ks" and rows[0].statistic == 0.5 and rows[0].flagged
    assert rows[1].kind == "js" and rows[1].flagged
    left, events = drift.correct_drift(t, c, rows[1:], 4)
    assert {r._rm_id for r in left.collect()} == {3, 5} and [(e.group, e.control_rm_ids) for e in events] == [("__MISSING__", [6]), ("a", [4])] or {e.group for e in events} == {"a", "__MISSING__"}
    empty = balance.check_balance(t, c.limit(0), ["x"], ["g"], 0.1, 0.05)
    assert [r.statistic for r in empty] == [0.0, 0.0]


def test_row_numbers_are_consecutive(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = row_numbers(df, "r", ["k"]).collect()
    assert sorted((r.k, r.r) for r in rows) == [(k, k + 1) for k in range(1000)]


def test_sources(spark, tmp_path):
    df = pd.DataFrame({"id": [2**53 + 1, 2], "x": [1.5, 2.5], "g": ["a", "b"]})
    df.to_csv(tmp_path / "a.csv", index=False)
    df.to_csv(tmp_path / "a.tsv", index=False, sep="\t")
    df.to_parquet(tmp_path / "a.parquet")
    pa.feather.write_feather(pa.Table.from_pandas(df), str(tmp_path / "a.feather"))
    for data in (df, pa.Table.from_pandas(df), spark.createDataFrame(df), *(str(tmp_path / f"a.{x}") for x in ("csv", "tsv", "parquet", "feather"))):
        got = numbers_as_double(read(spark, data), ("id",)).orderBy("x").collect()
        assert [(r.id, r.x, r.g) for r in got] == [(2**53 + 1, 1.5, "a"), (2, 2.5, "b")]
    read(spark, df).createOrReplaceTempView("named")
    assert read(spark, "named").count() == 2 and table_to_arrow(spark, "named").num_rows == 2
    for data, kind in ((3, TypeError), (f"{os.sep}x.bin", ValueError), ("nowhere", ValueError)):
        with pytest.raises(kind):
            read(spark, data)
