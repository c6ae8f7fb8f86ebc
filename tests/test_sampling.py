import json
import math

import numpy as np
import pandas as pd
import pytest

from counterpoise import random_downsample
from counterpoise.functions.statistics import frequencies, js, ks, quantiles
from counterpoise.operators import sampling
from counterpoise.sources.prepared import export_sample, read_headerless, tail_holdout, write_zstd
from pyspark.sql import functions as F


def draw(spark, df, **kw):
    return random_downsample(df, spark=spark, order_by=["id"] if "id" in df else (), **kw)


def test_label_first_exact_size(spark):
    r = np.random.default_rng(5)
    df = pd.DataFrame({"id": range(10_000), "Y": [0] * 9000 + [1] * 1000, "region": r.choice(list("NSEW"), 10_000), "x": r.integers(0, 100, 10_000)})
    got = draw(spark, df, sample_size=1000, label_col="Y", stratify_vars=["region", "x"], n_bins=10, random_state=5, check_by_label=True)
    rows = got.sample.toPandas()
    assert len(rows) == 1000 and rows.id.is_unique and (rows.Y == 1).sum() == 100 and list(rows.columns) == list(df.columns)
    assert got.report.summary["count_invariants_passed"] and got.report.summary["sampled_rows"] == 1000
    again = draw(spark, df, sample_size=1000, label_col="Y", stratify_vars=["region", "x"], n_bins=10, random_state=5)
    assert list(again.sample.toPandas().id) == list(rows.id)


def test_runs_of_a_large_group_equal_one_ranking(spark):
    """Groups that are ranked run by run give the rows with the least seeded hashes."""
    import hashlib

    df = pd.DataFrame({"id": range(20_000)})
    got = draw(spark, df, sample_size=777, random_state=9)
    want = sorted(range(1, 20_001), key=lambda i: (hashlib.md5(f"9:row:{i}".encode()).hexdigest(), i))[:777]
    assert [r[0] for r in got.row_ids.collect()] == sorted(want)


def test_sizes_without_label(spark):
    df = pd.DataFrame({"id": range(100), "g": [None, "a"] * 50})
    for n in (1, 17, 100):
        got = draw(spark, df, sample_size=n, random_state=1)
        assert got.sample.count() == n and got.report.summary["balance_status"] == "not_evaluated"
    with pytest.raises(ValueError, match="exceeds"):
        draw(spark, df, sample_size=101)
    with pytest.raises(ValueError, match="not found"):
        draw(spark, df, sample_size=1, label_col="nope")
    with pytest.raises(ValueError, match="reserved"):
        draw(spark, df.rename(columns={"g": "_RS_g"}), sample_size=1)


def test_hostile_categories(spark):
    df = pd.DataFrame({"id": range(60), "Y": [None, "__MISSING__", "[null]"] * 20, "g": ["a|b", "", None, "a", 'q"', "[null]"] * 10})
    got = draw(spark, df, sample_size=30, label_col="Y", stratify_vars=["g"], random_state=3)
    assert sorted(c["sampled_rows"] for c in got.report.classes) == [10, 10, 10]
    assert {c["label"] for c in got.report.classes} == {"[null]", '["__MISSING__"]', '["[null]"]'}


def test_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([1.0, 2.0, 3.0, 4.0, None, float("nan"), float("inf"), float("-inf")])], "id long, x double")
    got = random_downsample(df, spark=spark, order_by=["id"], sample_size=4, stratify_vars=["x"], random_state=2)
    row = next(r for r in got.report.balance if r["variable"] == "x")
    assert got.report.bin_edges["x"] == [1.75, 2.5, 3.25] and row["population_missing_rate"] == 0.5


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(0.0, "a", 1), (1.0, "b", 0)], "x double, g string, s int")
    one = lambda f: f.first()["statistic"]
    for distributed in (False, True):
        assert one(ks(frequencies(df, F.col("x"), F.lit(True), F.col("s") == 1), distributed=distributed)) == 0.5
    want = 0.25 * math.log(2 / 3) + 0.25 * math.log(2) + 0.5 * math.log(4 / 3)
    assert abs(one(js(frequencies(df, F.col("g"), F.lit(True), F.col("s") == 1))) - want) < 1e-12
    none = frequencies(df, F.col("x"), F.lit(True), F.lit(False))
    assert one(ks(none)) is None and one(js(none)) is None


def test_distributed_statistics_equal_aggregates(spark, monkeypatch):
    r = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"k": r.choice(["p", "q"], 900), "x": r.normal(size=900).round(2), "s": r.integers(0, 2, 900)}))
    f = frequencies(df, F.col("x"), F.lit(True), F.col("s") == 1, ["k"])
    a, b = ({r.k: round(r.statistic, 12) for r in ks(f, ["k"], d).collect()} for d in (False, True))
    assert a == b
    p = [0.1, 0.5, 0.9]
    want = quantiles(df, ["x"], p)
    monkeypatch.setattr("counterpoise.functions.statistics.AGGREGATE_ROWS", 10)
    assert np.allclose(quantiles(df, ["x"], p)["x"], want["x"]) and np.allclose(want["x"], np.quantile(df.toPandas().x, p))


def test_selection_is_checked(spark):
    df = pd.DataFrame({"id": range(50)})
    cfg = sampling.SamplingConfig(10, random_state=1)
    source = spark.createDataFrame(df).select((F.col("id") + 1).alias("_rs_id"), "id")
    pop = sampling.population(source, cfg, {})
    classes = sampling.class_quotas(pop, cfg, 50)
    quotas = sampling.group_quotas(pop, classes, cfg)
    with pytest.raises(RuntimeError):
        sampling.check_selection(pop, quotas, pop.select("_rs_id").limit(9), cfg)


def test_prepared_files_and_export(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("".join(f"{k % 2},{k}.5\n" for k in range(6)))
    df = read_headerless(spark, str(tmp_path / "a.csv.gz"), ["label", "x"])
    train, held = tail_holdout(df, 2, "label", ["x"], expected=6)
    assert [r.source_row_id for r in train.orderBy("source_row_id").collect()] == [1, 2, 3, 4] and held.count() == 2
    with pytest.raises(ValueError, match="expected"):
        tail_holdout(df, 2, "label", expected=7)
    with pytest.raises(ValueError, match="labels"):
        tail_holdout(df, 2, "x")
    write_zstd(train, str(tmp_path / "train"))
    assert spark.read.parquet(str(tmp_path / "train")).count() == 4
    got = random_downsample(train, spark=spark, sample_size=2, order_by=["source_row_id"], random_state=1)
    folder = export_sample(got, str(tmp_path))
    assert json.load(open(f"{folder}/manifest.json"))["rows"] == 2
