"""Every registered query that has SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from counterpoise.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert {*QUERIES} == {*ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    relation = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    at = [relation.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())


def test_equal_distances_are_settled_as_in_the_sql_however_files_are_split(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/customer.parquet").crossJoin(spark.range(40).toDF("copy"))
    rows = rows.withColumn("c_custkey", F.col("c_custkey") + F.col("copy") * 100_000).withColumn("c_acctbal", F.round(F.col("c_acctbal") + F.col("copy") * 7, 0) + 0.1).drop("copy")
    rows.repartition(5, "c_name").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted(tuple(r) for r in QUERIES["nearest_control"](spark, str(tmp_path)).select("target_rm_id", "control_rm_id").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(c.sql(f"SELECT target_rm_id, control_rm_id FROM ({ORACLES['nearest_control']})").fetchall())


def test_entry(spark):
    assert {*entry_module.queries()} >= {*QUERIES} and {*entry_module.oracle_sql()} >= {*ORACLES}
    assert entry_module.entry(spark).count() == 34
