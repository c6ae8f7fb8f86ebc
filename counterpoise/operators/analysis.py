"""Reading a matched design: outcome means, shares, feature ranges, and a seeded draw to compare with."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.columns import col, finite, is_finite, seeded


def analysis_table(source: DataFrame, pairs: DataFrame, row_id: str = "_rm_id") -> DataFrame:
    """The source rows of all treated rows and of their kept controls, with ``arm`` treated or control.

    ``pairs`` as a matching run publishes them; ``source`` carries the run's row numbers.
    """
    treated = pairs.select(F.col("target_rm_id").alias(row_id)).distinct().withColumn("arm", F.lit("treated"))
    controls = pairs.where("control_rm_id is not null").select(F.col("control_rm_id").alias(row_id), F.lit("control").alias("arm"))
    return source.join(treated.unionByName(controls), row_id)


def status_counts(pairs: DataFrame) -> DataFrame:
    """How many rows of the pair table have which status and quality."""
    return pairs.groupBy("match_status", "quality_status").agg(F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, by: str, outcomes: Sequence[str]) -> DataFrame:
    """Rows and mean outcomes of each group."""
    return df.groupBy(col(by)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(col(v)).alias(f"mean_{v}") for v in outcomes))


def column_shares(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """For each value of ``row`` its share of the rows of each named value of ``column``."""
    total = {v: F.count_if(col(column) == v) for v in values}
    wide = df.groupBy(col(row)).agg(*(total[v].alias(v) for v in values))
    sums = df.agg(*(F.nullif(total[v], F.lit(0)).alias(f"_{k}") for k, v in enumerate(values))).withColumn("_one", F.lit(1))
    joined = wide.withColumn("_one", F.lit(1)).join(F.broadcast(sums), "_one")
    return joined.select(col(row), *((col(v) / F.col(f"_{k}")).alias(v) for k, v in enumerate(values)))


def feature_profile(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """variable, n, least, most, mean of the finite values, and how many are not finite; one scan."""
    parts = [F.struct(F.lit(v).alias("variable"), F.count(finite(col(v))).alias("n"), F.min(finite(col(v))).alias("least"), F.max(finite(col(v))).alias("most"), F.avg(finite(col(v))).alias("mean"), F.count_if(~is_finite(col(v))).alias("n_not_finite")) for v in variables]
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def id_profile(df: DataFrame, id_col: str) -> DataFrame:
    """One row: n, n_missing, n_different, least and most of an id column, and whether it names each row."""
    c = col(id_col)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("n_missing"), F.count_distinct(c).alias("n_different"), F.min(c).alias("least"), F.max(c).alias("most"))
    return got.withColumn("is_key", (F.col("n_different") == F.col("n")) & (F.col("n") > 0))


def histogram(df: DataFrame, variable: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """group, bin, low, high, n of equal bins between the least and the greatest finite value; empty bins have no row.

    One row for each bin whatever the number of rows: what a plot needs.
    """
    value = finite(col(variable))
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "group string, bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((value - F.lit(low)) / F.lit(width))).cast("int")
    group = col(by).cast("string") if by else F.lit("all")
    rows = df.where(value.isNotNull()).groupBy(group.alias("group"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("group", "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n")


def ecdf(df: DataFrame, variable: str, points: int = 20, by: str | None = None) -> DataFrame:
    """group, value, share: which share of a group's finite values is at or under each of ``points`` + 1 even steps from the least to the greatest."""
    value = finite(col(variable))
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "group string, value double, share double")
    steps = [low + (high - low) * k / points for k in range(points)] + [high]
    group = col(by).cast("string") if by else F.lit("all")
    shares = F.array(*(F.struct(F.lit(x).alias("value"), (F.count_if(value <= x) / F.count(value)).alias("share")) for x in steps))
    return df.where(value.isNotNull()).groupBy(group.alias("group")).agg(shares.alias("_all")).select("group", F.inline("_all"))


def first_by_hash(df: DataFrame, key: Column, n: int, last: Column) -> DataFrame:
    """The ``n`` rows with the least ``key`` (a hexadecimal hash as text), ties by ``last``; no task sorts more than a run of leading digits."""
    total = df.count()
    digits = max(0, min(8, math.ceil(math.log(max(1, total) / 4096, 16)))) if total > 4096 else 0
    keyed = df.withColumns({"__h": key, "__last": last}).withColumn("__run", F.substring("__h", 1, digits))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each run, of about 4096 rows each
    starts = keyed.groupBy("__run").agg(F.count(F.lit(1)).alias("__n")).select("__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")).where(F.col("__before") < n)
    place = F.row_number().over(Window.partitionBy("__run").orderBy("__h", "__last")) + F.col("__before")
    return keyed.join(starts, "__run").withColumn("__place", place).where(F.col("__place") <= n).select(*(col(c) for c in df.columns))


def seeded_draw(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded md5 of their id: a plain random control group."""
    return first_by_hash(df, seeded(seed, "row", col(id_col).cast("string")), n, col(id_col))
