"""Quantiles, and two-sample distances on frequency tables.

A frequency table has one row for each value; the samples themselves are never sorted or gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.columns import col, finite
from counterpoise.sources.scratch import row_numbers, scratch

#: Rows up to which quantiles are one aggregate; beyond it they are read off a distributed sort. Both are exact.
AGGREGATE_ROWS = 5_000_000


def interpolated(low: float, high: float, part: float) -> float:
    return low if part == 0 else low + (high - low) * part


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Exact linear-interpolation quantiles of each column's finite values; an empty list for a column without any."""
    if not columns or not probabilities:
        return {c: [] for c in columns}
    values = {c: finite(col(c)) for c in columns}
    sizes = df.agg(*(F.count(values[c]).alias(f"n{k}") for k, c in enumerate(columns))).first()
    if max(sizes) <= AGGREGATE_ROWS:
        p = F.array(*(F.lit(float(x)) for x in probabilities))
        row = df.agg(*(F.percentile(values[c], p).alias(f"q{k}") for k, c in enumerate(columns))).first()
        return {c: [float(x) for x in row[k] or []] for k, c in enumerate(columns)}
    out = {}
    for k, c in enumerate(columns):
        n = sizes[k]
        places = [p * (n - 1) for p in probabilities] if n else []
        wanted = sorted({int(math.floor(x)) + 1 for x in places} | {int(math.ceil(x)) + 1 for x in places})
        ranked = row_numbers(df.select(values[c].alias("v")).where("v is not null"), "r", ["v"])
        got = {r["r"]: r["v"] for r in ranked.where(F.col("r").isin(wanted)).collect()} if wanted else {}
        out[c] = [interpolated(got[math.floor(x) + 1], got[math.ceil(x) + 1], x - math.floor(x)) for x in places]
    return out


def frequencies(df: DataFrame, value: Column, first: Column, second: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by``, value, a, b: how often each value stands in the rows marked ``first`` and ``second``."""
    return df.select(*by, value.alias("value"), first.cast("long").alias("a"), second.cast("long").alias("b")).groupBy(*by, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def ks(freq: DataFrame, by: Sequence[str] = (), distributed: bool = False) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each group; null where a side is empty.

    ``distributed`` takes the running sums over range partitions and shifts them by the sums of the
    partitions before, for groups with more distinct values than one task should sort.
    """
    by = list(by)
    if distributed:
        place = scratch(freq.orderBy(*by, "value").withColumn("__part", F.spark_partition_id()), "frequencies")
        local = Window.partitionBy(*by, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        sums = place.groupBy(*by, "__part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
        before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
        starts = sums.select(*by, "__part", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("ob"))
        total = sums.groupBy(*by).agg(F.sum("sa").alias("ta"), F.sum("sb").alias("tb"))
        run = place.select(*by, "__part", F.sum("a").over(local).alias("ca"), F.sum("b").over(local).alias("cb")).join(starts, [*by, "__part"])
        run = _beside(run, total, by)
        p = ((F.col("ca") + F.col("oa")) / F.nullif("ta", F.lit(0))) - ((F.col("cb") + F.col("ob")) / F.nullif("tb", F.lit(0)))
        return run.select(*by, F.abs(p).alias("d")).groupBy(*by).agg(F.max("d").alias("statistic"))
    key = by or [F.lit(1)]
    run = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    p = lambda x: F.sum(x).over(run) / F.nullif(F.sum(x).over(whole), F.lit(0))
    return freq.select(*by, F.abs(p("a") - p("b")).alias("d")).groupBy(*by).agg(F.max("d").alias("statistic"))


def _beside(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the totals of its group, of which there are as many as groups."""
    if by:
        return df.join(totals, list(by))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(totals.withColumn("__one", F.lit(1))), "__one").drop("__one")


def js(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Jensen-Shannon divergence (natural logarithm) of each group; null where a side is empty."""
    by = list(by)
    totals = freq.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    both = _beside(freq, totals, by).select(*by, (F.col("a") / F.nullif("ta", F.lit(0))).alias("p"), (F.col("b") / F.nullif("tb", F.lit(0))).alias("q"))
    term = lambda x: F.when(F.col(x) > 0, 0.5 * F.col(x) * F.ln(F.col(x) / ((F.col("p") + F.col("q")) / 2))).otherwise(0.0)
    empty = (F.count("p") == 0) | (F.count("q") == 0)
    return both.groupBy(*by).agg(F.when(empty, None).otherwise(F.greatest(F.lit(0.0), F.sum(term("p") + term("q")))).alias("statistic"))
