"""Strength of a pair: exp of minus the weighted standardised distance between its rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.columns import col
from counterpoise.sources.scratch import ranked

#: Row numbers whose values are added up by one task, in their order.
RUN = 1 << 20

#: Rows of a side in a block of pairs, and tasks for blocks at most.
SIDE, MOST_TASKS = 2048, 20_000


def target_moments(prepared: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of the treated rows' imputed values; a deviation of 0 counts as 1.

    Numbered rows are added up in order of ``_rm_id``: the last bits of the moments decide between controls at equal distances
    on both sides of a target, and must not follow how the rows are dealt among tasks.
    """
    if not numeric:
        return {}
    treated = prepared.where("_treatment = 1")
    if "_rm_id" in prepared.columns:
        return _moments_in_order(treated, numeric)
    row = treated.agg(*(f(col(v)).alias(f"{k}{i}") for i, v in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {v: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, v in enumerate(numeric)}


def _moments_in_order(treated: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    values = treated.select(F.floor((F.col("_rm_id") - 1) / RUN).alias("run"), F.col("_rm_id").alias("id"), *(col(v).cast("double").alias(f"v{i}") for i, v in enumerate(numeric)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        out = []
        for i in range(len(numeric)):
            total = mean = m2 = 0.0
            for k, x in enumerate(rows[f"v{i}"].to_pylist(), 1):
                total += x
                before, mean = mean, mean + (x - mean) / k
                m2 += (x - mean) * (x - before)
            out.append((key[0].as_py(), i, rows.num_rows, total, mean, m2))
        return pa.table(dict(zip(("run", "i", "n", "total", "mean", "m2"), map(list, zip(*out, strict=True)), strict=True)), pa.schema([("run", pa.int64()), ("i", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64())]))

    parts = sorted(values.groupBy("run").applyInArrow(run, "run long, i int, n long, total double, mean double, m2 double").collect())  # one row for each run and variable
    out = dict.fromkeys(numeric, (0.0, 1.0))
    for i, v in enumerate(numeric):
        n = total = mean = m2 = 0
        for p in (p for p in parts if p.i == i):
            both, apart = n + p.n, p.mean - mean
            m2 = m2 + p.m2 + apart * apart * n * p.n / both if n else p.m2
            n, total, mean = both, total + p.total, mean + apart * p.n / both if n else p.mean
        if n:
            out[v] = total / n, math.sqrt(m2 / n) or 1.0
    return out


def point(numeric: Sequence[str], moments: Mapping[str, tuple[float, float]], weights: Mapping[str, float]) -> Column:
    """A row's weighted standardised values, as an array."""
    if not numeric:
        return F.array().cast("array<double>")
    return F.array(*((col(v) - moments[v][0]) / moments[v][1] * float(weights.get(v, 1.0)) for v in numeric))


def strength(t: Column | Sequence[Column], c: Column | Sequence[Column], dims: int) -> Column:
    """exp(-distance) of two points; 1 without dimensions."""
    squares = [(t[k] - c[k]) * (t[k] - c[k]) for k in range(dims)]
    total = squares[0] if squares else F.lit(0.0)
    for s in squares[1:]:
        total = total + s
    return F.exp(-F.sqrt(total))


def candidate_pairs(targets: DataFrame, controls: DataFrame, dims: int, most: int | None = None) -> DataFrame:
    """All pairs of a stratum with their strength, or each target's ``most`` strongest (ties: least control id).

    ``targets`` and ``controls``: stratum, id, x. The number of pairs is the product of the two sides; matching
    itself never asks for this table (see ``assign``), reports on bounded strata do. Both sides lie in order of their points
    and are cut into blocks of ``SIDE`` rows; each block meets each of the other side in a task that follows the number
    of pairs. Pairs of equal points come side by side, so that column files hold their strengths as runs.
    """
    side = lambda df, is_t: df.select("stratum", F.lit(is_t).alias("is_t"), "id", "x")
    rows = ranked(side(targets, True).union(side(controls, False)), ["stratum", "is_t"], ["x", "id"], "k")
    rows = rows.withColumn("b", F.floor((F.col("k") - 1) / SIDE).cast("int"))
    sizes = rows.groupBy("stratum").agg(*((F.max(F.when(F.col("is_t") == is_t, F.col("b"))) + 1).alias(n) for n, is_t in (("n_t", True), ("n_c", False)))).where("n_t * n_c > 0")
    n = min(sizes.agg(F.sum(F.col("n_t").cast("long") * F.col("n_c"))).first()[0] or 1, MOST_TASKS)
    t, c = (_dealt(rows.where(F.col("is_t") == is_t).join(sizes, "stratum"), own, other, n, dims) for is_t, own, other in ((True, "t", "c"), (False, "c", "t")))
    keys = ["stratum", "b_t", "b_c"]
    x_t, x_c = ([F.col(f"x{k}_{own}") for k in range(dims)] for own in "tc")
    pairs = t.hint("merge").join(c, keys).select("stratum", F.col("id_t").alias("target_rm_id"), F.col("id_c").alias("control_rm_id"), strength(x_t, x_c, dims).alias("match_strength"))
    if most is None:
        return pairs
    rank = F.row_number().over(Window.partitionBy("target_rm_id").orderBy(F.desc("match_strength"), "control_rm_id"))
    return pairs.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def _dealt(side: DataFrame, own: str, other: str, n: int, dims: int) -> DataFrame:
    """Each block of a side once for every block of the other side of its stratum, rows in order of their points."""
    x = [F.col("x")[k].alias(f"x{k}_{own}") for k in range(dims)]
    copies = side.select("stratum", F.col("b").alias(f"b_{own}"), F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"b_{other}"), *x, F.col("id").alias(f"id_{own}"))
    keys = ["stratum", "b_t", "b_c"]
    placed = copies.repartition(n, *keys).sortWithinPartitions(*keys, *(f"x{k}_{own}" for k in range(dims)), f"id_{own}")
    return placed.where(F.monotonically_increasing_id() >= 0)  # always true; without it the optimizer drops a sort below a join
