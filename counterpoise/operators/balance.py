"""Whether the chosen controls are distributed like the treated rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.columns import col, finite, is_numeric
from counterpoise.functions.statistics import AGGREGATE_ROWS, js, ks
from counterpoise.operators.prepare import label_text
from counterpoise.sources.scratch import scratch


@dataclass(frozen=True)
class BalanceRow:
    variable: str
    role: str
    kind: str
    statistic: float
    threshold: float
    flagged: bool


def balance_rows(targets: DataFrame, controls: DataFrame, match_vars: Sequence[str], monitor_vars: Sequence[str]) -> DataFrame:
    """place, variable, role, kind, statistic of every match and monitor variable; 0 if a side is empty.

    All variables are stacked, so both sides are scanned once, and exchanged as one frequency table.
    """
    checks = [*((v, "match") for v in match_vars), *((v, "monitor") for v in monitor_vars)]
    names = list(dict.fromkeys(v for v, _ in checks))
    both = targets.select(*map(col, names), F.lit(1).alias("_a")).unionByName(controls.select(*map(col, names), F.lit(0).alias("_a")))
    numeric = [is_numeric(both.schema[v].dataType) for v, _ in checks]
    cells = [F.struct(F.lit(k).alias("place"), (finite(col(v)) if num else F.lit(None).cast("double")).alias("x"), (F.lit(None).cast("string") if num else label_text(col(v))).alias("g")) for k, ((v, _), num) in enumerate(zip(checks, numeric, strict=True))]
    stacked = both.select("_a", F.inline(F.array(*cells)))
    freq = scratch(stacked.where("x is not null or g is not null").groupBy("place", "x", "g").agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b")), "frequencies")
    distributed = freq.limit(AGGREGATE_ROWS + 1).count() > AGGREGATE_ROWS
    stats = ks(freq.where("x is not null").select("place", F.col("x").alias("value"), "a", "b"), ["place"], distributed).unionByName(js(freq.where("g is not null").select("place", F.col("g").alias("value"), "a", "b"), ["place"]))
    spark = both.sparkSession
    asked = spark.createDataFrame([(k, v, role, "ks" if num else "js") for k, ((v, role), num) in enumerate(zip(checks, numeric, strict=True))], "place int, variable string, role string, kind string")
    return asked.join(stats, "place", "left").select("place", "variable", "role", "kind", F.coalesce("statistic", F.lit(0.0)).alias("statistic"))


def check_balance(targets: DataFrame, controls: DataFrame, match_vars: Sequence[str], monitor_vars: Sequence[str], js_threshold: float, ks_threshold: float) -> list[BalanceRow]:
    limit = {"ks": ks_threshold, "js": js_threshold}
    rows = sorted(balance_rows(targets, controls, match_vars, monitor_vars).collect(), key=lambda r: r["place"])
    return [BalanceRow(r["variable"], r["role"], r["kind"], float(r["statistic"]), limit[r["kind"]], float(r["statistic"]) > limit[r["kind"]]) for r in rows]
