"""Groups that the chosen controls have too many of, and their trimming."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterpoise.functions.columns import bucket, col, finite
from counterpoise.functions.statistics import AGGREGATE_ROWS, quantiles
from counterpoise.operators.balance import BalanceRow
from counterpoise.operators.prepare import label_text
from counterpoise.operators.strata import cuts
from counterpoise.sources.scratch import ranked, scratch


#: Removed ids that one entry of the log lists; where there are more, the table of removed rows has them.
LISTED = 10_000


@dataclass
class TrimEvent:
    """What was removed of one group. ``rows``: group, place, _rm_id of all that went for this variable, a stored table."""

    variable: str
    kind: str
    group: Any
    n_removed: int
    target_share: float
    control_share_before: float
    rows: DataFrame

    @property
    def control_rm_ids(self) -> list[int] | None:
        """The removed rows, weakest first; None if they are more than ``LISTED``."""
        if self.n_removed > LISTED:
            return None
        return [r["_rm_id"] for r in self.rows.where(F.col("group") == self.group).orderBy("place").select("_rm_id").collect()]

    def to_dict(self) -> dict[str, Any]:
        return {"variable": self.variable, "kind": self.kind, "group": str(self.group), "n_removed": self.n_removed, "target_share": self.target_share, "control_share_before": self.control_share_before, "control_rm_ids": self.control_rm_ids}


def removed_rows(spark: SparkSession, events: Sequence[TrimEvent]) -> DataFrame:
    """variable, group, place, control_rm_id of all that trimming removed."""
    out = spark.createDataFrame([], "variable string, group string, place long, control_rm_id long")
    for variable, rows in {e.variable: e.rows for e in events}.items():
        out = out.unionByName(rows.select(F.lit(variable).alias("variable"), "group", F.col("place").cast("long").alias("place"), F.col("_rm_id").alias("control_rm_id")))
    return out


def drift_group(targets: DataFrame, variable: str, kind: str, n_bins: int) -> Column | None:
    """The group of a row: its label, or its bin between distinct quantiles of the treated rows; nulls are in the last bin."""
    if kind == "js":
        return label_text(col(variable))
    edges = sorted(set(quantiles(targets, [variable], cuts(n_bins))[variable]))
    if not edges:
        return None
    value = finite(col(variable))
    return F.when(value.isNull(), F.lit(len(edges))).otherwise(bucket(value, edges, len(edges))).cast("string")


def excess_groups(targets: DataFrame, controls: DataFrame, variable: str, kind: str, n_bins: int = 4) -> DataFrame:
    """group, target_share, control_share, excess_rows of the groups whose share of the controls is too large by a row or more."""
    group = drift_group(targets, variable, kind, n_bins)
    if group is None:
        return targets.sparkSession.createDataFrame([], "group string, target_share double, control_share double, excess_rows long")
    both = targets.select(group.alias("group"), F.lit(1).alias("t")).unionByName(controls.select(group.alias("group"), F.lit(0).alias("t")))
    n = both.groupBy("group").agg(F.sum("t").alias("nt"), F.sum(1 - F.col("t")).alias("nc"))
    whole = Window.partitionBy(F.lit(1))  # one row for each group
    shares = n.select("group", (F.col("nt") / F.nullif(F.sum("nt").over(whole), F.lit(0))).alias("ts"), (F.col("nc") / F.nullif(F.sum("nc").over(whole), F.lit(0))).alias("cs"), F.sum("nc").over(whole).alias("n"))
    ts, cs = F.coalesce("ts", F.lit(0.0)), F.coalesce("cs", F.lit(0.0))
    excess = F.floor(F.greatest(F.lit(0.0), (cs - ts) * F.col("n")))
    return shares.select("group", ts.alias("target_share"), cs.alias("control_share"), excess.cast("long").alias("excess_rows")).where("excess_rows > 0")


def trim(targets: DataFrame, controls: DataFrame, variable: str, kind: str, n_bins: int = 4) -> DataFrame:
    """The controls that go for one variable: its columns, ``group`` and shares; weakest first, then least ``_rm_id``.

    ``controls`` carry ``match_strength``.
    """
    group = drift_group(targets, variable, kind, n_bins)
    groups = excess_groups(targets, controls, variable, kind, n_bins)
    if group is None:
        return controls.where(F.lit(False)).select("_rm_id", "match_strength", F.lit("").alias("group"), F.lit(0.0).alias("target_share"), F.lit(0.0).alias("control_share"), F.lit(0).cast("long").alias("excess_rows"), F.lit(0).cast("long").alias("place"))
    live = controls.select("_rm_id", F.coalesce("match_strength", F.lit(0.0)).alias("match_strength"), group.alias("group")).join(groups, "group")
    order = ["match_strength", "_rm_id"]
    if live.limit(AGGREGATE_ROWS + 1).count() > AGGREGATE_ROWS:  # a group may then be more than one task should sort
        placed = ranked(live, ["group"], order, "place")
    else:
        placed = live.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(*order)).cast("long"))
    return placed.where(F.col("place") <= F.col("excess_rows"))


def correct_drift(targets: DataFrame, controls: DataFrame, flagged: Sequence[BalanceRow], n_bins: int = 4) -> tuple[DataFrame, list[TrimEvent]]:
    """The controls that stay after one pass over the flagged monitor variables, and what went for which group.

    Each variable sees what the ones before left. The rows removed stay a stored table.
    """
    events: list[TrimEvent] = []
    for row in flagged:
        if row.role != "monitor" or not row.flagged or row.variable not in targets.columns:
            continue
        gone = scratch(trim(targets, controls, row.variable, row.kind, n_bins), "trimmed")
        got = gone.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.first("target_share").alias("ts"), F.first("control_share").alias("cs"), F.max("excess_rows").alias("e")).collect()
        for r in sorted(got, key=lambda r: (-r["e"], int(r["group"]) if row.kind == "ks" else 0, r["group"])):
            events.append(TrimEvent(row.variable, row.kind, r["group"], r["n"], r["ts"], r["cs"], gone))
        if got:
            controls = controls.join(gone.select("_rm_id"), "_rm_id", "left_anti")
    return controls, events
