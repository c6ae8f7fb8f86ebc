"""Bins from the treated rows, stratum keys, and counts by stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.columns import bucket, col
from counterpoise.functions.statistics import quantiles


def cuts(n_bins: int) -> list[float]:
    return [k / n_bins for k in range(1, n_bins)]


def target_edges(prepared: DataFrame, numeric: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Quantile edges of each variable over the treated rows only."""
    return quantiles(prepared.where("_treatment = 1"), numeric, cuts(n_bins))


def stratum_key(edges: Mapping[str, Sequence[float]], categorical: Sequence[str], missing: Sequence[str]) -> Column:
    """Bins, categories and missing flags joined by ``|``; ``all`` without any.

    Categories that contain the separator can share a key; that is the published form of the key.
    """
    parts = [col(f"_bin_{v}").cast("string") for v in edges] + [col(v).cast("string") for v in categorical] + [col(f"is_missing_{v}").cast("string") for v in missing]
    return F.concat_ws("|", *parts) if parts else F.lit("all")


def stratify(prepared: DataFrame, edges: Mapping[str, Sequence[float]], categorical: Sequence[str], missing: Sequence[str], n_bins: int) -> DataFrame:
    """Add ``_bin_<v>`` and ``_stratum``."""
    binned = prepared.select("*", *(bucket(col(v), e, n_bins - 1).alias(f"_bin_{v}") for v, e in edges.items()))
    return binned.withColumn("_stratum", stratum_key(edges, categorical, missing))


def stratum_counts(stratified: DataFrame) -> DataFrame:
    """stratum, n_target, n_control."""
    treated = F.col("_treatment") == 1
    return stratified.groupBy(F.col("_stratum").alias("stratum")).agg(F.count_if(treated).alias("n_target"), F.count_if(~treated).alias("n_control"))
