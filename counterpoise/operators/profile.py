"""One-scan data profile, and the checks that need it."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.config import MatchConfig
from counterpoise.functions.columns import col, is_numeric
from counterpoise.operators.prepare import treatment_is


class InsufficientControlPoolWarning(UserWarning):
    """There are fewer controls than treated rows."""


class DataReport:
    """A profile of one table, computed when it is first asked for and then kept."""

    def __init__(self, df: DataFrame, treatment_col: str):
        self._df, self._treatment, self._kept = df, treatment_col, None

    def summary(self) -> dict[str, Any]:
        if self._kept is None:
            self._kept = self._profile()
        return self._kept

    to_dict = summary

    def _profile(self) -> dict[str, Any]:
        df, t = self._df, col(self._treatment)
        kind = df.schema[self._treatment].dataType
        nulls = [F.count_if(col(c).isNull()).alias(f"null{k}") for k, c in enumerate(df.columns)]
        # Which of 0 and 1 there are, and the least and the greatest of what else there is.
        known = treatment_is(t, kind, 0) | treatment_is(t, kind, 1)
        other = F.when(t.isNotNull() & ~F.coalesce(known, F.lit(False)), t.cast("string") if not is_numeric(kind) else t)
        values = F.struct(F.min(other).alias("least"), F.max(other).alias("most")).alias("values")
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(treatment_is(t, kind, 1)).alias("t"), F.count_if(treatment_is(t, kind, 0)).alias("c"), values, F.count_if(t.isNull()).alias("tn"), *nulls).first()
        counts = {c: row[f"null{k}"] for k, c in enumerate(df.columns)}
        if row["c"] < row["t"]:
            warnings.warn(f"The control pool has {row['c']:,} rows for {row['t']:,} treated rows: without reuse some treated rows must stay without a control.", InsufficientControlPoolWarning, stacklevel=4)
        numeric = sum(is_numeric(f.dataType) for f in df.schema.fields)
        return {
            "n_rows": row["n"], "n_target": row["t"], "n_control": row["c"], "n_treatment_null": row["tn"],
            "treatment_values": [v for v, n in ((0, row["c"]), (1, row["t"])) if n] + [v for v in dict.fromkeys((row["values"]["least"], row["values"]["most"])) if v is not None],
            "n_numeric": numeric, "n_categorical": len(df.columns) - numeric,
            "column_types": {f.name: f.dataType.simpleString() for f in df.schema.fields},
            "null_counts": counts, "null_rates": {c: v / row["n"] if row["n"] else 0.0 for c, v in counts.items()},
        }


def check_columns(df: DataFrame, cfg: MatchConfig) -> tuple[list[str], list[str]]:
    """The match variables as (numeric, categorical); raises ValueError for what the table or its types don't allow."""
    wanted = [cfg.treatment_col, *cfg.match_vars, *cfg.monitor_vars, *([cfg.id_col] if cfg.id_col else [])]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"columns not found in input: {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if nested := [c for c in (*cfg.match_vars, *cfg.monitor_vars) if kinds[c].typeName() in ("array", "map", "struct", "variant")]:
        raise ValueError(f"nested columns cannot be matched or monitored: {nested}")
    numeric = [v for v in cfg.match_vars if is_numeric(kinds[v])]
    categorical = [v for v in cfg.match_vars if v not in numeric]
    if loose := [v for v in categorical if v not in cfg.grouping_vars]:
        raise ValueError(f"categorical match_vars must remain in stratify_vars: {loose}")
    return numeric, categorical


def check_treatment(values: list[Any], name: str) -> None:
    if any(v not in (0, 1) for v in values):
        raise ValueError(f"{name} must be binary 0/1; saw {values!r}")
    if {int(v) for v in values} != {0, 1}:
        raise ValueError(f"{name} must contain both 0 and 1; saw {values!r}")
