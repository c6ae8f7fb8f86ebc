"""Treatment flag, missing values as values of their own, and numbers in place of nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.functions.columns import col, finite, is_finite, is_numeric

#: Stands for a missing category.
MISSING = "__MISSING__"


def treatment_is(t: Column, kind: T.DataType, value: int) -> Column:
    """Whether a treatment column of this type has the value 1 (or 0, or the boolean of it)."""
    if isinstance(kind, T.BooleanType):
        return t == F.lit(bool(value))
    return t.cast("double") == value if is_numeric(kind) else F.lit(False)


def label_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def prepare(df: DataFrame, treatment_col: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``df`` with ``_treatment``, ``is_missing_<v>`` of numeric match variables, and imputed match variables.

    A null treatment is a control. Numeric nulls, NaN and infinities are missing: 0 and a flag.
    """
    changed = {v: F.coalesce(finite(col(v)), F.lit(0.0)) for v in numeric} | {v: label_text(col(v)) for v in categorical}
    flag = F.when(treatment_is(col(treatment_col), df.schema[treatment_col].dataType, 1), 1).otherwise(0).alias("_treatment")
    missing = [(~is_finite(col(v))).alias(f"is_missing_{v}") for v in numeric]
    return df.select(*(changed[c].alias(c) if c in changed else col(c) for c in df.columns), flag, *missing)
