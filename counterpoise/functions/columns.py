"""Column expressions: quoting, finiteness, bins, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite(c: Column) -> Column:
    return F.when(is_finite(c), c.cast("double"))


def bucket(value: Column, edges: Sequence[float], last: int) -> Column:
    """The first bin whose upper edge is not below the value, else ``last``; bin 0 without edges."""
    if not edges:
        return F.lit(0)
    out = F.when(value <= float(edges[0]), 0)
    for k, edge in enumerate(edges[1:], 1):
        out = out.when(value <= float(edge), k)
    return out.otherwise(last)


def json_key(columns: Sequence[Column]) -> Column:
    """A JSON array of the values as text: null, text and numbers keep their identity, separators can't collide."""
    if not columns:
        return F.lit("[]")
    one = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(one(c), F.lit("null")) for c in columns)), F.lit("]"))


def seeded(seed: int, kind: str, *parts: Column) -> Column:
    """The md5 order key of a seeded draw."""
    pieces: list[Column] = [F.lit(f"{seed}:{kind}:")]
    for k, p in enumerate(parts):
        pieces += [F.lit(":"), p] if k else [p]
    return F.md5(F.concat(*pieces))
