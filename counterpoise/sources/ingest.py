"""Reading inputs: Spark, pandas and Arrow tables, table names, and files by their suffix."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from counterpoise.functions.columns import col, is_numeric

SUFFIXES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".arrow": "arrow", ".feather": "arrow", ".ipc": "arrow", ".xlsx": "excel", ".xls": "excel"}


def read(spark: SparkSession, data: Any, encoding: str = "UTF-8") -> DataFrame:
    """``data`` as a DataFrame.

    Paths may be anything that Spark's readers open; Arrow and Excel files are read on the driver. A string
    without a known suffix is a table's name. BigQuery tables come through Spark's own connector, where its
    jar is on the class path: pass the DataFrame.
    """
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_pandas") or type(data).__module__.split(".")[0] == "pandas":
        return spark.createDataFrame(data)
    if not isinstance(data, (str, os.PathLike)):
        raise TypeError(f"cannot read {type(data).__name__}: give a path, a table's name, or a Spark, pandas or Arrow table")
    path = os.fspath(data)
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = SUFFIXES.get(suffix)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == ".tsv" else ",", encoding=encoding)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "arrow":
        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(path))
    if kind == "excel":
        return _excel(spark, path)
    if suffix and os.sep in path:
        raise ValueError(f"unknown file type {suffix!r}: use one of {sorted(SUFFIXES)}")
    if spark.catalog.tableExists(path):
        return spark.table(path)
    raise ValueError(f"no table and no known file type: {path!r}")


def _excel(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl
    except ImportError as e:
        raise ImportError("Excel files need openpyxl, which is not installed") from e
    rows = openpyxl.load_workbook(path, read_only=True, data_only=True).active.iter_rows(values_only=True)
    names = [f"_col_{i}" if x is None else str(x) for i, x in enumerate(next(rows))]
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(list(rows), columns=names))


def numbers_as_double(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every numeric column as double, but for ``keep``: ids stay exact beyond 2**53."""
    return df.select(*(col(f.name).cast("double").alias(f.name) if is_numeric(f.dataType) and f.name not in keep else col(f.name) for f in df.schema.fields))


def table_to_arrow(spark: SparkSession, name: str):
    """A session table as an Arrow table; an unknown name raises ValueError with those there are."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name!r}; there are {sorted(t.name for t in spark.catalog.listTables())}")
    return spark.table(name).toArrow()
