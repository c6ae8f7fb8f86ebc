"""Preparing labelled training files, and exporting samples."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.functions.columns import col, is_finite
from counterpoise.sources.scratch import row_numbers


def read_headerless(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV (gzip or not) without header, all doubles; a field that is no number raises."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)


def tail_holdout(df: DataFrame, holdout: int, label_col: str, order_by: list[str] | None = None, id_name: str = "source_row_id", expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the rows and hold out the last ``holdout`` of them: (training rows, held-out rows).

    Raises ValueError for a row count other than ``expected``, for non-finite values and for labels besides 0 and 1.
    """
    numbered = row_numbers(df, id_name, order_by or [])
    values = [c for c in df.columns if c not in (order_by or [])]
    bad = F.lit(False)
    for c in values:
        bad = bad | ~is_finite(col(c))
    n, broken, labels = numbered.agg(F.count(F.lit(1)), F.count_if(bad), F.count_if(~col(label_col).isin(0, 1))).first()
    if expected is not None and n != expected:
        raise ValueError(f"expected {expected} rows, found {n}")
    if broken or labels:
        raise ValueError(f"{broken} rows with values that are not finite, {labels} labels that are not 0 or 1")
    if not 0 < holdout < n:
        raise ValueError("holdout must leave rows on both sides")
    return numbered.where(col(id_name) <= n - holdout), numbered.where(col(id_name) > n - holdout)


def write_zstd(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark knows; an existing one raises."""
    at, fs = _file_system(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def export_sample(result: Any, folder: str, name: str = "sample") -> str:
    """Write a sample as Parquet with its report and a manifest, to any file system that Spark knows; the name tells whether its checks passed."""
    spark, status = result.sample.sparkSession, result.report.summary["balance_status"]
    base = f"{str(folder).rstrip('/')}/{name}_{'accepted' if status == 'pass' else 'review'}"
    at, fs = _file_system(spark, base)
    if fs.exists(at):
        raise FileExistsError(base)
    result.sample.write.parquet(f"{base}/sample.parquet")
    write_text(spark, f"{base}/report.json", json.dumps(result.report.to_dict(), default=str, indent=1))
    manifest = {"rows": result.report.summary["sampled_rows"], "status": status, "columns": {f.name: f.dataType.simpleString() for f in result.sample.schema.fields}}
    write_text(spark, f"{base}/manifest.json", json.dumps(manifest, indent=1))
    return base


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file or folder: names, sizes and times of its files, on any file system that Spark knows."""
    at, fs = _file_system(spark, path)
    files, seen = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:32]


def cached_source(spark: SparkSession, path: str, make: Callable[[SparkSession, str], DataFrame], cache_dir: str, version: str = "1") -> DataFrame:
    """``make(spark, path)`` as a stored table, made again only if the files or ``version`` have changed.

    A table counts once it is whole: it is written under another name and then renamed.
    """
    key = hashlib.sha256(f"{fingerprint(spark, path)}:{version}".encode()).hexdigest()[:32]
    kept = f"{cache_dir.rstrip('/')}/source-{key}.parquet"
    at, fs = _file_system(spark, kept)
    if not fs.exists(at):
        part = f"{kept}-{uuid.uuid4().hex}"
        write_zstd(make(spark, path), part)
        if not fs.rename(_file_system(spark, part)[0], at) and not fs.exists(at):
            raise OSError(f"cannot rename {part}")
    return spark.read.parquet(kept)
