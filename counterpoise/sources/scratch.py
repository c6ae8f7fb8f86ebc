"""Scratch tables in a folder that driver and executors share, and row numbers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Sequence
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session, which has one machine, may leave it unnamed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that the driver and all executors share, as work_dir or in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="counterpoise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Workspace:
    """A folder for intermediate tables, removed on ``close`` unless it is to be kept.

    It lies in ``work_dir``, else in the shared folder of the session. Within ``with space:`` all scratch tables go there;
    ``with`` does not close it.
    """

    def __init__(self, spark: SparkSession, work_dir: str | None = None, keep: bool = False):
        base = work_dir or shared_dir(spark)
        self.spark, self.keep, self.path = spark, keep, f"{base.rstrip('/')}/workspace-{uuid.uuid4().hex}"
        self._tokens: list[Token] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: later readers share the result, and a lost executor costs a reread."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if not self.keep:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Workspace:
        self._tokens.append(_current.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _current.reset(self._tokens.pop())


_current: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
_loose: dict[str, Workspace] = {}


def workspace(spark: SparkSession) -> Workspace:
    """The workspace at hand; outside of any run, one for the whole session that goes when Python ends."""
    if (space := _current.get()) is not None:
        return space
    key = spark.sparkContext.applicationId
    if key not in _loose:
        _loose[key] = Workspace(spark)
        atexit.register(_forget, key)
    return _loose[key]


def _forget(key: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        _loose.pop(key).close()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the workspace at hand."""
    return workspace(df.sparkSession).store(df, name)


def row_numbers(df: DataFrame, name: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Add 1-based consecutive numbers in the order of ``order_by``, or of the rows as they are read.

    Rows are numbered within their partition and shifted by the sizes of the partitions before it, so no
    single task sees all rows. The numbered table is stored: its numbers are the same for every reader.
    """
    sorted_ = df.orderBy(*order_by) if order_by else df
    place = "__place"
    stored = scratch(sorted_.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(place), 33)
    sizes = stored.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    out = stored.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.select((F.col("__start") + local + 1).alias(name), *(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def ranked(df: DataFrame, by: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    """``df`` with 1-based places within the groups of ``by``, whose rows may be spread over tasks. It is stored."""
    placed = row_numbers(df, "__row", [*by, *order_by])
    firsts = placed.groupBy(*by).agg(F.min("__row").alias("__first"))
    return placed.join(firsts, list(by)).select(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns), (F.col("__row") - F.col("__first") + 1).alias(name))
