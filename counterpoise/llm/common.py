"""Shared plumbing of the training-data operators: inputs, scratch tables, folds, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, which has one machine, may leave it unnamed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: tables in a machine's own folder are read back incomplete")
        named = tempfile.mkdtemp(prefix="counterpoise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Stored tables that are made inside go at the end, whether it ends well or not."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df`` with a note of the stored tables that it reads, so that ``settled`` can remove them."""
    df._reads = tables
    return df


def settled(df: DataFrame, base: DataFrame, tag: str) -> DataFrame:
    """``df``, which is made of ``base``, stored; what ``base`` reads goes."""
    out = materialize(df, tag)
    discard(*base._reads)
    return out


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), passing: bool = True) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files and not a rerun of
    what made them, and several readers share one computation. The shuffle files of the write go with it.
    Within ``passing_tables`` the table goes at the end, unless it is not ``passing``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if passing and (made := _scope.get()) is not None:
        made.append(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before or "false")
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` stored with a number for each row, so that all later readers see the same number beside the same row.

    A number that is computed anew in each reading follows how the files are split among tasks, and that
    changes with the executors at hand.
    """
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


#: The most rows that an Arrow batch of texts may have: texts can be long, and a batch is held twice.
BATCH_ROWS = 1000


def give_back() -> None:
    """Return what a finished task has freed to the system: Python workers live on with other tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[str, object] = {}


def kept(key: str, make):
    """What a worker keeps for its next tasks, made when it is first asked for."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def let_go(but: str | None) -> None:
    """Drop what tasks of other operators kept in this worker."""
    for key in [k for k in _kept if k != but]:
        del _kept[key]


def map_batches(df: DataFrame, run, schema, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows in this session; memory is given back after each task,
    but for what ``run`` has ``kept`` under the key ``keeps``."""

    def tidy(batches):
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(tidy, schema)


#: The most rows, and the most characters as JSON, of a table that a join may send to every executor; beyond them both sides are exchanged.
BROADCAST_ROWS, BROADCAST_CHARS = 400_000, 64_000_000


def is_small(df: DataFrame) -> bool:
    """Whether a stored table is within the bounds of a broadcast, by its rows and by what they hold."""
    n, chars = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct(*(q(c) for c in df.columns)))))).first()
    return n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcasting if it is within the bounds."""
    return F.broadcast(df) if is_small(df) else df


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no learner may see: crc32 of the id's text, mod 4, is 2. A null id is in no fold: false."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Working column names that clash with none of ``df``'s, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        got = name
        while got.lower() in taken:
            got = f"_{got}"
        taken.add(got.lower())
        out[name] = got
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names, whatever their case: result columns take their places."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.select(*(q(c) for c in df.columns if c not in clash)) if clash else df


def q(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts, max_chars: int = 1 << 20, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Whole texts of an Arrow column in runs of about ``max_chars`` characters (null: empty), so that a worker's
    memory doesn't follow the size of a batch."""
    run: list[str] = []
    at = begin = held = 0
    for at, text in enumerate((t for k in range(0, len(texts), rows) for t in texts[k : k + rows].to_pylist()), 1):
        run.append(text or "")
        held += len(run[-1])
        if held >= max_chars:
            yield begin, run
            run, begin, held = [], at, 0
    if run:
        yield begin, run
