"""Shared helpers of the corpus operators: let-bindings, word splitting, the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contract has it: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Largest side, in rows, that a caller may broadcast after having counted it.
BROADCAST_ROWS = 200_000

#: Rows in an Arrow batch while a step of ours runs.
BATCH_ROWS = 2_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` can use it often and it is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    made = tempfile.mkdtemp(prefix="fablework-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def _path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, deleted when the application ends.

    Where that is unset, a temporary one; with executors elsewhere that would be lost, so it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    at = f"{base.rstrip('/')}/fablework-{uuid.uuid4().hex}"
    files, path = _path(spark, at)
    files.deleteOnExit(path) if files.mkdirs(path) else None
    return at


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows an Arrow batch while a step of ours runs: long texts times the usual 10,000 rows fill much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = spark.conf.get(key, None)
    if asked is not None and 0 < int(asked) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.unset(key) if asked is None else spark.conf.set(key, asked)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    with _short_batches(spark):
        df.write.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._folder = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that nothing reads any more."""
    for df in frames:
        files, path = _path(df.sparkSession, df._folder)
        files.delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to be small enough, else as it is (AQE then splits skew)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
