"""Lineage cuts by tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_dir() -> str:
    made = tempfile.mkdtemp(prefix="fablework-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted at the latest with the application.

    Where that is unset, below a temporary one, with local masters only: other executors would not see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    at = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table below the shared folder and read back, computed once; it goes with ``discard``."""
    spark = df.sparkSession
    at = shared_folder(spark)
    df.write.parquet(f"{at}/t")
    out = spark.read.schema(df.schema).parquet(f"{at}/t")
    out._folder = at
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for frames that nothing reads any more; others are left alone."""
    for df in frames:
        at = getattr(df, "_folder", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
