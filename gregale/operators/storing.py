"""Intermediate tables, computed once and written where driver and executors both reach them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: its folder of a local master, and the folders of tables stored so far.
_LOCAL: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset (tests), a local one.

    A local one is made for a local master alone: elsewhere executors wouldn't see it, so an unset folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(context.applicationId)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="gregale-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def delete_path(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed now, as a table in the shared folder: a lost executor rereads it, and nothing in it is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Drops all tables stored so far, for callers whose results are written; how many there were."""
    tables = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in tables:
        delete_path(spark, path)
    return len(tables)
