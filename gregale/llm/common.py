"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of code points other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


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


#: By application: its folder of a local master.
_LOCAL: dict[str, str] = {}


class Scratch:
    """Tables in the shared folder, one folder for each operator call; a lost executor rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(name)
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.remove(name)

    def keep_only(self, *names: str) -> None:
        """Drops the tables that the result doesn't read."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as one text can be very long. One size for all operators, so that it doesn't matter which is planned last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys of which repartition(n, key) puts the i-th into partition i, so that n packed parts fill n tasks evenly."""
    rows = spark.range(n * 40).groupBy(F.expr(f"pmod(hash(id), {n})").alias("at")).agg(F.min("id").alias("key")).collect()  # n rows
    return [k for _, k in sorted(((r["at"], r["key"]) for r in rows) if len(rows) == n else ((i, i) for i in range(n)))]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
