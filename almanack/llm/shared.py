"""What the operators here share: tables in the folder that all machines see, the package on the executors, bounded samples."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.sources.tables import place, scratch, ship  # noqa: F401
from almanack.sources.tables import settle as table  # noqa: F401


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it; for tasks."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def tasks(df: DataFrame, each: int = 32 << 20) -> int:
    """How many tasks the rows of a table go to: one for ``each`` bytes that Catalyst counts in it, and not under the session's number, which also holds where Catalyst knows no size (rows that are no file's)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return _at_least(df.sparkSession, size // each if size < 1 << 50 else 1)


def tasks_of_files(paths: DataFrame) -> int:
    """A task for each file that a settled table names, and not under the session's number."""
    return _at_least(paths.sparkSession, paths.count())


def _at_least(spark: SparkSession, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, 1 << 17))


def least_by_hash(df: DataFrame, by: str, key: str, n: int, salts: int = 64) -> DataFrame:
    """The ``n`` rows of each group with the least hash of the key; each of 64 salts keeps ``n`` first, so no task gets a group."""
    h = F.xxhash64(key)
    first = F.row_number().over(Window.partitionBy(by, "__salt").orderBy(h, key))
    last = F.row_number().over(Window.partitionBy(by).orderBy(h, key))
    some = df.withColumn("__salt", F.pmod(F.hash(key), F.lit(salts))).withColumn("__nth", first).filter(F.col("__nth") <= n)
    return some.withColumn("__nth", last).filter(F.col("__nth") <= n).drop("__nth", "__salt")
