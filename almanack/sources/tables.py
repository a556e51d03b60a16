"""Tables in the folder that all machines of the cluster see."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in tests, a folder in the warehouse."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return where or os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "shared")


_scopes: list[list[str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which ends its lineage: a lost executor costs one task."""
    path = place(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of whatever runs within are dropped as soon as it ends; else they stay until the driver happens to collect its garbage."""
    drops = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(drops, None)
    spark.conf.set(drops, "true")
    try:
        yield
    finally:
        spark.conf.unset(drops) if before is None else spark.conf.set(drops, before)


def remove(spark: SparkSession, path: str) -> None:
    """Drop a folder that is no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Drop the files of a settled table that nothing reads any more."""
    if (path := getattr(df, "_settled_at", None)) is not None:
        remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Whatever is placed in the shared folder within is dropped at the end, but for the tables that were appended to the list."""
    scope: list[str] = []
    keep: list[DataFrame] = []
    _scopes.append(scope)
    try:
        yield keep
    finally:
        _scopes.remove(scope)
        kept = {getattr(df, "_settled_at", None) for df in keep}
        for path in scope:
            if path not in kept:
                remove(spark, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_almanack_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as at:
        shutil.copytree(package, Path(at, "tree", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        kept = Path(tempfile.mkdtemp(prefix="almanack-"))
        sc.addPyFile(shutil.make_archive(str(kept / "almanack_package"), "zip", Path(at, "tree")))
    sc._almanack_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_new(existing: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Existing rows, and found ones whose key is new, once each."""
    return existing.unionByName(found.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and existing ones whose keys the new rows haven't."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, order: list, n: int) -> DataFrame:
    """Retention: the last ``n`` rows in the order."""
    return df.orderBy(*order).limit(n)
