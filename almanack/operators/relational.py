"""Joins, keep-first and top-k shapes that the other operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.operators import phrases

#: A side is broadcast only if Catalyst's own size estimate is at most this.
BROADCAST_BYTES = 32 << 20
#: Rules that are sent to all rows at most; more are joined.
RULES = 20_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer bounds its size by ``limit``; else as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def few(rules: DataFrame) -> bool:
    """Whether ``rules`` may go to all rows as one array; a larger table is joined (``phrases``), with the same result."""
    return rules.limit(RULES + 1).count() <= RULES


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key: the first in the order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_by(df: DataFrame, keys: list, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows for each key, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def contains_max(df: DataFrame, key: str, text: str, rules: DataFrame, needle: str, weight: str, name: str) -> DataFrame:
    """``df`` and the largest weight of the rules whose needle its text has (0 if none).

    Up to ``RULES`` rules go to the rows as one array; more of them meet the rows
    by runs of characters.  Rows of one key have one text.
    """
    if few(rules):
        bag = rules.agg(F.collect_list(F.struct(F.col(needle).alias("n"), F.col(weight).alias("w"))).alias("__rules"))
        hits = F.aggregate("__rules", F.lit(0).cast("long"), lambda acc, r: F.when(F.contains(F.col(text), r["n"]), F.greatest(acc, r["w"].cast("long"))).otherwise(acc))
        return df.crossJoin(F.broadcast(bag)).withColumn(name, hits).drop("__rules")  # one row on the right
    heaviest = rules.groupBy(F.col(needle).alias("__n")).agg(F.max(F.col(weight).cast("long")).alias("__w"))
    found = phrases.found_needles(df, key, text, heaviest, "__n").join(heaviest, "__n").groupBy(key).agg(F.max("__w").alias("__w"))
    return df.join(found, key, "left").withColumn(name, F.greatest(F.coalesce("__w", F.lit(0)), F.lit(0)).cast("long")).drop("__w")


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    A union and one window, so the cost is a sort, whatever the number of rows
    of a key; right rows go first among equal times.
    """
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1)).withColumn("__hit", F.lit(None).cast(f"struct<{','.join(f'{v}:{right.schema[v].dataType.simpleString()}' for v in values)},{right_time}:{right.schema[right_time].dataType.simpleString()}>"))
    b = right.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values, right_time).alias("__hit"))
    order = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__hit", F.last("__hit", True).over(order)).filter("__side = 1")
    return both.select(*left.columns, *(F.col(f"__hit.{v}").alias(v) for v in values), F.col(f"__hit.{right_time}").alias(f"matched_{right_time}"))


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges [low, high) that hold them: an equi-join on buckets of ``width`` and the rest of the condition."""
    a = points.withColumn("__bucket", F.floor(F.col(at) / width))
    b = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return a.join(b, "__bucket").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bucket")


def anti(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return df.join(gone.select(*on).distinct(), on, "left_anti")


def hydrate(df: DataFrame, details: DataFrame, on: str) -> DataFrame:
    """Rows with each column replaced by the detail row's where that isn't null."""
    d = details.select(F.col(on), *(F.col(c).alias(f"__{c}") for c in details.columns if c != on))
    new = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if f"__{c}" in d.columns else F.col(c) for c in df.columns]
    return df.join(d, on, "left").select(*new)
