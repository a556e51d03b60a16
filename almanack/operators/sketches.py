"""Aggregates that are stored and merged: distinct counts, quantiles and heavy hitters by run, read later over any set of runs.

A run's rows are read once; what is kept of them for each group is three sketches
of bounded size, whatever their number (HyperLogLog, KLL, and the frequent
items of data sketches, all Spark's own).  Merging is an aggregate over sketches,
so it may go on from merged ones, by day, month or source.  The errors are those
of the sketches: ``ERROR`` of a distinct count (three standard deviations at 2^12
registers) and of a quantile's rank; an item of more than 1/``ITEMS`` of the rows
is never missed among the frequent ones, and counts are off by less than that.
Frequent items are those whose least possible count exceeds the sketch's error, of
3.5 in its places; so there are 8,192 places (``PLACES``, of which three quarters
are used), and a sketch of many different items takes some 100 kilobytes.

Edge cases: nulls count in ``n`` only; a group without values has estimates of 0,
null and none; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS, RANKS, ITEMS, ERROR = 12, 200, 1000, 0.05
PLACES = 6 * ITEMS


def sketched(rows: DataFrame, by: list[str], who: str, value: str) -> DataFrame:
    """``by``, n, and the sketches of ``who`` (distinct, frequent) and ``value`` (quantiles)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(who), REGISTERS).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), RANKS).alias("ranks"),
        F.expr(f"approx_top_k_accumulate(`{who}`, {PLACES}) FILTER (WHERE `{who}` IS NOT NULL)").alias("items"),
    )


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """Kept sketches of several runs as one for each ``by``, which may be kept and merged again."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"), F.expr(f"approx_top_k_combine(items, {PLACES})").alias("items"))


def distinct(sketch: str = "distinct") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "ranks") -> Column:
    """Null of no values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(share)))


def frequent(kept: DataFrame, by: list[str], k: int) -> DataFrame:
    """by and ``top``: the ``k`` most frequent of each row's sketch with their counts; fewer, or none, where no more are sure to be frequent."""
    return kept.groupBy(*by).agg(F.expr(f"approx_top_k_combine(items, {PLACES})").alias("items")).select(*by, F.expr(f"approx_top_k_estimate(items, {k})").alias("top"))
