"""Ranking of a batch: diversity, guaranteed slots, mixes and cohorts; everything has a unique last sort key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions import rules
from almanack.operators import relational
from almanack.sources import tables


def _penalty(df: DataFrame, by: str, score: str, key: str, steps: list[int], name: str) -> DataFrame:
    """``df`` and the step of each row's rank in its group.

    All ranks from the last step on cost the same, so only the rows before it are ranked: a task keeps that many of a
    group before any shuffle, and no task sorts a group.  The few ranked rows of a group go back to it as one array.
    """
    head = relational.top_by(df.select(by, score, key), [by], [F.desc(score), key], len(steps) - 1, "__r")
    listed = head.groupBy(by).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("__r").alias("r"))).alias("__head"))
    found = F.get(F.filter("__head", lambda x: x["k"] == F.col(key)), 0)["r"]
    step = F.element_at(F.array(*map(F.lit, steps)), F.coalesce(found, F.lit(len(steps))).cast("int"))
    return df.alias("d").join(listed.withColumnRenamed(by, "__by"), F.col(f"d.{by}").eqNullSafe(F.col("__by")), "left").select("d.*", step.alias(name))


def diversify(df: DataFrame, score: str, source: str | None, topic: str | None, key: str, floor: Column, source_steps: list[int] = rules.SOURCE_STEPS, topic_steps: list[int] = rules.TOPIC_STEPS) -> DataFrame:
    """Later rows of a source and of a topic lose points by their rank in it; rows at or above the floor don't fall below it. ``key`` is unique."""
    names = df.columns
    pen = F.lit(0)
    for i, (by, steps) in enumerate(((source, source_steps), (topic, topic_steps))):
        if by:
            df = _penalty(df, by, score, key, steps, f"__pen{i}")
            pen = pen + F.col(f"__pen{i}")
    raw = F.col(score)
    new = F.when(pen <= 0, raw).when(raw >= floor, F.greatest(floor, raw - pen)).otherwise(raw - pen)
    return df.withColumn("__new", new).select(*(F.col("__new").alias(c) if c == score else c for c in names))


def guarantee(df: DataFrame, score: str, key: str, wanted: Column, conviction: Column, floor: Column, slots: int = 12, lift: int = 5) -> DataFrame:
    """If none of the first ``slots`` is wanted, the best wanted row rises just above the least of them that may be displaced.

    Two one-row aggregates decide; nothing is collected.
    """
    keys = (F.desc(score), F.asc(key))
    top = df.orderBy(*keys).limit(slots)
    kept = top.agg(F.max(F.coalesce(wanted, F.lit(False)).cast("int")).alias("has"), F.min(F.when(~conviction & ~wanted, F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k")))).alias("victim"))
    best = df.filter(wanted & (F.col(score) >= floor)).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))).alias("best"))
    plan = kept.crossJoin(best).select(F.when((F.col("has") == 0) & F.col("victim").isNotNull(), -F.col("best.k")).alias("__who"), F.least(F.lit(1000), F.col("victim.s") + lift).alias("__to"))
    lifted = F.when(F.col(key) == F.col("__who"), F.col("__to")).otherwise(F.col(score))
    return df.crossJoin(F.broadcast(plan)).withColumn(score, lifted).drop("__who", "__to")  # one row on the right


def mix(df: DataFrame, lane: str, score: str, key: str, total: int, shares: dict[str, float]) -> DataFrame:
    """The best rows of each lane up to its share of ``total``; what a lane leaves open goes to the best of the rest."""
    df = relational.top_by(df, [lane], [F.desc(score), key], total, "__rank")  # no lane gives more, and a task keeps that many of each
    quota = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(round(total * v))))), F.col(lane)), F.lit(0))
    return df.withColumn("__own", F.col("__rank") <= quota).orderBy(F.desc("__own"), F.desc(score), key).limit(total).drop("__own", "__rank")


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` and each row's place from 0 in the order, which must be total: rows are sorted by ranges over all tasks, and each task counts on from those before it."""
    placed = tables.settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__task", F.shiftright("__at", 33))
    counts = placed.groupBy("__task").agg(F.count("*").alias("n"), F.min("__at").alias("first"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.select("__task", (before - F.col("first")).alias("__base"))), "__task").withColumn(name, F.col("__at") + F.col("__base")).drop("__at", "__task", "__base")


def cohort(df: DataFrame, order: list, slot: int, head: int, size: int) -> DataFrame:
    """The first ``head`` rows, and ``size`` of the others in turn by the slot."""
    ranked = global_rank(df, order, "__rn")
    rest = ranked.agg((F.count("*") - head).alias("__n"))
    turn = F.pmod(F.col("__rn") - head - slot * size, F.greatest(F.col("__n"), F.lit(1))) < size
    return ranked.crossJoin(F.broadcast(rest)).filter((F.col("__rn") < head) | turn).drop("__rn", "__n")  # one row on the right


def primary_topic(categories: Column, title: Column) -> Column:
    """One topic of an event: words of the title that correct co-tags, then the first in a fixed order, then its own first."""
    t = F.lower(F.coalesce(title, F.lit("")))
    named = F.coalesce(*(F.when(F.array_contains(categories, c), c) for c in rules.TOPIC_ORDER))
    return F.when(t.rlike(r"\brun club\b|\brun\b"), "run").when(t.rlike("contra|salsa|swing danc|lindy|bachata"), "dance").when(t.rlike(r"\b(?:dj|techno|house music|warm up|b2b)\b"), "music").otherwise(F.coalesce(named, F.try_element_at(categories, F.lit(1)), F.lit("other")))


def source_key(account: Column, organizer: Column, source: Column, venue: Column) -> Column:
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    low = lambda c: F.lower(F.trim(c))
    return F.when(has(account), F.concat(F.lit("acct:"), low(account))).when(has(organizer), F.concat(F.lit("org:"), low(organizer))).when(has(venue), F.concat(F.lit("srcloc:"), source, F.lit("|"), low(venue))).otherwise(F.concat(F.lit("src:"), source))


def day_groups(df: DataFrame, day: str, score: str, key: str, today: Column) -> DataFrame:
    """Upcoming days ascending, then past ones descending; within a day by score."""
    past = F.col(day) < today
    return df.orderBy(past, F.when(~past, F.col(day)), F.desc(F.when(past, F.col(day))), F.desc(score), key)
