"""Reports over a feed: ingestion, regressions, audits, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.operators import phrases, relational


def share(part: Column, whole: Column) -> Column:
    """In whole thousandths, rounded down; 0 of nothing."""
    return F.coalesce(F.floor(F.try_divide(part * 1000, whole)), F.lit(0)).cast("long")


def regressions(previous: DataFrame, current: DataFrame, by: str, at_least: int = 5) -> DataFrame:
    """by, before, after, regressed: a group of ``at_least`` rows that has none now."""
    a, b = previous.groupBy(by).agg(F.count("*").alias("before")), current.groupBy(by).agg(F.count("*").alias("after"))
    both = a.join(b, by, "full_outer").select(by, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("regressed", (F.col("before") >= at_least) & (F.col("after") == 0))


def survival(raw: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """by, raw, survived, verdict: zero (3 or more, none kept), low (4 or more, under a quarter kept), ok."""
    a, b = raw.groupBy(by).agg(F.count("*").alias("raw")), kept.groupBy(by).agg(F.count("*").alias("survived"))
    both = a.join(b, by, "left").select(by, "raw", F.coalesce("survived", F.lit(0)).alias("survived"))
    return both.withColumn("verdict", F.when((F.col("raw") >= 3) & (F.col("survived") == 0), "zero").when((F.col("raw") >= 4) & (F.col("survived") * 4 < F.col("raw")), "low").otherwise("ok"))


def url_class(found: Column, future: Column) -> Column:
    return F.when(found == 0, "dead").when(future == 0, "stale").when(future * 4 < found, "mostly_past").otherwise("live")


def ranked_feed(top: DataFrame, personal: Column, topic: str, source: str, series: str) -> DataFrame:
    """One row about the top of a feed: personal_milli, topics, top_source_milli, repeated_series."""
    whole = top.agg(F.count("*").alias("n"), F.sum(personal.cast("int")).alias("p"), F.count_distinct(topic).alias("topics"))
    most = top.groupBy(source).count().agg(F.max("count").alias("s"))
    repeat = top.groupBy(series).count().agg(F.max("count").alias("r"))
    return whole.crossJoin(most).crossJoin(repeat).select(share(F.col("p"), F.col("n")).alias("personal_milli"), "topics", share(F.col("s"), F.col("n")).alias("top_source_milli"), F.col("r").alias("repeated_series"))  # one row each


def must_surface(rows: DataFrame, fields: list[str], rules: DataFrame) -> DataFrame:
    """name, hits, ok for each rule (name, needle, least): how many rows have its needle in the fields together."""
    texts = rows.select(F.lower(F.concat_ws(" ", *fields)).alias("t"))
    if relational.few(rules):
        bag = rules.agg(F.collect_list(F.struct("name", "needle")).alias("bag"))
        met = F.filter("bag", lambda r: F.contains("t", r["needle"]))
        counted = texts.crossJoin(F.broadcast(bag)).select(F.explode(met).alias("r")).groupBy("r.name").agg(F.count("*").alias("hits"))  # one row on the right
    else:
        once = texts.groupBy("t").agg(F.count("*").alias("n"))
        counted = phrases.found_needles(once, "t", "t", rules, "needle").join(once, "t").join(rules, "needle").groupBy("name").agg(F.sum("n").alias("hits"))
    return rules.join(counted, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) >= F.col("least")).alias("ok"))


def north_star(rows: DataFrame, followed: DataFrame, topics: list[str], account: str = "account", categories: str = "categories", vouched: str = "vouched") -> DataFrame:
    """One row: the share of followed accounts with rows, how many of the topics are met, and the share of vouched rows."""
    known = followed.select(account).distinct()
    covered = known.join(rows.select(account), account, "left_semi").agg(F.count("*").alias("covered")).crossJoin(known.agg(F.count("*").alias("known")))  # one row each
    met = rows.select(F.explode(categories).alias("c")).filter(F.col("c").isin(topics)).agg(F.count_distinct("c").alias("topics"))
    whole = rows.agg(F.count_if(F.col(vouched)).alias("v"), F.count("*").alias("n"))
    return covered.crossJoin(met).crossJoin(whole).select(share(F.col("covered"), F.col("known")).alias("coverage_milli"), "topics", share(F.col("v"), F.col("n")).alias("conviction_milli"))


def by_account(rows: DataFrame, known: DataFrame, account: str) -> DataFrame:
    """account, n, silenced: rows of each known account; those without any are silenced."""
    n = rows.groupBy(account).agg(F.count("*").alias("n"))
    return known.select(account).distinct().join(n, account, "left").select(account, F.coalesce("n", F.lit(0)).alias("n")).withColumn("silenced", F.col("n") == 0)


def client_counts(rows: DataFrame, by: str, today: Column, visited: Column) -> DataFrame:
    """by, week (the next seven days), fresh (first seen since the last visit), days, attended, total."""
    return rows.groupBy(by).agg(F.count_if(F.col("date").between(today, F.date_add(today, 6))).alias("week"), F.count_if(F.col("first_seen_at") > visited).alias("fresh"), F.count_distinct("date").alias("days"), F.count_if("attended").alias("attended"), F.count("*").alias("total"))
