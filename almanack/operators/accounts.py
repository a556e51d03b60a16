"""Accounts and the addresses that they are read from: quality, activity, what to read next, and whose rows are whose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import rules, scores, text
from almanack.operators import rank, relational


def with_quality(df: DataFrame, quality: DataFrame, account: str = "account") -> DataFrame:
    """``df`` and the columns of ``quality`` for its account: by the name as it is, else by the folded name (of several the first by name)."""
    columns = [c for c in quality.columns if c != account]
    exact = quality.select(F.col(account), F.struct(*columns).alias("__q"))
    folded = quality.groupBy(text.fold(F.col(account)).alias("__fold")).agg(F.min_by(F.struct(*columns), account).alias("__r"))
    found = df.join(exact, account, "left").withColumn("__fold", text.fold(F.col(account))).join(folded, "__fold", "left")
    return found.select(*df.columns, *(F.coalesce(F.col(f"__q.{c}"), F.col(f"__r.{c}")).alias(c) for c in columns))


def activity(posts: DataFrame, by: str, is_event: str, order: str, keep: int) -> DataFrame:
    """by, posts, events, latest: how much an account posts, how much of it are events, and its ``keep`` latest in order."""
    n = posts.groupBy(by).agg(F.count("*").alias("posts"), F.count_if(F.col(is_event)).alias("events"))
    latest = relational.top_by(posts.select(by, order), [by], [F.desc(order)], keep).groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("latest"))
    return n.join(latest, by, "left")


def co_mentions(posts: DataFrame, account: str, caption: str) -> DataFrame:
    """account, n, points: by how many others it is mentioned."""
    named = posts.select(F.lower(account).alias("by"), F.explode(text.mentions(F.col(caption))).alias("account")).filter("by <> account")
    return named.groupBy("account").agg(F.count_distinct("by").alias("n")).withColumn("points", scores.tier(F.col("n"), rules.COMENTION_TIERS))


def seed_plan(seeds: DataFrame, health: DataFrame, dead: DataFrame, key: str, tier: str, least: int = 2) -> DataFrame:
    """key, yield, place: living seeds by tier, then by events for each success (known from ``least`` successes on)."""
    share = F.when(F.col("successes") >= least, F.try_divide("events", "successes"))
    alive = relational.anti(seeds, dead, [key]).join(health.select(key, share.alias("yield")), key, "left")
    return rank.global_rank(alive.withColumn("__y", F.coalesce("yield", F.lit(0.0))), [F.asc(tier), F.desc("__y"), F.asc(key)], "place").select(key, "yield", "place")


def follow_set(followed: DataFrame, affine: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Followed or affine accounts, once each, but the excluded."""
    return relational.anti(followed.select(key).union(affine.select(key)).distinct(), excluded, [key])


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "^@", "")


def rows_of(df: DataFrame, account: str, columns: tuple[str, ...] = ("account", "organizer", "source"), lists: tuple[str, ...] = ("contributing_accounts",)) -> DataFrame:
    """Rows that name an account in one of the columns or lists."""
    who = account.lower().strip().removeprefix("@")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(_plain(F.col(c)) == who, F.lit(False))
    for c in lists:
        hit = hit | F.coalesce(F.exists(c, lambda x: _plain(x) == who), F.lit(False))
    return df.filter(hit)


def dates(df: DataFrame) -> DataFrame:
    return df.select("date").distinct()


def on(df: DataFrame, day: Column) -> DataFrame:
    return df.filter(F.col("date") == day)


def worthy(found: DataFrame, key: str, score: str, least: int, k: int) -> DataFrame:
    """The ``k`` best candidates of at least that score (the feature: so many are read a run)."""
    return found.filter(F.col(score) >= least).orderBy(F.desc(score), key).limit(k)
