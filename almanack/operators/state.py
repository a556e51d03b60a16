"""What a run carries over to the next, as joins of the last snapshot and log replays; ``streaming.stateful`` has the same by the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(current: DataFrame, previous: DataFrame, key: str, now: Column) -> DataFrame:
    """``current`` and first_seen_at: the previous one, else this row's own, else now; engagement_delta: growth of likes + 5 x comments, if any."""
    p = previous.select(key, F.col("first_seen_at").alias("__f"), F.col("likes").alias("__l"), F.col("comments").alias("__c"))
    own = F.col("first_seen_at") if "first_seen_at" in current.columns else F.lit(None).cast("timestamp")
    grown = (F.coalesce("likes", F.lit(0)) - F.coalesce("__l", F.lit(0))) + 5 * (F.coalesce("comments", F.lit(0)) - F.coalesce("__c", F.lit(0)))
    known = F.col("__l").isNotNull() | F.col("__c").isNotNull()
    return current.join(p, key, "left").withColumn("engagement_delta", F.when(known & (grown > 0), grown)).withColumn("first_seen_at", F.coalesce("__f", own, now)).drop("__f", "__l", "__c")


def carry_over(current: DataFrame, previous: DataFrame, failed: DataFrame, today: Column) -> DataFrame:
    """Current rows, and the previous ones of sources that failed, until their date has passed."""
    kept = previous.join(failed.select("source").distinct(), "source", "left_semi").filter(F.col("date") >= today)
    return current.unionByName(kept.join(current.select("event_id"), "event_id", "left_anti"), allowMissingColumns=True)


def streaks(log: DataFrame, key: str, order: list, ok: str, skip_at: int) -> DataFrame:
    """key, failures (in a row, at the end of the log), successes, last_ok, skipped: a success resets the count."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = log.withColumn("__run", F.sum(F.col(ok).cast("int")).over(w))
    last = runs.groupBy(key).agg(F.max("__run").alias("__last"), F.sum(F.col(ok).cast("int")).alias("successes"), F.max(F.when(F.col(ok), F.col("ts"))).alias("last_ok"), F.max("ts").alias("last_ts"))
    tail = runs.join(last, key).filter((F.col("__run") == F.col("__last")) & ~F.col(ok)).groupBy(key).agg(F.count("*").alias("failures"))
    return last.join(tail, key, "left").select(key, F.coalesce("failures", F.lit(0)).alias("failures"), "successes", "last_ok", "last_ts").withColumn("skipped", F.col("failures") >= skip_at)


def retest(health: DataFrame, key: str, now: Column, after_days: int = 7, k: int = 5) -> DataFrame:
    """The ``k`` skipped keys that waited longest, at least ``after_days``."""
    return health.filter(F.col("skipped") & (F.datediff(now, "last_ts") >= after_days)).orderBy("last_ts", key).limit(k)


def prunable(failures: Column, successes: Column, last: Column, now: Column) -> Column:
    """Twelve failures in a row and no success ever, or nothing for thirty days."""
    return (successes == 0) & ((failures >= 12) | (F.datediff(now, last) >= 30))


def strikes(log: DataFrame, key: str, outcome: str, transient: list[str], dead_at: int = 3) -> DataFrame:
    """key, strikes and dead: permanent failures since the last success; transient ones never count."""
    permanent = log.filter(~F.col(outcome).isin(transient))
    last_ok = permanent.filter(F.col(outcome) == "ok").groupBy(key).agg(F.max(F.struct("ts", "seq")).alias("ok_at"))
    after = permanent.join(last_ok, key, "left").filter((F.col(outcome) != "ok") & (F.col("ok_at").isNull() | (F.struct("ts", "seq") > F.col("ok_at"))))
    n = after.groupBy(key).agg(F.count("*").alias("strikes"))
    return log.select(key).distinct().join(n, key, "left").select(key, F.coalesce("strikes", F.lit(0)).alias("strikes")).withColumn("dead", F.col("strikes") >= dead_at)


def learn(actions: DataFrame, key: str, sign: str, weight: str, hide_at: int = 3, like_at: int = 5, k: int = 25) -> DataFrame:
    """key, verdict, total: enough hides exclude, enough likes curate (the top ``k`` of them), and excluding wins."""
    total = actions.groupBy(key).agg(F.sum(F.when(F.col(sign) < 0, F.col(weight)).otherwise(0)).alias("hides"), F.sum(F.when(F.col(sign) > 0, F.col(weight)).otherwise(0)).alias("likes"))
    out = total.filter(F.col("hides") >= hide_at).select(key, F.lit("excluded").alias("verdict"), F.col("hides").alias("total"))
    good = total.filter((F.col("likes") >= like_at) & (F.col("hides") < hide_at)).orderBy(F.desc("likes"), key).limit(k)
    return out.unionByName(good.select(key, F.lit("curated").alias("verdict"), F.col("likes").alias("total")))


def refetch_depth(seen: Column, emitted: Column) -> Column:
    """How many of an account's newest posts are read again whatever its cursor: three, or by the events that a post has brought, once ten are known."""
    share = emitted / F.greatest(seen, F.lit(1))
    by_yield = F.when(share >= 1, 8).when(share >= 0.5, 5).when(share < 0.1, 1).otherwise(3)
    return F.when(seen >= 10, by_yield).otherwise(3)


def since_cursor(posts: DataFrame, cursors: DataFrame, key: str, order: str, refresh: int | Column = 3) -> DataFrame:
    """Posts newer than the key's cursor, and its ``refresh`` newest others again; ``refresh`` may be a column of ``cursors``."""
    known = cursors.select(F.col(key), "cursor", (F.lit(refresh) if isinstance(refresh, int) else refresh).alias("__depth"))
    joined = posts.join(known, key, "left")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return joined.withColumn("__rn", rank).filter(F.col("cursor").isNull() | (F.col(order) > F.col("cursor")) | (F.col("__rn") <= F.col("__depth"))).drop("__rn", "cursor", "__depth")


def stale(newest: Column, now: Column, days: int = 60) -> Column:
    """Whether an account has posted nothing for so long that it isn't read any more."""
    return newest.isNull() | (F.datediff(now, newest) > days)
