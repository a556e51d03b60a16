"""Account health over streams by ``transformWithState``: strikes, a cool-down with a retest, rows in order of their time, and a start from the last run.

Rows may come late, within the watermark's delay.  They wait in list state until
the watermark has passed them and are then settled in the order of their time, so
the result is that of a batch over the log, whatever the order of arrival.  What
an account is known for is value state: its strikes, and since when it is dead.
Event-time timers wake a key when its oldest row or its retest is due; so a dead
account is retested though nothing arrives any more.  ``before`` puts the states
that a batch left into the stream's.  State is kept in RocksDB, out of the heap.

Edge cases: rows without a key or a time are dropped; transient outcomes do
nothing; rows later than the delay are dropped by the watermark; equal times are
settled by ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 24 * 3600 * 10**6  # microseconds, as all times here; timers go by milliseconds


class Health(StatefulProcessor):
    """Transitions of one account: dead at ``dead_at`` strikes, retest ``cool`` after the last of them, alive at a success."""

    def __init__(self, dead_at: int, cool: int):
        self.dead_at, self.cool = dead_at, cool

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.health = handle.getValueState("health", "strikes long, since long")
        self.waiting = handle.getListState("waiting", "at long, seq long, outcome string")

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.health.update((initialState.strikes, initialState.since))
        if initialState.since is not None:
            self.wake(initialState.since + self.cool)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """All rows of a batch at once, and one timer for the oldest: each call of state is a message to the JVM."""
        new = [(r.at, r.seq, r.outcome) for r in rows]
        self.waiting.appendList(new)
        self.wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """All that is due by now, at the first timer that fires; the oldest row that is left has the next."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        strikes, since = self.health.get() if self.health.exists() else (0, None)
        rows = [tuple(r) for r in self.waiting.get()]
        done = sorted(r for r in rows if r[0] <= now)
        out = []
        for at, _, outcome in done:
            if since is not None and since + self.cool <= at:
                out.append((since + self.cool, "retest", strikes))
                since = None
            if outcome == "ok":
                if strikes >= self.dead_at:
                    out.append((at, "alive", 0))
                strikes, since = 0, None
            else:
                strikes += 1
                if strikes >= self.dead_at:
                    if since is None:
                        out.append((at, "dead", strikes))
                    since = at
        if since is not None:
            if since + self.cool <= now:
                out.append((since + self.cool, "retest", strikes))
                since = None
            else:
                self.wake(since + self.cool)
        if done:
            self.waiting.clear()
            if left := [r for r in rows if r[0] > now]:
                self.waiting.put(left)
                self.wake(min(left)[0])
        self.health.update((strikes, since))
        return iter([Row(key=key[0], at=at, status=status, strikes=n) for at, status, n in out])

    def close(self) -> None:
        pass


def health(log: DataFrame, key: str, outcome: str, seq: str, transient: list[str], delay: str, cool_days: int = 21, dead_at: int = 3, before: DataFrame | None = None, time: str = "ts") -> DataFrame:
    """key, at, status (dead, retest, alive) and strikes of every transition of a streamed log. ``before``: key, strikes and since (a timestamp or null) as the last run left them."""
    use_rocks(log.sparkSession)
    kept = log.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(outcome).isNotNull() & ~F.col(outcome).isin(transient))
    rows = kept.withWatermark(time, delay).select(F.col(key).alias("key"), time, micros(F.col(time)).alias("at"), F.col(seq).cast("long").alias("seq"), F.col(outcome).alias("outcome"))
    kind = StructType([StructField("key", log.schema[key].dataType), StructField("at", LongType()), StructField("status", StringType()), StructField("strikes", LongType())])
    first = None if before is None else before.select(F.col(key).alias("key"), F.col("strikes").cast("long").alias("strikes"), micros(F.col("since")).alias("since")).groupBy("key")
    out = rows.groupBy("key").transformWithState(Health(dead_at, cool_days * DAY), kind, "Append", "EventTime", first)
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias("at"), "status", "strikes")


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def use_rocks(spark: SparkSession) -> None:
    """``transformWithState`` asks for the RocksDB store; the session's own choice stays if it is one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKS)


def standing(log: DataFrame, key: str, outcome: str, seq: str, transient: list[str], upto: Column, cool_days: int = 21, dead_at: int = 3, time: str = "ts") -> DataFrame:
    """key, strikes and since of every account at the end of a finished log, for ``before``: aggregates only, so a long log is not sorted."""
    rows = log.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(outcome).isNotNull() & ~F.col(outcome).isin(transient) & (F.col(time) <= upto))
    ok, at = F.col(outcome) == "ok", F.struct(time, seq)
    last = rows.groupBy(key).agg(F.max(F.when(ok, at)).alias("__ok"))
    after = rows.filter(~ok).join(last, key).filter(F.col("__ok").isNull() | (at > F.col("__ok")))
    failed = after.groupBy(key).agg(F.count("*").alias("strikes"), F.max(time).alias("since"))
    is_dead = (F.col("strikes") >= dead_at) & (F.col("since") + F.make_dt_interval(F.lit(cool_days)) > upto)
    return failed.select(key, "strikes", F.when(is_dead, F.col("since")).alias("since"))
