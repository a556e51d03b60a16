"""State from run to run, and the same over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.operators import sketches, state
from almanack.plans.registry import query
from almanack.sources import connectors, tables
from almanack.sources.tables import load
from almanack.streaming import lifecycle, stateful, windows


@query("""
WITH l AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l),
m AS (SELECT user_id, max(run) AS last, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS successes, max(ts) FILTER (ok) AS last_ok, max(ts) AS last_ts FROM r GROUP BY 1),
t AS (SELECT r.user_id, count(*) AS failures FROM r JOIN m ON m.user_id = r.user_id AND r.run = m.last WHERE NOT ok GROUP BY 1)
SELECT m.user_id, coalesce(failures, 0) AS failures, successes, last_ok, last_ts, coalesce(failures, 0) >= 2 AS skipped FROM m LEFT JOIN t USING (user_id)
""")
def url_health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success, by replay of the log."""
    log = load(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return state.streaks(log, "user_id", ["ts", "event_id"], "ok", 2)


@query("""
WITH l AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'timeout' ELSE 'gone' END AS o FROM events),
p AS (SELECT * FROM l WHERE o <> 'timeout'), k AS (SELECT user_id, max(ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS ok_at FROM p WHERE o = 'ok' GROUP BY 1),
n AS (SELECT p.user_id, count(*) AS strikes FROM p LEFT JOIN k USING (user_id) WHERE o <> 'ok' AND (ok_at IS NULL OR p.ts::VARCHAR || lpad(p.event_id::VARCHAR, 20, '0') > ok_at) GROUP BY 1)
SELECT u.user_id, coalesce(strikes, 0) AS strikes, coalesce(strikes, 0) >= 3 AS dead FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n USING (user_id)
""")
def strike_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three permanent failures without a success between make a key dead."""
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "timeout").otherwise("gone")
    log = load(spark, sf_dir, "events").withColumn("outcome", kind).withColumn("seq", F.col("event_id"))
    return state.strikes(log, "user_id", "outcome", ["timeout"])


@query("""
WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS h, count(*) FILTER (event_type = 'purchase') AS l FROM events GROUP BY 1),
g AS (SELECT user_id, 'curated' AS verdict, l AS total FROM t WHERE l >= 5 AND h < 8 ORDER BY l DESC, user_id LIMIT 25)
SELECT user_id, 'excluded' AS verdict, h AS total FROM t WHERE h >= 8 UNION ALL SELECT * FROM g
""")
def engagement_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough hides exclude, enough likes curate; excluding wins (the feature: at most 25 a run)."""
    e = load(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").withColumn("sign", F.when(F.col("event_type") == "error", -1).otherwise(1)).withColumn("w", F.lit(1))
    return state.learn(e, "user_id", "sign", "w", hide_at=8)


@query("""
WITH c AS (SELECT user_id, max(event_id) AS cursor, count(*) AS seen, count(*) FILTER (event_type IN ('purchase', 'signup')) AS found FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1),
d AS (SELECT *, CASE WHEN seen < 10 THEN 3 WHEN found >= seen THEN 8 WHEN 2 * found >= seen THEN 5 WHEN 10 * found < seen THEN 1 ELSE 3 END AS depth FROM c)
SELECT event_id, user_id FROM (SELECT e.*, cursor, depth, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id DESC) AS rn FROM events e LEFT JOIN d USING (user_id)) WHERE cursor IS NULL OR event_id > cursor OR rn <= depth
""")
def cursor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each key's cursor, and one to eight of its newest again, by what its rows brought."""
    e = load(spark, sf_dir, "events")
    known = e.filter("ts < timestamp_ntz'2024-01-25'").groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.count("*").alias("seen"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("found"))
    return state.since_cursor(e, known, "user_id", "event_id", state.refetch_depth(F.col("seen"), F.col("found"))).select("event_id", "user_id")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by hour and type."""
    return windows.tumbling(load(spark, sf_dir, "events"), ["event_type"], "1 hour")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL 1 HOUR * k AS window_start, event_type, count(*) AS n FROM events, range(0, 3) AS r(k) GROUP BY 1, 2
""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over three hours, every hour."""
    return windows.sliding(load(spark, sf_dir, "events"), ["event_type"], "3 hours", "1 hour")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM r GROUP BY user_id, i
""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after two quiet hours."""
    return windows.sessions(load(spark, sf_dir, "events"), ["user_id"], "2 hours")


@query("""SELECT DISTINCT event_id, user_id FROM events""")
def watermark_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of a replayed stream; all of its rows are within the watermark's delay."""
    rows = windows.stream(spark, f"{sf_dir}/events.parquet")
    return windows.drain(windows.distinct(rows, ["event_id"], "60 days").select("event_id", "user_id"), "dedup")


@query("""SELECT user_id, min(ts) AS first_seen, count(*) AS n FROM events GROUP BY 1""")
def stateful_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sighting and count of each key, from state kept over a stream; the last row of each key is its state."""
    rows = windows.stream(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    out = windows.drain(stateful.first_seen(rows, "user_id"), "first-seen")
    return out.groupBy("user_id").agg(F.min("first_seen").cast("timestamp_ntz").alias("first_seen"), F.max("n").alias("n"))


@query("""
WITH old AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1), new AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT user_id, event_id FROM new UNION ALL SELECT user_id, event_id FROM old WHERE user_id NOT IN (SELECT user_id FROM new)
""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table after an upsert."""
    e = load(spark, sf_dir, "events")
    last = lambda where: e.filter(where).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return tables.upsert(last("ts < timestamp_ntz'2024-01-29'"), last("ts >= timestamp_ntz'2024-01-29'"), ["user_id"])


@query("""SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five thousand rows of a log (the feature: retention)."""
    return tables.keep_last(load(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 5000)


@query("""
WITH l AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS ok FROM events WHERE event_type <> 'error'),
u AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY AS w FROM l),
r AS (SELECT l.*, w, sum(CAST(ok AS INT)) OVER o AS run, lag(ts) OVER o AS last, lead(ts) OVER o AS next FROM l, u WHERE ts <= w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS n FROM r),
p AS (SELECT *, ts + INTERVAL 2 DAY AS due, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3, false) AS was FROM n),
t AS (SELECT user_id, ts AS happened_at, 'dead' AS status, n AS strikes FROM p WHERE NOT ok AND n >= 3 AND (NOT was OR last + INTERVAL 2 DAY <= ts)
      UNION ALL SELECT user_id, due, 'retest', n FROM p WHERE NOT ok AND n >= 3 AND due <= w AND (next IS NULL OR next >= due)
      UNION ALL SELECT user_id, ts, 'alive', CAST(0 AS BIGINT) FROM p WHERE ok AND was)
SELECT * FROM t WHERE happened_at > TIMESTAMP '2024-01-06'
""")
def strike_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When accounts die, are retested and come back, by state kept over a stream whose rows come up to two days late; it starts from what the log until 6 January left.

    Retests are due after two days, as the log has a month only (the default is 21 days). The last two days are still open.
    """
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "timeout").otherwise("gone")
    log = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("outcome"))
    cut, rules = F.lit("2024-01-06").cast("timestamp_ntz"), {"key": "user_id", "outcome": "outcome", "seq": "event_id", "transient": ["timeout"], "cool_days": 2}
    before = lifecycle.standing(log, upto=cut, **rules)
    late = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.pmod(F.hash("event_id"), F.lit(172_000))  # arrival, up to two days after
    since = F.unix_timestamp(F.lit("2024-01-06").cast("timestamp"))
    rows = windows.replay(log.filter(F.col("ts") > cut), F.least(F.floor((late - since) / (5 * 86_400)), F.lit(5)).cast("int"), 6, "late-log")
    out = windows.drain(lifecycle.health(rows, delay="2 days", before=before, **rules), "lifecycle")
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("happened_at"), "status", "strikes")


@query("""SELECT event_id, user_id, value, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS run FROM events""")
def cursor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in three runs of a source whose offsets are cursors: a query that is stopped and started again after each run reads every row once."""
    connectors.register(spark)
    e = load(spark, sf_dir, "events")
    run = F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), 1).when(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), 2).otherwise(3)
    rows, path, out = e.select("event_id", "user_id", "value", run.alias("run")), tables.place(spark, "posts"), tables.place(spark, "read")
    for i in (1, 2, 3):
        connectors.append_run(rows.filter(F.col("run") == i), path, i)
        read = spark.readStream.format("post_log").schema(rows.schema).option("path", path).load()
        read.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("""SELECT a.event_id, b.event_id AS then_event_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 90 MINUTE""")
def followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and the purchases of the same user within 90 minutes, as a join of two streams; rows come up to a day late, as the watermarks allow."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    late = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.hash("event_id"), F.lit(86_000))
    part = F.least(F.greatest(F.floor((late - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (8 * 86_400)), F.lit(0)), F.lit(3)).cast("int")
    rows = windows.replay(e, part, 4, "late-pairs")
    side = lambda kind: rows.filter(F.col("event_type") == kind).drop("event_type")
    return windows.drain(windows.followed(side("view"), side("purchase"), "user_id", 90, "1 day").select("event_id", "then_event_id", "user_id"), "followed")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS middle_near, true AS hitters_met FROM events GROUP BY event_type""")
def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users, the middle value and the most frequent users of each type, from sketches that were kept by day and merged; whether they are as near to the exact ones as promised."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kept = tables.settle(sketches.sketched(e, ["event_type", "day"], "user_id", "value"), "sketches")
    months = tables.settle(sketches.merged(kept, ["event_type"]), "merged")
    top = sketches.frequent(months, ["event_type"], 1)
    read = months.select("event_type", F.col("n").alias("kept"), sketches.distinct().alias("near_users"), sketches.quantile(0.5).alias("middle"))
    exact = e.join(read, "event_type").groupBy("event_type", "kept", "near_users").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("middle")).cast("int")).alias("share"))
    most = e.filter("user_id IS NOT NULL").groupBy("event_type", "user_id").agg(F.count("*").alias("c")).groupBy("event_type").agg(F.max("c").alias("most"))
    met = F.coalesce(F.get("top", 0)["count"], F.lit(0))  # none where no user is sure to have 1/ITEMS of the rows
    joined = exact.join(most, "event_type", "left").join(top.select("event_type", met.alias("met")), "event_type")
    near = F.abs(F.col("near_users") - F.col("users")) <= sketches.ERROR * F.col("users")
    hit = (F.abs(F.col("met") - F.coalesce("most", F.lit(0))) <= F.col("n") / sketches.ITEMS) & (F.col("kept") == F.col("n"))
    return joined.select("event_type", "n", "users", near.alias("users_near"), (F.abs(F.col("share") - 0.5) <= sketches.ERROR).alias("middle_near"), hit.alias("hitters_met"))
