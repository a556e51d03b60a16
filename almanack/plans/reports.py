"""Aggregates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions import dates
from almanack.operators import stats
from almanack.plans.registry import query
from almanack.sources import sinks
from almanack.sources.tables import load


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS hot, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27') AS users7,
  CAST(count(*) * 1000 // sum(count(*)) OVER () AS BIGINT) AS share_milli FROM events GROUP BY 1
""")
def ingestion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, conditional counts, distinct users of a week and shares by type."""
    week = F.expr("ts >= timestamp_ntz'2024-01-20' AND ts < timestamp_ntz'2024-01-27'")
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hot"), F.count_distinct(F.when(week, F.col("user_id"))).alias("users7"))
    return g.withColumn("share_milli", stats.share(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query("""
WITH a AS (SELECT user_id, count(*) AS n, max(value) AS best, bool_or(event_type = 'purchase') AS bought FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
h AS (SELECT user_id, count(*) AS before FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT coalesce(a.user_id, h.user_id) AS user_id, coalesce(n, 0) AS n, best, coalesce(bought, false) AS bought, coalesce(before, 0) AS before
FROM a FULL OUTER JOIN h ON a.user_id = h.user_id ORDER BY n DESC, before DESC, user_id LIMIT 50
""")
def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty busiest accounts, now and before (the feature: a top list)."""
    e = load(spark, sf_dir, "events")
    cut = "timestamp_ntz'2024-01-15'"
    a = e.filter(f"ts >= {cut}").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    h = e.filter(f"ts < {cut}").groupBy("user_id").agg(F.count("*").alias("before"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(h, "user_id", "full_outer").select("user_id", zero("n"), "best", F.coalesce("bought", F.lit(False)).alias("bought"), zero("before")).orderBy(F.desc("n"), F.desc("before"), "user_id").limit(50)


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def cube_source_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of two dimensions, and which of them a row sums over."""
    return load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.grouping_id().alias("level"))


@query("""
SELECT part, weekday, count(*) AS n FROM (SELECT CASE WHEN hour(ts) < 6 THEN 'late' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 21 THEN 'evening' ELSE 'night' END AS part, isodow(ts) - 1 AS weekday FROM events)
GROUP BY GROUPING SETS ((part), (weekday), ())
""")
def grouping_sets_daypart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms by part of day and by weekday, and the total, in one pass."""
    rows = load(spark, sf_dir, "events").select(dates.part_of_day(F.hour("ts")).alias("part"), F.weekday("ts").cast("long").alias("weekday"))
    return rows.groupingSets([["part"], ["weekday"], []], "part", "weekday").agg(F.count("*").alias("n")).select("part", "weekday", "n")


@query("""
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(a.n, 0) >= 5 AND coalesce(b.n, 0) = 0 AS regressed FROM a FULL OUTER JOIN b ON a.user_id = b.user_id
""")
def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that had rows and have none now."""
    e = load(spark, sf_dir, "events")
    return stats.regressions(e.filter("ts < timestamp_ntz'2024-01-16'"), e.filter("ts >= timestamp_ntz'2024-01-29'"), "user_id")


@query("""
WITH r AS (SELECT s_nationkey AS k, count(*) AS raw FROM supplier GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS survived FROM supplier WHERE s_acctbal > 8000 GROUP BY 1)
SELECT k AS s_nationkey, raw, coalesce(survived, 0) AS survived, CASE WHEN raw >= 3 AND coalesce(survived, 0) = 0 THEN 'zero' WHEN raw >= 4 AND coalesce(survived, 0) * 4 < raw THEN 'low' ELSE 'ok' END AS verdict
FROM r LEFT JOIN s USING (k)
""")
def survival_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each source survive the filters."""
    s = load(spark, sf_dir, "supplier")
    return stats.survival(s, s.filter("s_acctbal > 8000"), "s_nationkey")


@query("""
SELECT count(*) AS n, CAST(count(*) FILTER (value > 20) * 1000 // count(*) AS BIGINT) AS value_milli, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days,
  count(*) - count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) AS duplicates, CASE WHEN count(DISTINCT user_id) < 50 THEN 'warning' ELSE 'ok' END AS status FROM events
""")
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, distincts, duplicates and a status, in one row."""
    e = load(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    out = e.agg(F.count("*").alias("n"), stats.share(F.count_if(F.col("value") > 20), F.count("*")).alias("value_milli"), F.count_distinct("user_id").alias("users"), F.count_distinct("d").alias("days"), F.count_distinct("user_id", "event_type", "d").alias("keys"))
    return out.select("n", "value_milli", "users", "days", (F.col("n") - F.col("keys")).alias("duplicates"), F.when(F.col("users") < 50, "warning").otherwise("ok").alias("status"))


@query("""
WITH t AS (SELECT *, floor(value) AS series FROM events ORDER BY value DESC, event_id LIMIT 30)
SELECT CAST((SELECT count(*) FROM t WHERE event_type = 'purchase') * 1000 // (SELECT count(*) FROM t) AS BIGINT) AS personal_milli, (SELECT count(DISTINCT event_type) FROM t) AS topics,
  CAST((SELECT max(c) FROM (SELECT count(*) AS c FROM t GROUP BY user_id)) * 1000 // (SELECT count(*) FROM t) AS BIGINT) AS top_source_milli, (SELECT max(c) FROM (SELECT count(*) AS c FROM t GROUP BY series)) AS repeated_series
""")
def ranked_feed_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, topics and repeats in the top thirty (the feature: a feed's head)."""
    top = load(spark, sf_dir, "events").withColumn("series", F.floor("value")).orderBy(F.desc("value"), "event_id").limit(30)
    return stats.ranked_feed(top, F.col("event_type") == "purchase", "event_type", "user_id", "series")


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS n7, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta,
  ntile(4) OVER (PARTITION BY event_type ORDER BY n DESC, day) AS quartile FROM d
""")
def rolling_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling sums, differences and quartiles of daily counts."""
    d = load(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    return d.select("event_type", "day", "n", F.sum("n").over(w.rowsBetween(-6, 0)).alias("n7"), (F.col("n") - F.lag("n").over(w)).alias("delta"), F.ntile(4).over(Window.partitionBy("event_type").orderBy(F.desc("n"), "day")).cast("long").alias("quartile"))


@query("""
SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal sums over a filtered scan: one pass, partial aggregates."""
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    return load(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum(dec("l_quantity")).alias("qty"), F.sum(dec("l_extendedprice") * (1 - dec("l_discount"))).alias("revenue"), F.count("*").alias("n"))


@query("""
SELECT n_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_regionkey = 1 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
""")
def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: dimensions are broadcast by size, the date range reaches the scan."""
    li, o, c, n = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    o = o.filter("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'")
    dims = c.join(n.filter("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    return li.join(o.join(dims, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "n_name"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))


@query("""
SELECT '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM events GROUP BY event_type UNION ALL SELECT '| event_type | n |' UNION ALL SELECT '|---|---|'
""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table, line by line."""
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")
    return sinks.markdown_rows(g).select("line")


@query("""
SELECT user_id, CASE WHEN n = 0 THEN 'dead' WHEN f = 0 THEN 'stale' WHEN f * 4 < n THEN 'mostly_past' ELSE 'live' END AS class FROM (SELECT user_id, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS f FROM events GROUP BY 1)
""")
def url_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the share of their rows that are still to come."""
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.expr("ts >= timestamp_ntz'2024-01-25'")).alias("f"))
    return g.select("user_id", stats.url_class(F.col("n"), F.col("f")).alias("class"))
