"""Queries that admit, deduplicate, score and rank a feed, over the ``events`` table.

user_id stands for the account, event_type for the source or topic, value for engagement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions import dates, rules, scores
from almanack.operators import admission, enrich, rank, relational, resolve
from almanack.plans import process
from almanack.plans.registry import query
from almanack.sources.tables import load

TODAY = "2024-01-20"
NOW = "2024-01-20 12:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user, type and day: the first event, the number merged, and a base score of 0 to 100."""
    rows = _events(spark, sf_dir).filter("value IS NOT NULL AND ts >= timestamp_ntz'2024-01-01'")
    kept = rows.groupBy("user_id", "event_type", "day").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("e"), F.count("*").alias("n"))
    base = scores.clamp(F.floor("e.value") + F.when(F.col("n") >= 4, 16).when(F.col("n") == 3, 12).when(F.col("n") == 2, 7).otherwise(0), 0, 100)
    return kept.select(F.col("e.event_id").alias("event_id"), "user_id", "event_type", "day", "n", base.cast("long").alias("score"))


_BASE = """
kept AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id, count(*) AS n, arg_min(value, event_id) AS value
         FROM events WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2, 3),
base AS (SELECT event_id, user_id, event_type, day, n, CAST(least(100, greatest(0, floor(value) + CASE WHEN n >= 4 THEN 16 WHEN n = 3 THEN 12 WHEN n = 2 THEN 7 ELSE 0 END)) AS BIGINT) AS score FROM kept)
"""


@query(f"""
WITH {_BASE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS r FROM base),
pen AS (SELECT *, CASE WHEN r <= 2 THEN 0 WHEN r = 3 THEN 16 WHEN r = 4 THEN 24 WHEN r = 5 THEN 32 ELSE 40 END AS p FROM ranked),
fin AS (SELECT event_id, user_id, event_type, n, CAST(CASE WHEN p = 0 THEN score WHEN score >= 35 THEN greatest(35, score - p) ELSE score - p END AS BIGINT) AS score FROM pen)
SELECT * FROM fin WHERE score >= 35 ORDER BY score DESC, event_id LIMIT 200
""")
def slice_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exact dedup, bounded score, diversity by account, floor, the top 200 (the feature: a feed's length)."""
    ranked = rank.diversify(_base(spark, sf_dir), "score", "user_id", None, "event_id", F.lit(35), [s // 10 for s in rules.SOURCE_STEPS])
    return ranked.filter("score >= 35").orderBy(F.desc("score"), "event_id").limit(200).select("event_id", "user_id", "event_type", "n", F.col("score").cast("long").alias("score"))


@query(f"""
WITH {_BASE},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS b FROM base),
p AS (SELECT *, CASE WHEN a <= 2 THEN 0 WHEN a = 3 THEN 16 WHEN a = 4 THEN 24 WHEN a = 5 THEN 32 ELSE 40 END
             + CASE WHEN b <= 2 THEN 0 WHEN b = 3 THEN 10 WHEN b = 4 THEN 16 WHEN b = 5 THEN 22 WHEN b = 6 THEN 27 WHEN b = 7 THEN 31 ELSE 34 END AS pen FROM r)
SELECT event_id, CAST(CASE WHEN pen <= 0 THEN score WHEN score >= 35 THEN greatest(35, score - pen) ELSE score - pen END AS BIGINT) AS score FROM p
""")
def diversity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties by rank within account and within topic, clamped to the floor."""
    out = rank.diversify(_base(spark, sf_dir), "score", "user_id", "event_type", "event_id", F.lit(35), [s // 10 for s in rules.SOURCE_STEPS], [s // 10 for s in rules.TOPIC_STEPS])
    return out.select("event_id", F.col("score").cast("long").alias("score"))


@query(f"""
WITH {_BASE},
top AS (SELECT * FROM base ORDER BY score DESC, event_id LIMIT 12),
v AS (SELECT score, event_id FROM top WHERE event_type <> 'error' ORDER BY score, event_id DESC LIMIT 1),
b AS (SELECT event_id FROM base WHERE event_type = 'error' AND score >= 35 ORDER BY score DESC, event_id LIMIT 1),
plan AS (SELECT (SELECT event_id FROM b) AS who, (SELECT least(1000, score + 1) FROM v) AS lift, (SELECT count(*) FROM top WHERE event_type = 'error') AS has)
SELECT event_id, event_type, CAST(CASE WHEN has = 0 AND lift IS NOT NULL AND event_id = who THEN lift ELSE score END AS BIGINT) AS score FROM base, plan
""")
def slot_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a wanted topic is lifted into the first twelve if none is there."""
    out = rank.guarantee(_base(spark, sf_dir), "score", "event_id", F.col("event_type") == "error", F.lit(False), F.lit(35), lift=1)
    return out.select("event_id", "event_type", F.col("score").cast("long").alias("score"))


@query(f"""
WITH {_BASE},
l AS (SELECT event_id, score, CASE WHEN event_type IN ('purchase', 'signup') THEN 'personal' ELSE 'adjacent' END AS lane FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, event_id) AS rn FROM l)
SELECT event_id, score, lane FROM r ORDER BY CASE WHEN rn <= CASE lane WHEN 'personal' THEN 70 ELSE 30 END THEN 0 ELSE 1 END, score DESC, event_id LIMIT 100
""")
def lane_mix_70_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows, seventy of one lane and thirty of the other, each filled up by the other (the feature: a page's length)."""
    rows = _base(spark, sf_dir).withColumn("lane", enrich.lane(F.col("event_type").isin("purchase", "signup")))
    return rank.mix(rows, "lane", "score", "event_id", 100, {"personal": 0.7, "adjacent": 0.3}).select("event_id", "score", "lane")


@query("""
WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS rn, count(*) OVER () - 5 AS rest FROM a)
SELECT user_id, n FROM r WHERE rn < 5 OR ((rn - 5 - 3 * 10) % greatest(rest, 1) + greatest(rest, 1)) % greatest(rest, 1) < 10
""")
def rotating_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fixed heads and the fourth ten of the others in turn."""
    accounts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rank.cohort(accounts, [F.desc("n"), F.asc("user_id")], slot=3, head=5, size=10)


@query("""
SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events
WHERE value IS NOT NULL AND CAST(ts AS DATE) >= DATE '2024-01-20' AND date_diff('day', DATE '2024-01-20', CAST(ts AS DATE)) <= 7
  AND event_type NOT IN ('error') AND NOT (hour(ts) >= 23) AND CAST(props->>'k' AS INT) % 7 <> 0
""")
def admit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, future, not too far ahead, blocked kinds, late hours and an attribute from JSON; all reach the scan or its filter."""
    rows = _events(spark, sf_dir).withColumn("date", F.col("day")).withColumn("evergreen", F.lit(False))
    rows = admission.future(rows, F.lit(TODAY).cast("date"))
    late = admission.past_midnight(F.date_format("ts", "HH:mm"), F.lit(None).cast("string"), F.lit(""), F.lit(""))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = rows.withColumns({"source": F.col("event_type"), "title": F.col("event_type"), "source_url": F.lit(None).cast("string"), "description": F.lit("")})
    rows = admission.far_future(admission.present(rows, ["error"]), F.lit(TODAY).cast("date"), [], 7)
    return rows.filter(F.col("value").isNotNull() & ~late & (k % 7 != 0)).select("event_id", "event_type", "day")


@query("""
SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id, count(*) AS merged, max(value) AS value,
       arg_max(props, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS props, bool_or(value > 50) AS hot
FROM events GROUP BY 1, 2, 3
""")
def exact_dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an exact key become one: least id, largest value, latest attributes, any flag."""
    rows = _events(spark, sf_dir).withColumn("key", F.struct("user_id", "event_type", "day")).withColumn("hot", F.col("value") > 50)
    out = resolve.merge(rows, "key", "ts", "event_id", {"event_id": "least", "value": "most", "props": "latest", "hot": "any"})
    return out.select("key.user_id", "key.event_type", "key.day", "event_id", "merged", "value", "props", "hot")


@query("""
SELECT u || '|' || d AS image, count(*) AS n, min(page_id) AS first_id FROM (SELECT page_id, split_part(url, '?', 1) AS u, DATE '2024-01-01' + CAST(page_id % 3 AS INT) AS d FROM pages) WHERE length(u) >= 30 GROUP BY u, d
""")
def image_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a day that share an image's url, query aside, are one; short urls have no key."""
    rows = load(spark, sf_dir, "pages").withColumn("image", resolve.image_key(F.col("url"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 3).cast("int"))))
    return rows.filter("image IS NOT NULL").groupBy("image").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


@query("""
WITH g AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY user_id, event_type) AS n,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE), event_id) AS r FROM events)
SELECT event_id, user_id, event_type, day FROM g WHERE n < 4 OR r = 1
""")
def title_spam_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four or more rows with one title and url leave the earliest."""
    rows = _events(spark, sf_dir)
    return resolve.collapse_spam(rows, "event_type", F.col("user_id").cast("string"), "day", "event_id").select("event_id", "user_id", "event_type", "day")


@query("""
SELECT event_id, CAST(CAST(ts AS DATE) + CAST(7 * i AS INT) AS DATE) AS day, i AS nth
FROM events, unnest(range(0, 3)) AS r(i)
""")
def recurrence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly event becomes its dates within three weeks."""
    rows = _events(spark, sf_dir)
    return rows.select("event_id", F.posexplode(dates.occurrences(F.col("day"), F.weekday("day"), 3)).alias("p", "day")).select("event_id", "day", F.col("p").cast("long").alias("nth"))


@query("""
SELECT event_id, hour(ts) AS hour, CASE WHEN hour(ts) < 6 THEN 'late' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 21 THEN 'evening' ELSE 'night' END AS part,
       CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1000 WHEN isodow(ts) >= 6 AND hour(ts) BETWEEN 10 AND 17 THEN 900 WHEN hour(ts) = 17 THEN 800 WHEN hour(ts) BETWEEN 6 AND 8 THEN 600 WHEN hour(ts) >= 22 THEN 400 ELSE 300 END AS fit,
       CASE WHEN value >= 50 THEN 100 WHEN value >= 15 THEN 70 WHEN value >= 5 THEN 40 WHEN value >= 1 THEN 20 ELSE 0 END AS velocity,
       CAST(greatest(0, least(1000, 300 + greatest(-200, least(320, 2 * CAST(floor(value) AS BIGINT) - 40)))) AS BIGINT) AS score
FROM events
""")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the score and its bounded sum."""
    hour, at = F.hour("ts"), F.date_format("ts", "HH:mm")
    total = scores.final(F.lit(300), F.lit(0), 2 * F.floor("value") - 40, F.lit(0), F.lit(0))
    return _events(spark, sf_dir).select("event_id", hour.cast("long").alias("hour"), dates.part_of_day(hour).alias("part"), dates.time_fit(at, F.col("day")).alias("fit"), scores.tier(F.col("value"), [(50, 100), (15, 70), (5, 40), (1, 20)]).alias("velocity"), total.cast("long").alias("score"))


@query("""
SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) >= DATE '2024-01-20' AND CAST(ts AS DATE) < DATE '2024-01-27'
""")
def range_next7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the next seven days; the bounds are on ts, so they are pushed to the scan."""
    return _events(spark, sf_dir).filter("ts >= timestamp_ntz'2024-01-20' AND ts < timestamp_ntz'2024-01-27'").select("event_id", "user_id", "day")


@query("""
SELECT p.event_id, arg_max(c.event_id, c.ts::VARCHAR || lpad(c.event_id::VARCHAR, 20, '0')) AS touch_id, max(c.ts) AS touch_ts
FROM events p LEFT JOIN events c ON p.user_id = c.user_id AND c.event_type = 'click' AND c.ts <= p.ts
WHERE p.event_type = 'purchase' GROUP BY p.event_id
""")
def asof_last_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click at or before it: an as-of join by one sort."""
    rows = load(spark, sf_dir, "events")
    buys = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = rows.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("touch_id"))
    return relational.as_of(buys, clicks, ["user_id"], "ts", "ts", ["touch_id"]).select("event_id", "touch_id", F.col("matched_ts").alias("touch_ts"))


@query("""
SELECT e.event_id, min(b.lo) AS lo, count(*) AS bands FROM events e JOIN (SELECT CAST(i * 15 AS DOUBLE) AS lo, CAST(i * 15 + 20 AS DOUBLE) AS hi FROM range(0, 8) AS r(i)) b
ON e.value >= b.lo AND e.value < b.hi GROUP BY e.event_id
""")
def range_join_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with the overlapping bands that hold them: a range join by buckets."""
    bands = spark.range(8).select((F.col("id") * 15).cast("double").alias("lo"), (F.col("id") * 15 + 20).cast("double").alias("hi"))
    joined = relational.in_range(load(spark, sf_dir, "events").select("event_id", "value"), bands, "value", "lo", "hi", 20)
    return joined.groupBy("event_id").agg(F.min("lo").alias("lo"), F.count("*").alias("bands"))


@query("""
SELECT event_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 1 ELSE 0 END AS past,
       row_number() OVER (ORDER BY CASE WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 1 ELSE 0 END,
         CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-20' THEN CAST(ts AS DATE) END NULLS FIRST, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN CAST(ts AS DATE) END DESC NULLS LAST, value DESC, event_id) AS place
FROM events ORDER BY place LIMIT 500
""")
def day_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to come ascending, then past ones descending, by value within a day: the first 500 (the feature: a page)."""
    today = F.lit(TODAY).cast("date")
    top = rank.day_groups(_events(spark, sf_dir), "day", "value", "event_id", today).limit(500).withColumn("past", (F.col("day") < today).cast("int"))
    order = Window.orderBy("past", F.when(F.col("past") == 0, F.col("day")), F.desc(F.when(F.col("past") == 1, F.col("day"))), F.desc("value"), "event_id")
    return top.select("event_id", "past", F.row_number().over(order).cast("long").alias("place"))


@query()
def whole_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole program over ``events`` as posts of the purchases and signups: admission, resolution, scores and ranks, with a run before; its parts have oracles, the tests hold the whole."""
    e = _events(spark, sf_dir).filter("event_type IN ('purchase', 'signup')")
    rows = e.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ["Jazz Concert", "Poetry Reading", "Yoga Class", "Comedy Showcase", "Salsa Dancing"])), (F.pmod("event_id", F.lit(5)) + 1).cast("int")), F.substring(F.md5(F.floor(F.col("event_id") / 3).cast("string")), 1, 8), F.substring(F.md5(F.floor(F.col("event_id") / 3).cast("string")), 9, 8)).alias("title"),
        F.lit("A long evening with friends at the hall, come along and bring somebody.").alias("description"), F.col("day").alias("date"), F.date_format("ts", "HH:mm").alias("start_time"), F.col("event_type").alias("source"), F.concat(F.lit("a"), "user_id").alias("account"),
        F.concat(F.lit("https://x.example/"), "event_id").alias("source_url"), F.concat(F.lit("https://img.example/a-long-image-name-"), "event_id", F.lit(".jpg")).alias("image_url"), F.floor("value").alias("likes"), (F.col("value") > 60).alias("user_saved"),
        F.struct(F.concat(F.lit("Hall "), F.pmod("user_id", F.lit(40))).alias("name"), F.lit("1 Main St").alias("address"), F.lit(None).cast("string").alias("neighborhood"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng")).alias("location"),
    )
    gone = spark.createDataFrame([("account", "a7"), ("hint", "yoga")], "kind string, pattern string")
    failed = spark.createDataFrame([("purchase",)], "source string")
    previous = rows.filter("source = 'purchase'").withColumns({"first_seen_at": F.lit("2024-01-02").cast("timestamp"), "comments": F.lit(0).cast("long")})
    out = process.feed(rows.filter("source = 'signup'"), process.Preferences(preferred=["music"], curated=["x.example/1"]), TODAY, NOW, previous, failed, gone)
    return out.select("event_id", "title", "date", "start_time", "score", F.array_join("contributing_sources", ",").alias("sources"))

