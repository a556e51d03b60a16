"""Queries over accounts, communities, profiles and their history: state from run to run, diagnostics, and the lists that users see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.operators import accounts, communities, graph, profile, relational, state, stats
from almanack.plans.registry import query
from almanack.sources import schema, sinks, tables
from almanack.sources.tables import load

TODAY = "2024-01-20"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


@query("""
WITH q AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'U' || user_id ELSE 'u.' || user_id || '_' END AS account, count(*) AS posts, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS share FROM events GROUP BY user_id)
SELECT event_id, coalesce(a.posts, b.posts) AS account_posts, coalesce(a.share, b.share) AS account_yield
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nobody' ELSE 'U' || user_id END AS account FROM events) e LEFT JOIN q a ON a.account = e.account LEFT JOIN q b ON regexp_replace(lower(b.account), '[^a-z0-9]', '', 'g') = regexp_replace(lower(e.account), '[^a-z0-9]', '', 'g')
""")
def account_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their account's yield: by its name, else by the folded name."""
    e = _events(spark, sf_dir)
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("U"), "user_id")).otherwise(F.concat(F.lit("u."), "user_id", F.lit("_")))
    quality = e.groupBy(name.alias("account")).agg(F.count("*").alias("account_posts"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("account_yield"))
    rows = e.select("event_id", F.when(F.col("event_id") % 5 == 0, "nobody").otherwise(F.concat(F.lit("U"), "user_id")).alias("account"))
    return accounts.with_quality(rows, quality).select("event_id", "account_posts", "account_yield")


@query("""
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT user_id, count(*) AS posts, count(*) FILTER (event_type = 'purchase') AS events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (r <= 10) AS latest FROM r GROUP BY 1
""")
def account_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and events of each account, and its ten latest (the feature: a short list)."""
    rows = _events(spark, sf_dir).withColumn("is_event", F.col("event_type") == "purchase")
    out = accounts.activity(rows, "user_id", "is_event", "event_id", 10)
    return out.select("user_id", "posts", "events", F.array_join("latest", ",").alias("latest"))


@query("""
WITH m AS (SELECT event_id, user_id AS by_account, 'a' || (event_id % 40) AS account FROM events)
SELECT account, count(DISTINCT by_account) AS n, CASE WHEN count(DISTINCT by_account) >= 5 THEN 100 WHEN count(DISTINCT by_account) >= 3 THEN 70 WHEN count(DISTINCT by_account) = 2 THEN 50 ELSE 30 END AS points FROM m GROUP BY 1
""")
def co_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many others an account is mentioned, and the points for it."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("b"), "user_id").alias("account"), F.concat(F.lit("with @A"), F.pmod("event_id", F.lit(40)), F.lit("!")).alias("caption"))
    return accounts.co_mentions(rows, "account", "caption")


@query("""
WITH y AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS found, max(event_id) % 7 = 0 AS dead FROM events GROUP BY 1),
r AS (SELECT user_id, CASE WHEN ok >= 2 THEN round(found / ok, 6) END AS yield, CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1 END AS tier FROM y WHERE NOT dead)
SELECT user_id, yield, row_number() OVER (ORDER BY tier, coalesce(yield, 0) DESC, user_id) - 1 AS place FROM r
""")
def seed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to read next: no dead addresses, the first tier first, then by events a success."""
    log = _events(spark, sf_dir)
    health = log.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("successes"), F.sum(F.floor("value")).alias("events"))
    dead = log.groupBy("user_id").agg((F.max("event_id") % 7 == 0).alias("dead")).filter("dead")
    seeds = log.select("user_id").distinct().withColumn("tier", F.when(F.col("user_id") % 10 == 0, 0).otherwise(1))
    return accounts.seed_plan(seeds, health, dead, "user_id", "tier").select("user_id", F.round("yield", 6).alias("yield"), "place")


_STREAKS = """
l AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l),
m AS (SELECT user_id, max(run) AS last, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS successes, max(ts) AS last_ts FROM r GROUP BY 1), t AS (SELECT r.user_id, count(*) AS failures FROM r JOIN m ON m.user_id = r.user_id AND r.run = m.last WHERE NOT ok GROUP BY 1)
"""


@query(f"""
WITH {_STREAKS}, h AS (SELECT m.user_id, last_ts, coalesce(failures, 0) AS failures FROM m LEFT JOIN t USING (user_id))
SELECT user_id FROM h WHERE failures >= 1 AND date_diff('day', CAST(last_ts AS DATE), DATE '2024-02-08') >= 9 ORDER BY last_ts, user_id LIMIT 5
""")
def retest_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five skipped keys that have waited longest, nine days or more (the feature: a few a run)."""
    log = load(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return state.retest(state.streaks(log, "user_id", ["ts", "event_id"], "ok", 1), "user_id", F.lit("2024-02-08").cast("date"), 9, 5).select("user_id")


@query(f"""
WITH {_STREAKS} SELECT m.user_id, successes <= 50 AND (coalesce(failures, 0) >= 12 OR date_diff('day', CAST(last_ts AS DATE), DATE '2024-02-28') >= 30) AS pruned FROM m LEFT JOIN t USING (user_id)
""")
def prunable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that never worked (here: fifty times at most), and failed often or not for thirty days."""
    log = load(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    h = state.streaks(log, "user_id", ["ts", "event_id"], "ok", 5)
    return h.select("user_id", state.prunable(F.col("failures"), F.greatest(F.col("successes") - 50, F.lit(0)), F.col("last_ts"), F.lit("2024-02-28").cast("date")).alias("pruned"))


@query("""
SELECT user_id FROM (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0) EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90
""")
def follow_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed and affine accounts, but the excluded ones."""
    e = _events(spark, sf_dir)
    return accounts.follow_set(e.filter("event_type = 'signup' AND user_id % 2 = 0"), e.filter("event_type = 'purchase' AND user_id % 3 = 0"), e.filter("event_type = 'error' AND value > 90"), "user_id")


@query("""
WITH a AS (SELECT user_id, event_type AS k, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), b AS (SELECT user_id, event_type AS k, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS most, greatest(0, coalesce(b.n, 0) + CASE WHEN coalesce(a.k, b.k) = 'view' THEN -9 ELSE 0 END) AS bumped
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.k = b.k
""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counters: the larger value of each key, and a bump that doesn't fall below zero."""
    e = _events(spark, sf_dir)
    counts = lambda where, name: e.filter(where).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name))
    both = counts("ts < timestamp_ntz'2024-01-15'", "a").join(counts("ts >= timestamp_ntz'2024-01-15'", "b"), "user_id", "full_outer")
    empty = F.create_map().cast("map<string,bigint>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    rows = both.select("user_id", F.explode(profile.merge_maps(a, b)).alias("k", "most"), profile.bump(b, F.lit("view"), F.lit(-9)).alias("bumped"))
    return rows.select("user_id", "k", "most", F.coalesce(F.try_element_at("bumped", F.col("k")), F.lit(0)).alias("bumped"))


@query("""
SELECT s.k AS event_id, coalesce(e.event_type, 'stub ' || s.k) AS title, e.value AS score FROM (SELECT DISTINCT event_id * 2 AS k FROM events WHERE event_type = 'signup') s LEFT JOIN events e ON e.event_id = s.k
""")
def saved_or_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows as they are now, else as they were when saved."""
    e = load(spark, sf_dir, "events")
    ids = e.filter("event_type = 'signup'").select((F.col("event_id") * 2).alias("event_id")).distinct()
    return profile.saved(ids, e.select("event_id", F.col("event_type").alias("title"), F.col("value").alias("score")), ids.select("event_id", F.concat(F.lit("stub "), "event_id").alias("title")))


@query("""
SELECT user_id, dim, key, greatest(0, sum(w)) AS weight FROM (SELECT user_id, w, unnest([{'dim': 'kind', 'key': k}, {'dim': 'part', 'key': p}], recursive := true) FROM (
  SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 5 ELSE -3 END AS w, CAST(event_id % 3 AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN 'even' END AS p FROM events)) WHERE key IS NOT NULL GROUP BY 1, 2, 3
""")
def use_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a user's actions by what they touched."""
    action = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "save").when(F.col("event_type") == "purchase", "attend").otherwise("hide")
    rows = _events(spark, sf_dir).select("user_id", action.alias("action"), F.pmod("event_id", F.lit(3)).alias("kind"), F.when(F.col("event_id") % 2 == 0, "even").alias("part"))
    return profile.counters(rows, ["kind", "part"])


_COMMUNITIES = """
c AS (SELECT user_id, 'Group ' || user_id AS name, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS n, bool_or(event_type = 'purchase' AND value > 60) AS art, bool_or(isodow(ts) = 6 AND hour(ts) BETWEEN 17 AND 20 AND value > 30) AS sat FROM events GROUP BY 1)
"""


@query(f"""WITH {_COMMUNITIES} SELECT user_id, row_number() OVER (ORDER BY n > 0 DESC, n DESC, name) - 1 AS place FROM c WHERE art AND sat AND n > 0 AND contains(lower(name), 'group') ORDER BY place LIMIT 48 OFFSET 10""")
def directory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the directory by facets (the feature: 48 a page)."""
    e = _events(spark, sf_dir)
    sat = (F.weekday("ts") == 5) & F.hour("ts").between(17, 20) & (F.col("value") > 30)
    c = e.groupBy("user_id").agg(F.count_if(F.expr("ts >= timestamp_ntz'2024-01-30'")).alias("event_count"), F.when(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)), F.array(F.lit("art"))).otherwise(F.array().cast("array<string>")).alias("categories"), F.when(F.bool_or(sat), F.array(F.lit("5-evening"))).otherwise(F.array().cast("array<string>")).alias("slots"))
    c = c.select("user_id", F.concat(F.lit("Group "), "user_id").alias("name"), F.lit("").alias("summary"), "categories", F.array(F.lit("x")).alias("hoods"), "slots", "event_count")
    shown = profile.directory(c, "GROUP", ["art"], [], ["5-evening"], True)
    order = [F.desc(F.col("event_count") > 0), F.desc("event_count"), F.asc("name")]
    return profile.page(shown, order, "place", 48, 10).select("user_id", "place")


@query("""
WITH u AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT CAST((SELECT count(DISTINCT user_id) FROM u WHERE event_type = 'purchase') * 1000 // (SELECT count(DISTINCT user_id) FROM events) AS BIGINT) AS coverage_milli, (SELECT count(DISTINCT event_type) FROM u WHERE event_type IN ('view', 'signup', 'nothing')) AS topics,
  CAST((SELECT count(*) FROM u WHERE event_type IN ('signup', 'purchase')) * 1000 // (SELECT count(*) FROM u) AS BIGINT) AS conviction_milli
""")
def north_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many followed accounts have events to come, how many wanted topics are met, and the share that the user vouches for."""
    e = _events(spark, sf_dir)
    rows = e.filter("ts >= timestamp_ntz'2024-01-20'").select(F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("account"), F.array("event_type").alias("categories"), F.col("event_type").isin("signup", "purchase").alias("vouched"))
    return stats.north_star(rows, e.select(F.col("user_id").alias("account")), ["view", "signup", "nothing"])


@query("""
WITH k AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT k.user_id, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS silenced FROM k LEFT JOIN l USING (user_id)
""")
def silenced_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each known account in a run, and the accounts that gave none."""
    e = _events(spark, sf_dir)
    return stats.by_account(e.filter("ts >= timestamp_ntz'2024-01-29'"), e, "user_id")


@query("""
SELECT user_id, count(*) FILTER (CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-26') AS week, count(*) FILTER (ts > TIMESTAMP '2024-01-25') AS fresh, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (event_type = 'purchase') AS attended, count(*) AS total FROM events GROUP BY 1
""")
def client_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's page counts: this week, new since the last visit, days, attended, all."""
    rows = _events(spark, sf_dir).withColumns({"date": F.col("day"), "first_seen_at": F.col("ts"), "attended": F.col("event_type") == "purchase"})
    return stats.client_counts(rows, "user_id", F.lit(TODAY).cast("date"), F.lit("2024-01-25").cast("timestamp_ntz"))


@query("""
SELECT t.topic, CAST(100 + 2 * count(*) FILTER (event_type = 'view') + 5 * count(*) FILTER (event_type = 'purchase') AS BIGINT) AS score FROM (SELECT *, 't' || (user_id % 6) AS topic FROM events WHERE event_type IN ('view', 'purchase')) t GROUP BY 1
""")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by a floor and weighted sums of what points to them."""
    e = _events(spark, sf_dir).withColumn("topic", F.concat(F.lit("t"), F.pmod("user_id", F.lit(6))))
    n = lambda kind: e.filter(F.col("event_type") == kind).groupBy("topic").agg(F.count("*").alias("n"))
    return profile.topic_scores([(n("view"), 2), (n("purchase"), 5)], 100).select("topic", F.col("score").cast("long").alias("score"))


@query("""SELECT page_id, min(page_id) OVER (PARTITION BY page_id // 9) AS root FROM pages""")
def alias_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are one through chains of aliases: each shares one with the next of its nine."""
    p = load(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 9).alias("block"))
    own, following = F.concat_ws("-", "block", "page_id"), F.concat_ws("-", "block", F.col("page_id") + 1)
    aliases = p.select("page_id", F.explode(F.array(own, following)).alias("alias"))
    return communities.identities(p, "page_id", aliases)


@query("""
WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, event_id FROM events),
v AS (SELECT user_id, event_type AS venue, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM e WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT e.user_id, any_value(venue) AS venue, count(*) FILTER (d BETWEEN DATE '2024-01-10' AND DATE '2024-01-29') AS recent, max(d) AS latest,
  CASE WHEN max(d) >= DATE '2024-01-30' THEN 'active' WHEN count(*) FILTER (d BETWEEN DATE '2024-01-10' AND DATE '2024-01-29') > 0 THEN 'quiet' ELSE 'past' END AS state
FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.r = 1 GROUP BY 1
""")
def community_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A community's usual venue, its recent events, its latest date, and whether it is active, quiet or past."""
    rows = _events(spark, sf_dir).select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("venue"), F.col("day").alias("date"), "event_id")
    return communities.states(rows, "user_id", "venue", "date", "event_id", F.lit("2024-01-30").cast("date"), 20)


@query("""
WITH h AS (SELECT 'h' || (user_id % 30) AS alias, CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS DATE) AS date FROM events), c AS (SELECT s_suppkey, unnest(['h' || s_suppkey, 'x' || s_suppkey, 'h' || (s_suppkey + 1)]) AS alias FROM supplier)
SELECT s_suppkey AS community_id, count(DISTINCT event_id) AS events, max(date) AS latest FROM c JOIN h USING (alias) GROUP BY 1
""")
def community_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities with the history kept under any of their aliases."""
    h = _events(spark, sf_dir).select(F.concat(F.lit("h"), F.pmod("user_id", F.lit(30))).alias("community_id"), F.col("event_id").cast("string").alias("event_id"), F.col("day").alias("date"))
    c = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("community_id"), F.array(F.concat(F.lit("h"), "s_suppkey"), F.concat(F.lit("x"), "s_suppkey"), F.concat(F.lit("h"), F.col("s_suppkey") + 1)).alias("aliases"))
    found = communities.with_history(c, h)
    return found.groupBy("community_id").agg(F.count_distinct("event_id").alias("events"), F.max("date").alias("latest"))


@query("""
SELECT 'l' || s_suppkey AS lead FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)
""")
def directory_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that no community stands for."""
    s = load(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("l"), "s_suppkey").alias("lead"), F.concat(F.lit("U."), "s_suppkey").alias("alias"))
    known = _events(spark, sf_dir).filter("event_type = 'purchase' AND value > 50").select(F.concat(F.lit("u"), "user_id").alias("alias"))
    return communities.leads(s, known).select("lead")


@query("""
SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') WHERE place < 12
""")
def upcoming_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twelve of each community, in order (the feature: a short list)."""
    rows = load(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'")
    return relational.top_by(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 12).select("o_custkey", "o_orderkey", (F.col("rank") - 1).cast("long").alias("place"))


@query("""
SELECT c_custkey, 'Ann' || c_custkey || ' hosts ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'weekly ' END || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' in nation ' || c_nationkey ELSE '' END || '.' AS summary, c_custkey % 4 = 0 OR c_custkey % 5 >= 2 AS qualified FROM customer
""")
def community_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence about each community, and whether it counts as one."""
    k = F.col("c_custkey")
    text = profile.summary(F.concat(F.lit("Ann"), k), F.array(F.lower("c_mktsegment")), F.when(k % 3 == 0, "once").otherwise("weekly"), F.when(k % 2 == 0, F.concat(F.lit("nation "), "c_nationkey")))
    return load(spark, sf_dir, "customer").select("c_custkey", text.alias("summary"), communities.qualified(k % 4 == 0, F.lit(False), k % 5).alias("qualified"))


@query("""
SELECT event_id FROM events WHERE user_id = 7 OR event_id % 50 = 7 OR (event_type = 'view' AND event_id % 20 = 3)
""")
def account_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an account in any of the columns that name one, with or without @ and in any case."""
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("user_id") == 7, "@Ann").alias("account"), F.when(i % 50 == 7, "ANN").alias("organizer"), F.lit("x").alias("source"), F.when((F.col("event_type") == "view") & (i % 20 == 3), F.array(F.lit("bob"), F.lit("@ann"))).otherwise(F.array(F.lit("bob"))).alias("contributing_accounts"))
    return accounts.rows_of(rows, "@ann").select("event_id")


@query("""SELECT DISTINCT CAST(ts AS DATE) AS date, 'all' AS of FROM events UNION ALL SELECT CAST(ts AS DATE), 'day' FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20'""")
def dates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that have rows, and the rows of one date."""
    e = _events(spark, sf_dir).withColumn("date", F.col("day"))
    return accounts.dates(e).withColumn("of", F.lit("all")).unionByName(accounts.on(e, F.lit(TODAY).cast("date")).select("date", F.lit("day").alias("of")))


@query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'saved' END, CASE WHEN event_id % 2 = 0 THEN 'free' END, CASE WHEN user_id % 3 = 0 THEN 'confirmed' END, CASE WHEN value >= 50 THEN 'rising' END, CASE WHEN event_id % 5 = 0 THEN 'recurring' END, CASE WHEN event_id % 11 = 0 THEN 'verified' END, CASE WHEN event_type = 'view' THEN 'opening' END], lambda x: x IS NOT NULL), ',') AS labels FROM events
""")
def highlight_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's highlights, in order."""
    i, some = F.col("event_id"), F.array(F.lit("a"))
    rows = _events(spark, sf_dir).select("event_id", (i % 7 == 0).alias("user_saved"), F.when(i % 2 == 0, "free").otherwise("$5").alias("price"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(some).alias("contributing_sources"), F.floor("value").alias("engagement_delta"), (i % 5 == 0).alias("recurring"), (i % 11 == 0).alias("account_verified"), F.when(F.col("event_type") == "view", "Opening night").otherwise("Show").alias("title"))
    return rows.select("event_id", F.array_join(profile.labels(rows), ",").alias("labels"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a:1' WHEN 1 THEN 'a:1,b:1' ELSE '' END AS refs, CASE WHEN event_id % 2 = 0 THEN 'free' ELSE 'unknown' END AS price, substr(sha256(event_type || '|Gala|' || CAST(ts AS DATE)), 1, 16) AS id, event_type AS sources FROM events
""")
def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial rows in the event schema: ids, prices, sources, and organisers once for each platform and id."""
    ref = lambda p, i, n: F.struct(F.lit(p).alias("platform"), F.lit(i).alias("external_id"), F.lit(n).alias("name"), F.lit(None).cast("string").alias("url"), F.lit("host").alias("role"), F.lit(None).cast("string").alias("handle"))
    refs = F.when(F.pmod("event_id", F.lit(3)) == 0, F.array(ref("a", "1", "Ann"), ref("a", "1", None))).when(F.pmod("event_id", F.lit(3)) == 1, F.array(ref("a", "1", "Ann"), ref("b", "1", "Bo"), ref("a", "1", "Ann Lee")))
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.lit("Gala").alias("title"), F.when(F.col("event_id") % 2 == 0, "free entry").alias("description"), F.col("day").alias("date"), F.col("event_type").alias("source"), refs.alias("organizer_refs"))
    out = schema.conform(rows)
    return out.select(F.col("seq").alias("event_id"), F.array_join(F.transform("organizer_refs", lambda r: F.concat_ws(":", r["platform"], r["external_id"])), ",").alias("refs"), "price", F.col("event_id").alias("id"), F.array_join("contributing_sources", ",").alias("sources"))


@query("""
SELECT event_id, event_type, 1 AS copy FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, event_type, 2 FROM events WHERE event_type = 'purchase'
""")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed published twice over in two copies: first a part, then all; an empty run leaves it as it is."""
    rows = load(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "event_type")
    paths = [tables.place(spark, f"published-{i}") for i in (1, 2)]
    for part in (rows.filter("event_id % 2 = 0"), rows):
        sinks.publish(part, *paths)
    try:
        sinks.publish(rows.filter("false"), *paths)
    except ValueError:
        pass  # refused, as it should be
    one, two = (sinks.published(spark, p).withColumn("copy", F.lit(i)) for i, p in zip((1, 2), paths))
    return one.unionByName(two)


@query("""
WITH e AS (SELECT DISTINCT user_id AS a, (user_id * 7 + event_id) % 100003 AS b FROM events), s AS (SELECT b AS node, CAST(350 + b % 700 AS INT) AS score FROM e GROUP BY 1)
SELECT node, score FROM s WHERE node IN (SELECT b FROM e WHERE a < 2) AND node >= 2 AND score >= 400 ORDER BY score DESC, node LIMIT 10
""")
def discovered_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown neighbours of known accounts that look like hosts, the best ten (the feature: so many a run)."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(100_003)).alias("b")).distinct()
    known = spark.range(2).select(F.col("id").alias("node"))
    found = graph.reach(e, known, 1).filter("depth = 1").withColumn("score", (350 + F.pmod("node", F.lit(700))).cast("int"))
    return accounts.worthy(found, "node", "score", 400, 10).select("node", "score")
