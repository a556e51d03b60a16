"""Organisers as communities, graphs and profiles: orders' customers and lineitem's suppliers stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import scores
from almanack.operators import communities, graph, relational
from almanack.plans.registry import query
from almanack.sources import tables
from almanack.sources.tables import load

_EDGES = """edges AS (SELECT DISTINCT a, l_suppkey AS b FROM lineitem JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS a FROM lineitem GROUP BY 1) ON k = l_orderkey WHERE l_suppkey > a)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of an order, each with the least of them."""
    li = load(spark, sf_dir, "lineitem")
    least = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"))
    return li.join(least, "l_orderkey").filter("l_suppkey > a").select("a", F.col("l_suppkey").alias("b")).distinct()


@query(f"""
WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
c(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.node WHERE c.root < u.b)
SELECT node, min(root) AS root FROM c GROUP BY node
""")
def community_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of suppliers that share an order; every supplier of an order has an edge to the least of them."""
    return graph.components(_edges(spark, sf_dir))


@query(f"""
WITH {_EDGES}, u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)
SELECT DISTINCT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey <= 3 UNION ALL SELECT DISTINCT b, 1 FROM u WHERE a <= 3 AND b > 3
""")
def bfs_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the first three suppliers (the feature: seeds), where a step leads between an order's least supplier and its others."""
    e = _edges(spark, sf_dir)
    seeds = load(spark, sf_dir, "supplier").filter("s_suppkey <= 3").select(F.col("s_suppkey").alias("node"))
    return graph.reach(e.union(e.select("b", "a")).distinct(), seeds, 1)


@query(f"""
WITH {_EDGES}, u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
d1 AS (SELECT DISTINCT b AS node FROM u WHERE a <= 3 AND b > 3),
d2 AS (SELECT DISTINCT u.b AS node FROM u JOIN d1 ON u.a = d1.node WHERE u.b > 3 AND u.b NOT IN (SELECT node FROM d1))
SELECT DISTINCT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey <= 3 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2
""")
def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within two steps of the first three (the feature: seeds), where a step leads between an order's least supplier and its others."""
    e = _edges(spark, sf_dir)
    seeds = load(spark, sf_dir, "supplier").filter("s_suppkey <= 3").select(F.col("s_suppkey").alias("node"))
    return graph.reach(e.union(e.select("b", "a")).distinct(), seeds, 2)


@query("""
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
g AS (SELECT o_custkey, d, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM d),
m AS (SELECT o_custkey, count(*) AS dates, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY 1),
w AS (SELECT o_custkey, isodow(d) - 1 AS w, count(*) AS n, min(d) AS f FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM w),
t AS (SELECT o_custkey, string_agg(w, ',' ORDER BY r) AS top_weekdays FROM r WHERE r <= 2 GROUP BY 1)
SELECT o_custkey, dates, l[CAST(len(l) // 2 AS INT) + 1] AS gap, top_weekdays,
  CASE WHEN len(l) IS NULL OR len(l) = 0 THEN 'once' WHEN l[CAST(len(l) // 2 AS INT) + 1] <= 1 THEN 'daily' WHEN l[CAST(len(l) // 2 AS INT) + 1] <= 9 THEN 'weekly' WHEN l[CAST(len(l) // 2 AS INT) + 1] <= 18 THEN 'biweekly' WHEN l[CAST(len(l) // 2 AS INT) + 1] <= 45 THEN 'monthly' ELSE 'occasional' END AS cadence
FROM m JOIN t USING (o_custkey)
""")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each customer comes back, and on which days."""
    rows = load(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return communities.cadence(rows, "o_custkey", "d")


@query("""
WITH j AS (SELECT l_suppkey, p_brand, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT l_suppkey, p_brand, count(*) AS n, min(l_shipdate) AS f FROM j GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, p_brand) AS r FROM c)
SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY r) AS brands FROM r WHERE r <= 5 GROUP BY 1
""")
def community_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five brands that each supplier ships most."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return communities.top_values(rows, "l_suppkey", "p_brand", 5, "brands", "l_shipdate")


_PROFILES = """
prof AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT p_brand)) AS cats FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
p AS (SELECT s_suppkey AS k, coalesce(cats, []) AS cats, s_nationkey AS hood, CASE WHEN s_acctbal > 4000 THEN 'weekly' WHEN s_acctbal > 0 THEN 'monthly' ELSE 'once' END AS cadence FROM supplier LEFT JOIN prof ON s_suppkey = k)
"""


@query(f"""
WITH {_PROFILES},
x AS (SELECT a.k AS a, b.k AS b, CAST(coalesce(floor(len(list_intersect(a.cats, b.cats)) * 500 / nullif(len(list_distinct(list_concat(a.cats, b.cats))), 0)), 0) AS BIGINT)
   + CASE WHEN a.hood = b.hood THEN 200 ELSE 0 END + CASE WHEN a.cadence = b.cadence THEN 150 ELSE 0 END AS similarity
  FROM p a JOIN p b ON a.k <> b.k)
SELECT a, b, similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM x WHERE similarity > 0) WHERE r <= 6
""")
def community_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six suppliers most like each one, by the brands of all parts that they ship, their nation and a class of balance."""
    s = load(spark, sf_dir, "supplier")
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    cats = rows.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set("p_brand").alias("categories"))
    cadence = F.when(F.col("s_acctbal") > 4000, "weekly").when(F.col("s_acctbal") > 0, "monthly").otherwise("once")
    profiles = s.join(cats, "s_suppkey", "left").select("s_suppkey", "categories", F.array("s_nationkey").alias("hoods"), cadence.alias("cadence"))
    out = communities.most_similar(profiles, "s_suppkey")
    return out.select("a", "b", F.col("similarity").cast("long").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT t.topic, count(*) AS n FROM customer c JOIN (VALUES ('0001'), ('12'), ('99')) t(topic) ON contains(lower(c_name), t.topic) GROUP BY 1
""")
def profile_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many handles hint at each topic."""
    topics = F.array(*map(F.lit, ["0001", "12", "99"]))
    hits = F.filter(topics, lambda t: F.contains(F.lower("c_name"), t))
    return load(spark, sf_dir, "customer").select(F.explode(hits).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey, round(least(0.5, 0.05 * log2(1 + count(*))), 6) AS boost FROM orders GROUP BY 1
""")
def client_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boost that saturates with the number of signs of interest."""
    n = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.round(scores.saturating(F.col("n"), 0.05, 0.5), 6).alias("boost"))


@query("""
WITH seen AS (SELECT o_custkey AS community_id, CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT community_id, event_id, date FROM seen WHERE date_diff('day', date, DATE '1998-08-02') <= 365
""")
def observation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations once each, none over a year old."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("community_id"), F.col("o_orderkey").cast("string").alias("event_id"), F.to_date("o_orderdate").alias("date"))
    return communities.observe(rows.filter("date < date'1998-01-01'"), rows, F.lit("1998-08-02").cast("date"))


@query("""
WITH x AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
SELECT a.s_suppkey AS item, b.s_suppkey AS other, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey) AS place
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey JOIN x ON x.s_suppkey = b.s_suppkey AND x.r <= 5
QUALIFY place <= 4
""")
def more_from_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four others of the same group, best first: only a group's best five can be among them, so no group is squared."""
    s = load(spark, sf_dir, "supplier")
    best = relational.top_by(s, ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"], 5).select("s_nationkey", F.col("s_suppkey").alias("other"), "s_acctbal")
    met = s.select("s_nationkey", F.col("s_suppkey").alias("item")).join(best, "s_nationkey").filter("item <> other")
    return relational.top_by(met, ["item"], [F.desc("s_acctbal"), "other"], 4, "place").select("item", "other", F.col("place").cast("long").alias("place"))


@query("""
WITH RECURSIVE k AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, date_trunc('hour', ts)) AS x, min(event_id) OVER (PARTITION BY event_type, date_trunc('minute', ts)) AS y FROM events),
e AS (SELECT event_id AS a, x AS b FROM k UNION SELECT event_id, y FROM k), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS node, a AS met FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.met)
SELECT node, arg_min(met, (-value, met)) AS root FROM r JOIN events ON event_id = met GROUP BY node
""")
def incremental_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events linked by user and hour or type and minute, in three runs that each add the edges of ten days; the event of the largest value stands for its component."""
    e = load(spark, sf_dir, "events")
    link = lambda *by: e.join(e.groupBy(*by).agg(F.min("event_id").alias("b")), list(by)).select(F.col("event_id").alias("a"), "b", "ts")
    e = e.withColumn("hour", F.date_trunc("hour", "ts")).withColumn("minute", F.date_trunc("minute", "ts"))
    edges = link("user_id", "hour").unionByName(link("event_type", "minute")).filter("a <> b")
    run = F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), 1).when(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), 2).otherwise(3)
    edges = tables.settle(edges.select("a", "b", run.alias("run")), "links")
    rank = e.select(F.col("event_id").alias("node"), F.struct((-F.col("value")).alias("v"), "event_id").alias("rank"))
    known = spark.createDataFrame([], "node long, root long")
    for i in (1, 2, 3):
        known = tables.settle(graph.extend(known, edges.filter(F.col("run") == i), rank), "components")
    return known
