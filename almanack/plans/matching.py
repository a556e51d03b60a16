"""Entity resolution, joins and set operations over the star schema and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.operators import admission, enrich, relational, resolve, state, taste
from almanack.plans.registry import query
from almanack.sources import tables
from almanack.sources.tables import load

_TOKENS = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains(['the','and','for','with','from','this','that','live','presents','featuring','your','our','you','are','new','york','nyc','brooklyn','event','night'], w))))"


@query(f"""
WITH p AS (SELECT p_partkey, p_brand, p_size, {_TOKENS} AS t FROM part),
r AS (SELECT p_brand, p_size, t, min(p_partkey) AS k FROM p WHERE len(t) > 0 GROUP BY 1, 2, 3)
SELECT 'pair' AS kind, least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, len(list_intersect(x.t, y.t)) AS common
FROM r x JOIN r y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.k < y.k
WHERE len(list_intersect(x.t, y.t)) >= 1 AND len(list_intersect(x.t, y.t)) >= 0.3 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))
UNION ALL SELECT 'member', r.k, p.p_partkey, len(p.t) FROM p JOIN r ON p.p_brand = r.p_brand AND p.p_size = r.p_size AND p.t = r.t WHERE p.p_partkey > r.k
""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size with similar names: pairs of word sets (by their least part), and the other parts of each word set."""
    rows = resolve.tokens_of(load(spark, sf_dir, "part"), "p_name")
    found = resolve.similar_pairs(rows, "p_partkey", ["p_brand", "p_size"], "tokens", 0.3, 1)
    return found.select(F.when(F.col("similarity") == 1, "member").otherwise("pair").alias("kind"), "a", "b", F.col("common").cast("long").alias("common"))


@query(f"""
WITH p AS (SELECT p_partkey, p_brand, p_size, {_TOKENS} AS t FROM part),
r AS (SELECT p_brand, p_size, t, min(p_partkey) AS a FROM p GROUP BY 1, 2, 3)
SELECT r.a, p.p_partkey AS b, len(p.t) AS common FROM p JOIN r ON p.p_brand = r.p_brand AND p.p_size = r.p_size AND p.t = r.t WHERE p.p_partkey > r.a AND len(p.t) >= 1
""")
def equal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size whose names have equal words, each linked to the least of them; with ``fuzzy_pairs`` these are all that are similar."""
    rows = resolve.tokens_of(load(spark, sf_dir, "part"), "p_name").select("p_partkey", "p_brand", "p_size", F.array_sort("tokens").alias("t")).filter(F.size("t") > 0)
    reps = rows.groupBy("p_brand", "p_size", "t").agg(F.min("p_partkey").alias("a"))
    return rows.join(reps, ["p_brand", "p_size", "t"]).filter("p_partkey > a").select("a", F.col("p_partkey").alias("b"), F.size("t").cast("long").alias("common"))


@query()
def fuzzy_clusters_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters in each block, in order of the key; a model in plain Python is the oracle (tests)."""
    rows = resolve.tokens_of(load(spark, sf_dir, "part"), "p_name")
    return resolve.greedy_clusters(rows, "p_partkey", ["p_brand", "p_size"], "tokens", "p_partkey", 0.3, 1)


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
h AS (SELECT vec_id, label, array_to_string(list_transform(e, lambda x: CASE WHEN x > list_sum(e) / 64 THEN '1' ELSE '0' END), '') AS b FROM v)
SELECT x.vec_id AS a, y.vec_id AS b, hamming(x.b, y.b) AS distance FROM h x JOIN h y ON x.label = y.label AND x.vec_id < y.vec_id AND hamming(x.b, y.b) <= 18
""")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label whose average-hash bits differ in at most eighteen places, by bands; every pair, copies of a vector too."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", resolve.sign_hash(F.col("embedding")).alias("h"))
    return resolve.hamming_members(rows, "vec_id", ["label"], "h", 18).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
x AS (SELECT vec_id, label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM v),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
d AS (SELECT vec_id, x.label, sum(v * m) AS dot, sqrt(sum(v * v)) AS a, sqrt(sum(m * m)) AS b FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY 1, 2)
SELECT vec_id, label, round(dot / (a * b), 4) AS cosine FROM d WHERE a * b > 0
""")
def embedding_centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector to its label's mean."""
    v = load(spark, sf_dir, "embeddings")
    x = v.select("vec_id", "label", F.posexplode("embedding").alias("i", "f")).withColumn("v", F.col("f").cast("double"))
    mean = x.groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    joined = v.join(relational.small(mean), "label")
    n = lambda c: F.sqrt(taste.dot(c, c))
    return joined.select("vec_id", "label", F.round(taste.dot(F.col("embedding"), F.col("c")) / (n(F.col("embedding")) * n(F.col("c"))), 4).alias("cosine"))


@query("""
WITH cut AS (SELECT DATE '1996-01-01' AS d),
prev AS (SELECT o_custkey, count(*) AS likes, max(o_orderdate) AS seen FROM orders, cut WHERE o_orderdate < d GROUP BY 1),
cur AS (SELECT o_custkey, count(*) AS likes FROM orders GROUP BY 1)
SELECT cur.o_custkey, cur.likes, coalesce(prev.seen, TIMESTAMP '1998-01-01') AS first_seen_at, CASE WHEN prev.likes IS NOT NULL AND cur.likes > prev.likes THEN cur.likes - prev.likes END AS engagement_delta
FROM cur LEFT JOIN prev USING (o_custkey)
""")
def prev_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot against the one before: when a key was first seen, and how much it grew."""
    o = load(spark, sf_dir, "orders")
    prev = o.filter("o_orderdate < timestamp_ntz'1996-01-01'").groupBy("o_custkey").agg(F.count("*").alias("likes"), F.max("o_orderdate").alias("first_seen_at")).withColumn("comments", F.lit(0))
    cur = o.groupBy("o_custkey").agg(F.count("*").alias("likes")).withColumn("comments", F.lit(0))
    out = state.first_seen(cur.withColumn("first_seen_at", F.lit(None).cast("timestamp_ntz")), prev, "o_custkey", F.lit("1998-01-01").cast("timestamp_ntz"))
    return out.select("o_custkey", "likes", "first_seen_at", "engagement_delta")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'
UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' AND o_orderdate >= TIMESTAMP '1997-01-01'
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def carryover_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows, and old ones of the sources that failed that are still to come (a semi-join)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("source"), F.to_date("o_orderdate").alias("date"))
    failed = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source"))
    out = state.carry_over(o.filter("date >= date'1997-06-01'"), o.filter("date < date'1997-06-01'"), failed, F.lit("1997-01-01").cast("date"))
    return out.select(F.col("event_id").alias("o_orderkey"), F.col("source").alias("o_custkey"))


@query("""
SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND NOT contains(lower(s_name), '7')
""")
def excluded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers but those excluded by key (anti-join) or by a contained hint."""
    s = load(spark, sf_dir, "supplier")
    gone = load(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    hints = spark.createDataFrame([("7", 1)], "pattern string, w int")
    left = relational.contains_max(relational.anti(s, gone, ["s_nationkey"]).withColumn("t", F.lower("s_name")), "s_suppkey", "t", hints, "pattern", "w", "hit")
    return left.filter("hit = 0").select("s_suppkey", "s_name")


@query("""
WITH r(n, w) AS (VALUES ('1', 5), ('22', 30), ('333', 100))
SELECT c_custkey, coalesce(max(w), 0) AS boost FROM customer LEFT JOIN r ON contains(c_name, n) GROUP BY 1
""")
def curated_contains_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest weight of the rules that a name contains."""
    rules = spark.createDataFrame([("1", 5), ("22", 30), ("333", 100)], "n string, w long")
    return relational.contains_max(load(spark, sf_dir, "customer"), "c_custkey", "c_name", rules, "n", "w", "boost").select("c_custkey", "boost")


@query("""
WITH f AS (SELECT DISTINCT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS h FROM nation),
c AS (SELECT s_suppkey, 0 AS via, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS h FROM supplier
      UNION ALL SELECT s_suppkey, 1, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, arg_min(h, via) AS handle, min(via) AS via FROM c JOIN f USING (h) GROUP BY 1
""")
def handle_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first followed handle among a row's names, in order of priority."""
    n = load(spark, sf_dir, "nation")
    rows = load(spark, sf_dir, "supplier").join(relational.small(n), F.col("n_nationkey") == F.col("s_nationkey"))
    return enrich.provenance(rows, "s_suppkey", [(0, "s_name"), (1, "n_name")], n.select(F.col("n_name").alias("handle")))


@query("""
SELECT p_partkey, coalesce(s.name, p_name) AS p_name, p_brand FROM part LEFT JOIN (SELECT l_partkey, 'sold ' || count(*) AS name FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey
""")
def hydrate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows with the detail rows' values where there are any."""
    d = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.concat(F.lit("sold "), F.count("*")).alias("p_name"))
    return relational.hydrate(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), d, "p_partkey")


@query("""
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'appended', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' UNION SELECT o_custkey FROM orders)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, except, intersect and append-if-new, counted."""
    c, s, o, p, li = (load(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "part", "lineitem"))
    k = lambda df, col: df.select(F.col(col).alias("k"))
    old = k(o.filter("o_orderdate < timestamp_ntz'1996-01-01'"), "o_custkey").distinct()
    sets = {"union": k(c, "c_nationkey").union(k(s, "s_nationkey")).distinct(), "except": k(c, "c_custkey").subtract(k(o, "o_custkey")), "intersect": k(p, "p_partkey").intersect(k(li, "l_partkey")), "appended": tables.append_new(old, k(o, "o_custkey"), "k")}
    out = None
    for name, df in sets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 4
""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest orders of each customer."""
    return relational.top_by(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 4, "r").select("o_orderkey", "o_custkey", "o_totalprice", F.col("r").cast("long").alias("r"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND (o_orderstatus = 'O' OR o_totalprice > 100000)
""")
def conviction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facet of flags of which any suffices."""
    rows = load(spark, sf_dir, "orders").withColumn("user_saved", F.col("o_orderstatus") == "O").withColumn("user_tagged", F.col("o_totalprice") > 100000)
    return rows.filter(F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")).filter(admission.conviction(rows.columns)).select("o_orderkey")
