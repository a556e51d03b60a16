"""Queries that extract events, links and labels from pages, captions and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import text as tx
from almanack.plans.registry import query
from almanack.sources import documents, jsonld, sinks
from almanack.sources.tables import load


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
       trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS heading
FROM pages
""".replace("\\\\", "\\"))
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and first heading of each page."""
    return load(spark, sf_dir, "pages").select("page_id", documents.tag_text(F.col("html"), "title").alias("title"), documents.tag_text(F.col("html"), "h1").alias("heading"))


@query("""
SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"#]+)"', 1)) AS link FROM pages)
""".replace("\\\\", "\\"))
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of all anchors, once each."""
    return load(spark, sf_dir, "pages").select("page_id", F.explode(documents.links(F.col("html"))).alias("link"))


@query("""
SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(u, '^https?://([^/]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(u, '^https?://[^/]+(/.*)?$', 1), '/+$', '') AS url,
       regexp_replace(lower(regexp_extract(url0, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host
FROM (SELECT page_id, url AS url0, regexp_replace(trim(url), '[?#].*$', '') AS u FROM pages)
""".replace("\\\\", "\\"))
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical urls and hosts."""
    return load(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"), tx.host_of(F.col("url")).alias("host"))


@query("""SELECT event_id, CAST(props->>'k' AS VARCHAR) AS token FROM events WHERE props->>'k' IS NOT NULL""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings under a field name, anywhere in a payload (here fourteen lists and objects deep), by walking variants."""
    deep = F.concat(F.lit('{"a": [{"b": ' * 7), "props", F.lit("}]}" * 7))
    rows = load(spark, sf_dir, "events").select("event_id", F.try_parse_json(deep).alias("v"))
    return jsonld.tokens(rows, "event_id", "v", ["k"])


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, strftime(ts, '%H:%M') AS t, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS part, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events),
o AS (SELECT user_id, d, count(DISTINCT t) FILTER (t >= '06:00') AS likely, min(t) FILTER (t >= '06:00') AS one FROM s GROUP BY 1, 2)
SELECT s.user_id || '-' || s.d AS key, part, s.d AS date, CASE WHEN n < 3 AND likely = 1 THEN one ELSE t END AS start_time FROM s JOIN o ON o.user_id = s.user_id AND o.d = s.d WHERE n >= 3 OR part = 0
""")
def roundup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions (here composed of a user's day) with three or more dated sections become a row for each; others one row."""
    e = load(spark, sf_dir, "events")
    line = F.concat("event_type", F.lit(" at Blue Hall, "), F.date_format("ts", "MMMM d h:mma"))
    captions = e.groupBy(F.concat_ws("-", "user_id", F.to_date("ts")).alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("caption"))
    return documents.roundup(captions, "key", "caption", F.lit("2024-01-17").cast("date")).select("key", F.col("part").cast("long").alias("part"), "date", "start_time")


@query("""
SELECT url, kind, CAST(sum(score) AS BIGINT) AS score, max(seen) AS discovered_at, max(personal) AS personal FROM (
SELECT 'https://' || regexp_replace(lower(regexp_extract(u, '^https?://([^/]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(u, '^https?://[^/]+(/.*)?$', 1), '/+$', '') AS url,
  CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS kind, page_id % 5 AS score, DATE '2024-01-01' + CAST(page_id % 20 AS INT) AS seen, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS personal
FROM (SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS u FROM pages)) GROUP BY 1, 2
""".replace("\\\\", "\\"))
def frontier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl frontier: summed scores, latest sighting and promotion of each url and kind."""
    rows = load(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("page_id") % 5).alias("score"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 20).cast("int")).alias("discovered_at"), F.lit("pages").alias("via"), F.when(F.col("page_id") % 7 == 0, "personal").otherwise("other").alias("lane"))
    return documents.frontier(rows).drop("vias")


@query("""
SELECT page_id, list_extract(string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', ''), '.'), -2) AS label FROM pages
""".replace("\\\\", "\\"))
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrable name of each page's host."""
    return load(spark, sf_dir, "pages").select("page_id", documents.source_label(F.col("url")).alias("label"))


@query("""
SELECT page_id, len(string_split(trim(t), ' ')) AS words FROM (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '"'), '\\s+', ' ', 'g') AS t FROM pages)
""".replace("\\\\", "\\"))
def visible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words that a page shows."""
    return load(spark, sf_dir, "pages").select("page_id", F.size(F.split(documents.visible(F.col("html")), " ")).cast("long").alias("words"))


@query("""
SELECT user_id, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg(
  'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || event_id || chr(13) || chr(10) || 'DTSTART:' || strftime(date_trunc('minute', ts), '%Y%m%dT%H%M%S') || chr(13) || chr(10)
  || 'DTEND:' || strftime(date_trunc('minute', ts) + INTERVAL 2 HOUR, '%Y%m%dT%H%M%S') || chr(13) || chr(10) || 'SUMMARY:' || event_type || chr(13) || chr(10) || 'END:VEVENT', chr(13) || chr(10) ORDER BY event_id)
  || chr(13) || chr(10) || 'END:VCALENDAR' AS calendar
FROM events WHERE event_type = 'signup' GROUP BY user_id
""")
def ics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One calendar for each user's signups."""
    rows = load(spark, sf_dir, "events").filter("event_type = 'signup'")
    entry = sinks.calendar_entry(F.col("event_id").cast("string"), F.col("event_type"), F.to_date("ts"), F.date_format("ts", "HH:mm"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return sinks.calendar_bundle(rows.select("user_id", "event_id", entry.alias("entry")), "entry", ["event_id"], ["user_id"])
