"""Queries that read pages, payloads, calendars, feeds and posts composed of ``events``; the oracles take the same from the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import text as tx
from almanack.operators import relational
from almanack.plans.derive import pick
from almanack.plans.registry import query
from almanack.sources import documents, jsonld, platforms, sinks
from almanack.sources.tables import load

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _page(body: Column) -> Column:
    return F.concat(F.lit('<html><head><script type="application/ld+json">'), body, F.lit(";</script></head></html>"))


@query("""
SELECT event_id, 'Evening of ' || event_type AS title, CAST(ts - INTERVAL 5 HOUR AS DATE) AS date, strftime(ts - INTERVAL 5 HOUR, '%H:%M') AS start_time, 'Hall ' || user_id AS venue,
  CASE WHEN coalesce(value, 0) = 0 THEN 'free' ELSE '$' || regexp_replace(printf('%.2f', value), '\\.?0+$', '') END AS price, 'https://org.example/' || user_id AS organizer_url, 'i' || event_id AS image_url FROM events
""".replace("\\\\", "\\"))
def linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of linked data in pages: bare, in a graph, in an item list, with types and offers as lists."""
    e = load(spark, sf_dir, "events")
    s = lambda *parts: F.struct(*parts)
    offer = s(F.format_string("%.2f", F.coalesce("value", F.lit(0.0))).alias("price"))
    core = s(F.array(F.lit("MusicEvent"), F.lit("Thing")).alias("@type"), F.concat(F.lit("Evening of "), "event_type").alias("name"), F.concat(F.date_format("ts", _ISO), F.lit("Z")).alias("startDate"), s(F.concat(F.lit("Hall "), "user_id").alias("name")).alias("location"),
             F.array(offer).alias("offers"), s(F.concat(F.lit("https://org.example/"), "user_id").alias("url")).alias("organizer"), F.array(F.concat(F.lit("i"), "event_id")).alias("image"))
    shape = F.pmod("event_id", F.lit(3))
    body = F.when(shape == 0, F.to_json(core)).when(shape == 1, F.to_json(s(F.array(core).alias("@graph")))).otherwise(F.to_json(s(F.lit("ItemList").alias("@type"), F.array(s(core.alias("item"))).alias("itemListElement"))))
    pages = e.select("event_id", F.explode_outer(jsonld.payloads(_page(body))).alias("payload"))
    return jsonld.events(pages, "event_id", "payload").select("event_id", "title", "date", "start_time", F.col("location.name").alias("venue"), "price", "organizer_url", "image_url")


@query("""
SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['https://o.example/' || user_id] WHEN 1 THEN ['https://h.example/' || user_id, 'https://g.example'] ELSE ['https://c.example/x'] END) AS url FROM events
""")
def organizer_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of organisers and hosts anywhere in payloads."""
    u = F.col("user_id").cast("string")
    a = F.concat(F.lit('{"props": {"list": [{"event": {"organizer": {"url": "https://www.O.example/'), u, F.lit('/"}}}]}}'))
    b = F.concat(F.lit('[{"deep": {"hosts": [{"url": "https://h.example/'), u, F.lit('?x=1"}, {"url": "https://g.example"}]}}]'))
    c = F.lit('{"calendar": {"url": "https://c.example/x"}, "organizer": {"url": null}}')
    shape = F.pmod("event_id", F.lit(3))
    rows = load(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.when(shape == 0, a).when(shape == 1, b).otherwise(c)).alias("v"))
    return jsonld.organizer_urls(rows, "event_id", "v")


@query("""
SELECT user_id, CAST(event_id AS VARCHAR) AS uid, event_type || ', live; now' AS title, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS start_time, 'Hall ' || user_id AS venue FROM events
""")
def calendar_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendars written for each user and read back: escapes, folded lines, local times."""
    e = load(spark, sf_dir, "events")
    entry = sinks.calendar_entry(F.col("event_id").cast("string"), F.concat("event_type", F.lit(", live; now")), F.to_date("ts"), F.date_format("ts", "HH:mm"), F.concat(F.lit("Hall "), "user_id"), F.lit(None).cast("string"))
    files = sinks.calendar_bundle(e.select("user_id", "event_id", entry.alias("entry")), "entry", ["event_id"], ["user_id"])
    folded = files.withColumn("calendar", F.regexp_replace("calendar", "live", "li\r\n ve"))
    return documents.calendar(folded, "user_id", "calendar").select("user_id", "uid", "title", "date", "start_time", "venue")


@query("""
SELECT user_id, r - 1 AS pos, event_type || ' & more' AS title, 'https://n.example/' || event_id AS link FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8
""")
def feed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest eight items of a feed (the feature: a newsletter's head); of two formats."""
    item = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("<item><title><![CDATA["), "event_type", F.lit(" & more]]></title><link>https://n.example/"), "event_id", F.lit("</link></item>"))).otherwise(F.concat(F.lit("<entry><title>"), "event_type", F.lit(' & more</title><link rel="alternate" href="https://n.example/'), "event_id", F.lit('"/></entry>')))
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("x"))), False).alias("l"))
    feeds = e.select("user_id", F.concat(F.lit("<feed>"), F.array_join(F.transform("l", lambda x: x["x"]), "\n"), F.lit("</feed>")).alias("body"))
    return documents.feed_items(feeds, "user_id", "body").select("user_id", F.col("pos").cast("long").alias("pos"), "title", "link")


@query("""
SELECT event_id, 'Gala ' || event_id || ', 2024-02-03' AS title, 'With ' || event_type AS description, 'https://i.example/' || event_id AS image_url, DATE '2024-02-03' AS date FROM events WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, 'Plain ' || event_id, 'Come tomorrow', NULL, CAST(ts AS DATE) + 1 FROM events WHERE event_id % 6 = 2
""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event by a page's meta tags, in either order of attributes, with the site's name cut off; pages without a date give none."""
    n = F.pmod("event_id", F.lit(6))
    a = F.concat(F.lit('<meta property="og:title" content="Gala '), "event_id", F.lit(', 2024-02-03 | The Site"><meta content="With '), "event_type", F.lit('" name="og:description"><meta property="og:image" content="https://i.example/'), "event_id", F.lit('">'))
    b = F.concat(F.lit("<title>Plain "), "event_id", F.lit(' - The Site</title><meta name="description" content="'), F.when(n == 2, "Come tomorrow").otherwise("Come"), F.lit('">'))
    rows = load(spark, sf_dir, "events").select(F.struct("event_id", F.to_date("ts").alias("day")).alias("key"), F.when(F.pmod("event_id", F.lit(3)) != 2, a).otherwise(b).alias("html"))
    return documents.open_graph(rows, "key", "html", F.col("key.day")).select("key.event_id", "title", "description", "image_url", "date")


@query("""
SELECT event_id, 'Night ' || event_id AS title, CASE WHEN event_id % 4 = 3 THEN CAST(ts AS DATE) ELSE CAST(ts - INTERVAL 5 HOUR AS DATE) END AS date, CASE WHEN event_id % 4 = 3 THEN strftime(ts, '%H:%M') ELSE strftime(ts - INTERVAL 5 HOUR, '%H:%M') END AS start_time,
  'Hall' AS venue, 'https://p.example/' || event_id AS source_url, (['api', 'app', 'ticket', 'store'])[CAST(event_id % 4 AS INT) + 1] AS source FROM events WHERE event_id % 11 <> 0
""")
def platform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four platforms by tables of paths; rows without a title are left out."""
    name = F.when(F.pmod("event_id", F.lit(11)) != 0, F.concat(F.lit("Night "), "event_id"))
    url, at, s = F.concat(F.lit("https://p.example/"), "event_id"), F.date_format("ts", _ISO), F.struct
    z = F.concat(at, F.lit("Z"))
    api = s(s(name.alias("name"), z.alias("start_at"), url.alias("url"), s(F.lit("Hall").alias("address")).alias("geo_address_info")).alias("event"))
    app = s(name.alias("title"), z.alias("startDate"), url.alias("url"), s(s(F.lit("Hall").alias("name")).alias("mapsInfo")).alias("locationInfo"))
    ticket = s(name.alias("name"), s(z.alias("event_start_date")).alias("dates"), url.alias("url"), F.array(s(F.lit("Hall").alias("name"))).alias("venues"))
    store = s(s(name.alias("name")).alias("info"), at.alias("from"), url.alias("url"), F.lit("Hall").alias("location_text"))
    e, out = load(spark, sf_dir, "events"), None
    for i, (source, paths, body) in enumerate((("api", platforms.API_ROW, api), ("app", platforms.APP_STATE, app), ("ticket", platforms.TICKET_STATE, ticket), ("store", platforms.STORE_ROW, store))):
        one = platforms.records(e.filter(F.pmod("event_id", F.lit(4)) == i).select("event_id", F.to_json(body).alias("p")), "event_id", "p", paths, source)
        one = one.select("event_id", "title", "date", "start_time", F.col("location.name").alias("venue"), "source_url", "source")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT e.event_id, k.kind, 'Night ' || event_id AS title, CAST(ts AS DATE) AS date, CASE WHEN hour(ts) = 0 THEN '00' ELSE lpad(CAST(hour(ts) AS VARCHAR), 2, '0') END || ':' || strftime(ts, '%M') AS start_time
FROM events e, (VALUES ('rows'), ('items'), ('articles'), ('paths'), ('paragraphs')) k(kind) WHERE event_id % 13 <> 0
""")
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of five listings: rows, list items, articles, blocks with the date in an address, paragraphs; private events are no events."""
    title = F.when(F.pmod("event_id", F.lit(13)) == 0, "Private event").otherwise(F.concat(F.lit("Night "), "event_id"))
    day, clock, iso = F.date_format("ts", "MMMM d, yyyy"), F.date_format("ts", "h:mm a"), F.date_format("ts", "yyyy-MM-dd")
    path = F.concat(F.lit("/events/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/night"))
    lit = F.lit
    bodies = {
        "rows": F.concat(lit('<div class="event-row"><div><h3><a href="/x">'), title, lit('</a></h3><span class="date">'), day, lit('</span><span class="time">'), clock, lit("</span></div></div>")),
        "items": F.concat(lit('<ul><li class="event big"><a href="/x">'), title, lit("</a><time>"), day, lit("</time><em>"), clock, lit("</em></li></ul>")),
        "articles": F.concat(lit('<article class="eventlist-event"><h1 class="eventlist-title">'), title, lit('</h1><time datetime="'), iso, lit('"></time><span class="event-time">'), clock, lit('</span><span class="address">Hall</span></article>')),
        "paths": F.concat(lit('<div itemscope><a href="'), path, lit('"><span>'), title, lit("</span></a><b>"), clock, lit("</b></div>")),
        "paragraphs": F.concat(lit("<p><b>"), title, lit("</b> "), day, lit(" at "), clock, lit("</p>")),
    }
    e, out = load(spark, sf_dir, "events"), None
    for kind, body in bodies.items():
        block, fields = platforms.CARDS[kind]
        one = documents.cards(e.select("event_id", F.concat(lit("<body>"), body, lit("</body>")).alias("html")), "event_id", "html", block, fields, F.lit("2024-01-17").cast("date"), platforms.NO_EVENT)
        one = one.select("event_id", F.lit(kind).alias("kind"), "title", "date", "start_time")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT n_nationkey, 'https://c.example/' || n_nationkey || '/' || y || '-' || m AS url FROM nation, (VALUES ('2024', '11'), ('2024', '12'), ('2025', '01')) t(y, m)
""")
def month_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar pages of this month and the next two."""
    t = load(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("https://c.example/"), "n_nationkey", F.lit("/{year}-{month}")).alias("template"))
    return documents.month_pages(t, F.lit("2024-11-20").cast("date")).select("n_nationkey", "url")


@query("""
SELECT s_suppkey, CAST(DATE '2024-01-17' + CAST((s_suppkey % 7 - 2 + 7) % 7 + 7 * i AS INT) AS DATE) AS date FROM supplier, range(0, 8) AS r(i)
""")
def standing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coming eight dates of weekly events."""
    rows = load(spark, sf_dir, "supplier").withColumn("weekday", F.pmod("s_suppkey", F.lit(7)))
    return documents.weekly(rows, F.lit("2024-01-17").cast("date"), "weekday", 8).select("s_suppkey", "date")


@query("""
SELECT p_partkey, '/p/' || p_partkey AS href, p_name AS title, '$' || printf('%.2f', p_retailprice) AS price, p_type AS kind FROM part WHERE p_partkey % 2 = 0
""")
def shop_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop's anchors 'Title - City, ST $price', of one city; and the value beside a label."""
    city = F.when(F.col("p_partkey") % 2 == 0, "New York, NY").otherwise("Austin, TX")
    a = F.concat(F.lit('<a href="/p/'), "p_partkey", F.lit('"><b>'), "p_name", F.lit("</b> - "), city, F.lit(" $"), F.format_string("%.2f", "p_retailprice"), F.lit('</a><a href="/about">About</a>'))
    rows = load(spark, sf_dir, "part").select("p_partkey", a.alias("html"), F.concat(F.lit("<dl><dt>Kind:</dt><dd>"), "p_type", F.lit("</dd></dl>")).alias("page"))
    kinds = rows.select("p_partkey", platforms.label_values(F.col("page"), "Kind").alias("kind"))
    return platforms.product_titles(rows, "p_partkey", "html", "New York").join(kinds, "p_partkey").select("p_partkey", "href", "title", "price", "kind")


@query("""
SELECT event_id, 'u' || user_id AS account, 'Jazz Night ' || event_id AS title, CAST(ts AS DATE) + CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS date, '20:00' AS start_time, 'Blue Hall' AS venue, 'https://p.example/' || event_id || '#0' AS source_url,
  CASE WHEN event_id % 2 = 0 THEN 'https://i.example/1.jpg' END AS image_url, (['saved', 'tagged', 'story', 'other'])[CAST(user_id % 4 AS INT) + 1] AS lane FROM events WHERE event_id % 3 <> 2
""")
def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of posts, one address each, sanitised to events in their lanes; giveaways and chatter go."""
    when = pick(["tonight 8pm", "tomorrow 8pm", "GIVEAWAY tonight 8pm tag 2 friends"])
    caption = F.concat(F.lit("Jazz Night "), "event_id", F.lit("\nat Blue Hall\n"), when, F.lit(", tickets at the door"))
    lane = F.get(F.array(*map(F.lit, ["saved", "tagged", "story", "other"])), F.pmod("user_id", F.lit(4)).cast("int"))
    post = F.struct(F.concat(F.lit("u"), "user_id").alias("account"), caption.alias("caption"), F.concat(F.lit("https://p.example/"), "event_id").alias("url"), lane.alias("lane"), F.date_format("ts", _ISO).alias("posted_at"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("http://i.example/0.jpg"), F.lit("https://i.example/1.jpg"))).alias("images"), F.lit(3).alias("likes"), F.lit(1).alias("comments"))
    rows = load(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array(post).alias("posts"))).alias("p"))
    out = None
    items = platforms.snapshot(rows, "event_id", "p")
    for name, flag in (("saved", F.col("user_saved")), ("tagged", F.col("user_tagged")), ("story", F.col("is_story")), ("other", ~(F.col("user_saved") | F.col("user_tagged") | F.col("is_story")))):
        got = platforms.posts(items.filter(flag), name)
        got = got.select(F.regexp_extract("source_url", r"/(\d+)#", 1).cast("long").alias("event_id"), "account", "title", "date", "start_time", F.col("location.name").alias("venue"), "source_url", "image_url", F.when(F.col("user_saved"), "saved").when(F.col("user_tagged"), "tagged").when(F.col("is_story"), "story").otherwise("other").alias("lane"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""
WITH t AS (SELECT user_id, event_type AS tag FROM events UNION ALL SELECT user_id, 'k' || (props->>'k') FROM events), n AS (SELECT user_id, tag, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS r FROM n) WHERE r <= 8
""")
def hashtag_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight tags that each user's posts have most (the feature: a rotation)."""
    caption = F.concat(F.lit("out now #"), F.upper("event_type"), F.lit(" and #k"), F.get_json_object("props", "$.k"))
    return platforms.hashtags(load(spark, sf_dir, "events").withColumn("caption", caption), "user_id", "caption")


@query("""SELECT event_id, 'v' || (event_id % 50) AS venue FROM events WHERE event_id % 50 < 20 AND user_id <> event_id % 50""")
def venue_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Others' posts that mention a venue."""
    e = load(spark, sf_dir, "events")
    posts = e.select("event_id", F.concat(F.lit("v"), "user_id").alias("account"), F.concat(F.lit("great night at @V"), F.pmod("event_id", F.lit(50)), F.lit(" with @friend")).alias("caption"))
    return platforms.venue_tagged(posts, spark.range(20).select(F.concat(F.lit("V"), "id").alias("account")), "event_id")


@query("""
SELECT user_id, event_type || CASE WHEN event_type IN ('view', 'click') THEN ' events' ELSE ' Show' END AS title, event_id AS item FROM events WHERE event_type <> 'error'
""")
def story_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the collections whose title promises events."""
    title = F.concat("event_type", F.when(F.col("event_type").isin("view", "click"), " events").when(F.col("event_type") == "error", " food").otherwise(" Show"))
    c = load(spark, sf_dir, "events").groupBy("user_id", title.alias("title")).agg(F.collect_list("event_id").alias("items")).groupBy("user_id").agg(F.collect_list(F.struct("title", "items")).alias("collections"))
    return platforms.highlights(c, "user_id", "collections")


@query("""
SELECT event_id, kind, title, date, start_time, venue FROM (SELECT event_id, event_id % 5 AS m, CAST(ts AS DATE) AS d FROM events) e, LATERAL (
  SELECT 'event' AS kind, 'Salon ' || event_id AS title, d + 1 AS date, '19:00' AS start_time, NULL AS venue WHERE m = 0
  UNION ALL SELECT 'event', 'Jazz ' || event_id, d, '20:00', 'Blue Hall' WHERE m = 1 UNION ALL SELECT 'event', 'Film ' || event_id, d + 1, NULL, 'Red Hall' WHERE m = 1
  UNION ALL SELECT 'affiliate', 'A word from us', NULL, NULL, NULL WHERE m = 2 UNION ALL SELECT 'news', 'Council votes', NULL, NULL, NULL WHERE m = 3 UNION ALL SELECT 'roundup', '12 things to do', NULL, NULL, NULL WHERE m = 4) x
""")
def newsletter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of newsletters: events by heading or by line, sponsors, news, lists."""
    n, i = F.pmod("event_id", F.lit(5)), F.col("event_id")
    body = (
        F.when(n == 0, F.concat(F.lit("<h2>Salon "), i, F.lit("</h2><p>Come tomorrow at 7pm</p>")))
        .when(n == 1, F.concat(F.lit("<h2>Picks</h2><p>Jazz "), i, F.lit(" | tonight 8pm | Blue Hall</p><ul><li>Film "), i, F.lit(" | tomorrow | <b>Red Hall</b></li></ul>")))
        .when(n == 2, F.lit("<h3>A word from us</h3><p>Use promo code JAZZ tomorrow</p>"))
        .when(n == 3, F.lit("<h2>Council votes</h2><p>It was long.</p>"))
        .otherwise(F.lit("<h1>12 things to do</h1><p>tonight and tomorrow</p>"))
    )
    rows = load(spark, sf_dir, "events").select(F.struct("event_id", F.to_date("ts").alias("day")).alias("key"), body.alias("html"))
    return documents.newsletter(rows, "key", "html", F.col("key.day")).select("key.event_id", "kind", "title", "date", "start_time", "venue")


@query("""
SELECT page_id, url FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(url || ' (see ' || url || ') or https://x.example/' || page_id || '>', 'https?://[^\\s"''<>)]+'))) AS url FROM pages)
""".replace("\\\\", "\\"))
def url_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in texts, once each."""
    text = F.concat("url", F.lit(" (see "), "url", F.lit(") or https://x.example/"), "page_id", F.lit(">"))
    return load(spark, sf_dir, "pages").select("page_id", F.explode(tx.urls(text)).alias("url"))


@query("""
SELECT user_id, 'https://s.example/events/' || event_id AS url FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type IN ('view', 'signup')) WHERE r <= 30
""")
def sitemap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of a site's map that look like events (the feature: thirty of a site)."""
    loc = F.concat(F.lit("<url><loc> https://s.example/"), F.when(F.col("event_type").isin("view", "signup"), "events").otherwise("about"), F.lit("/"), "event_id", F.lit(" </loc></url>"))
    maps = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", loc.alias("l")))), lambda x: x["l"]), "").alias("xml"))
    return maps.select("user_id", F.explode(documents.sitemap_urls(F.col("xml"))).alias("url"))


@query("""
SELECT event_id, (['squarespace', 'bookmanager', NULL])[CAST(event_id % 3 AS INT) + 1] AS platform, CASE WHEN event_id % 2 = 0 THEN '/cal/' || event_id || '?format=ical' END AS calendar FROM events
""")
def store_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page is built with, and where its calendar file is."""
    html = F.concat(pick(['<script src="https://static1.squarespace.com/x.js">', '<a href="https://api.bookmanager.com/1">', "<p>"]), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<a href="/cal/'), "event_id", F.lit('?format=ical">'))).otherwise(""))
    return load(spark, sf_dir, "events").select("event_id", documents.is_store_platform(html).alias("platform"), documents.calendar_link(html).alias("calendar"))


@query("""
SELECT user_id, arg_min(event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END * CAST(1000000000 AS BIGINT) + event_id) AS event_id FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1
""")
def lane_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key, from the first lane that has it."""
    rows = load(spark, sf_dir, "events").filter("event_type IN ('purchase', 'signup', 'view')").select("user_id", "event_id", F.col("event_type").alias("lane"), F.col("event_id").alias("seq"))
    return platforms.lane_priority(rows, "user_id", ["purchase", "signup", "view"]).select("user_id", "event_id")


@query("""
WITH o AS (SELECT *, event_type = 'error' AS f FROM events), w AS (SELECT *, f AND coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY event_id), false) AS two FROM o),
c AS (SELECT *, coalesce(max(CAST(two AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM w)
SELECT user_id, event_id FROM c WHERE stopped = 0
""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fetched before two failures in a row stop a lane."""
    return platforms.circuit(load(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@query("""
SELECT 'https://org.example/' || user_id AS url, count(*) AS events, max(CAST(floor(value) AS BIGINT)) AS best FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 60 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40
""")
def promoted_organizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisers worth a read of their own (the feature: forty a run)."""
    rows = load(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.concat(F.lit("http://www.org.example/"), "user_id", F.lit("/?ref=x")).alias("organizer_url"), F.floor("value").alias("score"))
    return platforms.promoted(rows, 60, 40)


@query("""
SELECT n.user_id AS lane, count(*) AS new FROM (SELECT DISTINCT user_id % 5 AS user_id, event_id % 700 AS k FROM events) n WHERE k NOT IN (SELECT event_id % 700 FROM events WHERE event_type = 'view') GROUP BY 1 HAVING count(*) >= 1
""")
def net_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much that is new each probe finds."""
    e = load(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(5)).alias("lane"), F.pmod("event_id", F.lit(700)).alias("k"), "event_type")
    return platforms.net_new(e, e.filter("event_type = 'view'"), "lane", "k", 1)


@query("""
SELECT c_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.first_by(rows, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")
