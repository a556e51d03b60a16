"""Rows of listing platforms and social posts in the event schema, by tables of paths into their JSON.

A connector is a mapping from columns of the schema to variant paths (the first
that isn't null counts); dates and places are read the same way for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions import dates, text
from almanack.operators import admission, relational
from almanack.sources import jsonld

#: An API's listing row, an app's embedded state, a ticket shop's state, and a store platform's event row.
API_ROW = {"title": ["$.event.name", "$.name"], "start": ["$.event.start_at", "$.start_at"], "url": ["$.event.url", "$.url"], "image_url": ["$.event.cover_url", "$.cover_url"], "venue": ["$.event.geo_address_info.address", "$.geo_address_info.full_address"], "address": ["$.event.geo_address_info.full_address", "$.event.geo_address_info.city_state"], "organizer": ["$.calendar.name", "$.hosts[0].name"], "organizer_url": ["$.calendar.url", "$.hosts[0].url"], "attendance": ["$.guest_count"], "price": ["$.ticket_info.price.cents"]}
APP_STATE = {"title": ["$.title"], "start": ["$.startDate"], "url": ["$.url"], "image_url": ["$.image.url", "$.image.upload.url"], "venue": ["$.locationInfo.mapsInfo.name"], "address": ["$.locationInfo.mapsInfo.addressLines[0]"], "description": ["$.description"], "attendance": ["$.goingGuestCount", "$.interestedGuestCount"], "zone": ["$.timezone"]}
TICKET_STATE = {"title": ["$.name"], "start": ["$.dates.event_start_date", "$.date"], "url": ["$.url", "$.perm_name"], "image_url": ["$.images.square", "$.images.landscape"], "venue": ["$.venues[0].name", "$.venue"], "address": ["$.venues[0].address"], "description": ["$.about.description"]}
STORE_ROW = {"title": ["$.name", "$.info.name"], "start": ["$.from", "$.date"], "url": ["$.url"], "image_url": ["$.image"], "venue": ["$.location_text"], "description": ["$.description", "$.info.description"]}


def _first(payload: Column, paths: list[str]) -> Column:
    return F.coalesce(*(F.try_variant_get(payload, p, "string") for p in paths), F.lit(None).cast("string"))


def records(df: DataFrame, key: str, payload: str, paths: dict[str, list[str]], source: str) -> DataFrame:
    """Core columns of events from rows of JSON text; rows without a title or a start are left out."""
    v = jsonld.parsed(F.col(payload))
    get = {c: _first(v, p) for c, p in paths.items()}
    none = F.lit(None).cast("string")
    start = dates.local_date_time(get["start"])
    body = text.squeeze(F.regexp_replace(F.coalesce(get.get("description", none), F.lit("")), "<[^>]+>", " "))
    out = df.select(
        key,
        text.clean_title(get["title"]).alias("title"),
        F.try_to_date(start["date"], "yyyy-MM-dd").alias("date"),
        start["time"].alias("start_time"),
        F.struct(get.get("venue", none).alias("name"), get.get("address", none).alias("address")).alias("location"),
        get.get("url", none).alias("source_url"),
        get.get("image_url", none).alias("image_url"),
        body.alias("description"),
        get.get("organizer", none).alias("organizer"),
        get.get("organizer_url", none).alias("organizer_url"),
        get.get("attendance", none).try_cast("long").alias("attendance"),
        get.get("zone", none).alias("zone"),
        F.lit(source).alias("source"),
    )
    return out.filter("title IS NOT NULL AND date IS NOT NULL")


def in_scope(df: DataFrame, cities: list[str], zones: list[str]) -> DataFrame:
    """Rows whose place names one of the cities, or that have no address and a time zone of theirs."""
    where = F.lower(F.concat_ws(" ", "location.name", "location.address"))
    named = F.exists(F.array(*map(F.lit, cities)), lambda c: where.contains(c))
    return df.filter(named | ((F.length(F.coalesce("location.address", F.lit(""))) == 0) & F.col("zone").isin(zones)))


def posts(df: DataFrame, lane: str | None = None) -> DataFrame:
    """Captions of posts (account, caption, posted_at, url, images, likes, comments) that look like events, with lane flags; giveaways go."""
    vouched = F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0
    kept = df.filter(admission.looks_like_event(F.col("caption"), vouched))
    day, c = dates.parse_date(F.col("caption"), F.to_date("posted_at")), F.col("caption")
    return kept.select(
        "account",
        text.clean_title(text.first_line(c)).alias("title"),
        text.clean_description(c).alias("description"),
        day.alias("date"),
        F.coalesce(dates.time_from_text(F.lit(""), c), dates.parse_time(c)).alias("start_time"),
        F.struct(text.location_of(c).alias("name")).alias("location"),
        F.col("url").alias("source_url"),
        F.try_element_at(F.filter(F.col("images"), lambda i: i.startswith("https://")), F.lit(1)).alias("image_url"),
        F.slice(F.filter(F.col("images"), lambda i: i.startswith("https://")), 2, 9).alias("extra_images"),
        "likes",
        "comments",
        F.lit(lane == "saved").alias("user_saved"),
        F.lit(lane == "tagged").alias("user_tagged"),
        F.lit(lane == "story").alias("is_story"),
        F.lit("social").alias("source"),
    ).filter("title IS NOT NULL AND date IS NOT NULL")


def product_titles(df: DataFrame, key: str, html: str, city: str) -> DataFrame:
    """Anchors 'Title - City, ST $price' of a shop's listing, of one city: key, title, price, href."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    a = F.col("a")
    label = text.squeeze(F.regexp_replace(a, "<[^>]+>", " "))
    rows = df.select(key, F.explode(found).alias("a")).select(key, F.regexp_extract(a, r'(?is)href="([^"]+)"', 1).alias("href"), F.regexp_extract(label, r"^(.*?)\s+-\s+([^,$]+),\s*[A-Z]{2}\b", 1).alias("title"), F.regexp_extract(label, r"^(.*?)\s+-\s+([^,$]+),\s*[A-Z]{2}\b", 2).alias("city"), text.price_of(label).alias("price"))
    return rows.filter((F.col("title") != "") & (F.lower("city") == city.lower())).drop("city")


def label_values(html: Column, label: str) -> Column:
    """The value beside a label in definition lists, tables or bold text."""
    raw = F.regexp_extract(html, rf"(?is)>\s*{label}\s*:?\s*</(?:dt|th|b|strong|span)>\s*(?:<(?:dd|td|span)[^>]*>)?\s*([^<]+)", 1)
    return F.nullif(text.squeeze(raw), F.lit(""))


def promoted(events: DataFrame, least: int, k: int) -> DataFrame:
    """Organisers worth a read of their own: url, events, best; those with ``least`` events or any best score, top ``k``."""
    g = events.filter(F.col("organizer_url").isNotNull()).groupBy(text.canonical_url(F.col("organizer_url")).alias("url")).agg(F.count("*").alias("events"), F.max("score").alias("best"))
    return g.filter((F.col("url").isNotNull()) & (F.col("events") >= least)).orderBy(F.desc("events"), F.desc("best"), "url").limit(k)


def lane_priority(rows: DataFrame, key: str, lanes: list[str]) -> DataFrame:
    """One row for each key: that of the first lane in the list."""
    rank = F.array_position(F.array(*map(F.lit, lanes)), F.col("lane"))
    return relational.first_by(rows.withColumn("__lane", F.when(rank == 0, len(lanes) + 1).otherwise(rank)), [key], ["__lane", "lane", *(c for c in ("seq",) if c in rows.columns)]).drop("__lane")


def net_new(found: DataFrame, known: DataFrame, by: str, key: str, least: int) -> DataFrame:
    """by and how many keys of it are new, where they are ``least`` or more."""
    return found.select(by, key).distinct().join(known.select(key).distinct(), key, "left_anti").groupBy(by).agg(F.count("*").alias("new")).filter(F.col("new") >= least)


def circuit(rows: DataFrame, by: str, order: str, failed: Column, after: int = 2) -> DataFrame:
    """Rows before the first run of ``after`` failures of each key."""
    w = Window.partitionBy(by).orderBy(order)
    streak = F.lit(True)
    for i in range(after):
        streak = streak & F.coalesce(F.lag(failed, i).over(w) if i else failed, F.lit(False))
    marked = rows.withColumn("__s", streak.cast("int"))
    open_ = F.coalesce(F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__o", open_).filter("__o = 0").drop("__s", "__o")


#: Blocks of HTML listings, and where their columns are in them.
CARDS = {
    "rows": (r'(?is)<div class="event-row".*?</div>\s*</div>', {"title": r"(?is)<h3[^>]*>(.*?)</h3>", "date": r'(?is)class="date">(.*?)<', "time": r'(?is)class="time">(.*?)<', "href": r'href="([^"]+)"'}),
    "items": (r'(?is)<li class="event\b.*?</li>', {"title": r"(?is)<a[^>]*>(.*?)</a>", "date": r"(?is)<time[^>]*>(.*?)</time>", "time": r"(?is)<em>(.*?)</em>", "href": r'href="([^"]+)"'}),
    "articles": (r'(?is)<article class="eventlist.*?</article>', {"title": r'(?is)class="eventlist-title"[^>]*>(.*?)</h1>', "date": r'(?is)<time[^>]*datetime="([^"]+)"', "time": r'(?is)class="event-time"[^>]*>(.*?)<', "venue": r'(?is)class="address">(.*?)<'}),
    "paths": (r'(?is)<div itemscope.*?</div>', {"title": r"(?is)<span[^>]*>(.*?)</span>", "date": r'href="([^"]+)"', "time": r"(?is)<b>(.*?)</b>", "href": r'href="([^"]+)"'}),
    "paragraphs": (r"(?is)<p><b>.*?</p>", {"title": r"(?is)<b>(.*?)</b>", "date": r"(?is)</b>(.*?)</p>", "time": r"(?is)</b>(.*?)</p>"}),
}
#: Titles of cards that are no public events.
NO_EVENT = r"(?i)^(?:private (?:event|party)|view all|load more|buy tickets|subscribe|menu)\b"


def snapshot(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Items of a browser's snapshot {posts: [{account, caption, url, lane, posted_at, images, likes, comments}]}: each its own address by a fragment, lanes as flags."""
    schema = "posts array<struct<account:string,caption:string,url:string,lane:string,posted_at:timestamp,images:array<string>,likes:long,comments:long>>"
    rows = df.select(key, F.posexplode(F.from_json(payload, schema)["posts"]).alias("pos", "p"))
    return rows.select(key, "pos", "p.account", "p.caption", F.concat("p.url", F.lit("#"), "pos").alias("url"), "p.posted_at", "p.images", "p.likes", "p.comments", (F.col("p.lane") == "saved").alias("user_saved"), (F.col("p.lane") == "tagged").alias("user_tagged"), (F.col("p.lane") == "story").alias("is_story"))


def hashtags(df: DataFrame, by: str, caption: str, least: int = 2, k: int = 8) -> DataFrame:
    """by, tag, n: tags of a user's posts met ``least`` times or more, the ``k`` most frequent."""
    tag = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(caption), F.lit(""))), F.lit(r"#(\w+)"), F.lit(1)), lambda x: x)))
    n = df.select(by, tag.alias("tag")).groupBy(by, "tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return relational.top_by(n, [by], [F.desc("n"), "tag"], k).drop("rank")


def venue_tagged(posts: DataFrame, venues: DataFrame, key: str) -> DataFrame:
    """key, venue: others' posts that mention a venue's account. ``venues``: account."""
    named = posts.select(key, F.lower("account").alias("by"), F.explode(text.mentions(F.col("caption"))).alias("venue"))
    known = venues.select(F.lower("account").alias("venue")).distinct()
    return named.join(known, "venue").filter("by <> venue").select(key, "venue").distinct()


def highlights(df: DataFrame, key: str, collections: str, wanted: str = r"(?i)\b(?:events?|shows?|upcoming|calendar|schedule|this week)\b") -> DataFrame:
    """key, title, item: the items of collections whose title promises events; the others aren't opened."""
    kept = F.filter(collections, lambda c: c["title"].rlike(wanted))
    return df.select(key, F.explode(kept).alias("c")).select(key, "c.title", F.explode("c.items").alias("item"))

