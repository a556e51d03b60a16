"""Events and links from HTML, calendars, feeds and captions, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import dates, text


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first such element, tags within it dropped."""
    return text.squeeze(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", " "))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, attributes in either order."""
    a = F.regexp_extract(html, rf'(?is)<meta[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)
    b = F.regexp_extract(html, rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:name|property)="{name}"', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        bare = F.regexp_replace(bare, a, b)
    return text.squeeze(bare)


def links(html: Column) -> Column:
    """Targets of all anchors."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="([^"#]+)"'), F.lit(1)))


def page_title(html: Column) -> Column:
    """Open-graph title, first heading or title, without a site's name after a bar or dash."""
    t = F.coalesce(meta(html, "og:title"), F.nullif(tag_text(html, "h1"), F.lit("")), F.nullif(tag_text(html, "title"), F.lit("")))
    return F.trim(F.regexp_replace(t, r"\s+[|–—-]\s+[^|–—-]+$", ""))


def source_label(url: Column) -> Column:
    """The registrable name of a host: the part before its suffix."""
    host = F.split(text.host_of(url), r"\.")
    n = F.size(host)
    two = F.concat_ws(".", F.try_element_at(host, n - 1), F.try_element_at(host, n)).rlike(r"^(?:co|com|org|ac)\.[a-z]{2}$")
    return F.when(n <= 1, host[0]).when(two & (n >= 3), F.try_element_at(host, n - 2)).otherwise(F.try_element_at(host, n - 1))


def first_strategy(*events: Column) -> Column:
    """The first array of events that isn't empty."""
    return F.coalesce(*(F.when(F.size(e) > 0, e) for e in events))


def calendar(df: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of the VEVENT blocks of calendar files: uid, title, date, start_time, location, url, description."""
    plain = F.regexp_replace(F.regexp_replace(F.col(body), "\r", ""), "\n[ \t]", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    b = F.col("block")

    def field(name: str) -> Column:
        raw = F.regexp_extract(b, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
        raw = F.regexp_replace(F.regexp_replace(raw, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")
        return F.nullif(F.trim(raw), F.lit(""))

    at = field("DTSTART")
    iso = F.regexp_replace(at, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)$", "$1-$2-$3T$4:$5:$6$7")
    local = dates.local_date_time(iso)
    day = F.when(at.rlike(r"^\d{8}$"), F.try_to_date(at, "yyyyMMdd")).otherwise(F.try_to_date(local["date"], "yyyy-MM-dd"))
    return df.select(key, F.explode(blocks).alias("block")).select(key, field("UID").alias("uid"), field("SUMMARY").alias("title"), day.alias("date"), F.when(at.contains("T"), local["time"]).alias("start_time"), field("LOCATION").alias("venue"), field("URL").alias("source_url"), field("DESCRIPTION").alias("description")).filter("title IS NOT NULL AND date IS NOT NULL")


def feed_items(df: DataFrame, key: str, body: str, newest: int = 8) -> DataFrame:
    """The first ``newest`` items of feeds (items or entries): title, link, published, content."""
    items = F.slice(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1)), 1, newest)
    b = F.col("item")

    def field(tag: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract(b, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        return F.nullif(F.trim(raw), F.lit(""))

    link = F.coalesce(field("link"), F.nullif(F.regexp_extract(b, r'(?is)<link\b[^>]*href="([^"]+)"', 1), F.lit("")))
    return df.select(key, F.posexplode(items).alias("pos", "item")).select(key, "pos", field("title").alias("title"), link.alias("link"), F.coalesce(field("pubDate"), field("published"), field("updated")).alias("published"), F.coalesce(field("content:encoded"), field("content"), field("description"), field("summary")).alias("content"))


def sections(html: Column) -> Column:
    """An HTML body cut before its headings."""
    return F.filter(F.split(html, r"(?i)(?=<h[1-4]\b)"), lambda s: F.length(F.trim(s)) > 0)


def sitemap_urls(xml: Column, most: int = 30) -> Column:
    """Locations in a sitemap that look like events."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.slice(F.filter(found, lambda u: u.rlike(r"(?i)/(?:events?|shows?|calendar|whats-on)/")), 1, most)


def roundup(df: DataFrame, key: str, caption: str, anchor: Column, least: int = 3) -> DataFrame:
    """Events of captions: a row for each dated section if there are ``least`` of them, else one row: key, part, title, date, start_time, venue."""
    s = F.filter(F.transform(text.split_caption(F.col(caption)), lambda x: F.struct(x.alias("t"), dates.parse_date(x, anchor).alias("d"))), lambda x: x["d"].isNotNull())
    one = F.filter(F.array(F.struct(F.col(caption).alias("t"), dates.parse_date(F.col(caption), anchor).alias("d"))), lambda x: x["d"].isNotNull())
    parts = text.once(df, *df.columns, s.alias("__s")).select(key, F.posexplode_outer(F.when(F.size("__s") >= least, F.col("__s")).otherwise(one)).alias("part", "x")).filter("x IS NOT NULL")
    t = F.col("x.t")
    return parts.select(key, "part", text.clean_title(text.first_line(t)).alias("title"), F.col("x.d").alias("date"), F.coalesce(dates.time_from_text(F.lit(""), t), dates.parse_time(t)).alias("start_time"), text.location_of(t).alias("venue"))


def month_pages(templates: DataFrame, today: Column, months: int = 3) -> DataFrame:
    """Calendar pages of this and the next months: {year} and {month} in each template are filled in."""
    at = F.explode(F.sequence(F.trunc(today, "month"), F.add_months(F.trunc(today, "month"), months - 1), F.expr("interval 1 month")))
    return templates.withColumn("__m", at).select(*templates.columns, F.replace(F.replace("template", F.lit("{year}"), F.year("__m").cast("string")), F.lit("{month}"), F.date_format("__m", "MM")).alias("url"))


def weekly(base: DataFrame, today: Column, weekday: str, weeks: int) -> DataFrame:
    """A row for each of the coming ``weeks`` dates of a standing event."""
    first = F.date_add(today, F.pmod(F.col(weekday) - F.weekday(today), F.lit(7)).cast("int"))
    return base.withColumn("date", F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.date_add(first, (i * 7).cast("int")))))


def frontier(found: DataFrame) -> DataFrame:
    """(url, kind): summed score, latest discovery, set of ways, promoted if any of them is personal."""
    u = text.canonical_url(F.col("url"))
    return found.filter(u.isNotNull()).groupBy(u.alias("url"), "kind").agg(F.sum("score").alias("score"), F.max("discovered_at").alias("discovered_at"), F.array_sort(F.collect_set("via")).alias("vias"), F.max(F.when(F.col("lane") == "personal", 1).otherwise(0)).alias("personal"))


def platform(url: Column) -> Column:
    """event, organizer or other by the path of a canonical url."""
    path = F.regexp_extract(url, r"^https://[^/]+(/.*)?$", 1)
    return F.when(path.rlike(r"^/(?:e|event|events|show|shows)/"), "event").when(path.rlike(r"^/(?:o|org|organizer|calendar|u|user)/"), "organizer").otherwise("other")


#: Hosts whose pages only list links.
LINK_LISTS = ["linktr.ee", "beacons.ai", "linkin.bio", "bio.link", "lnk.bio", "campsite.bio"]


def lists_links(url: Column) -> Column:
    return text.host_of(url).isin(LINK_LISTS)


def disabled(url: Column, hosts: list[str]) -> Column:
    """The host or one above it is switched off."""
    host = text.host_of(url)
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h))) if hosts else F.lit(False)


def open_graph(df: DataFrame, key: str, html: str, anchor: Column) -> DataFrame:
    """At most one event of a page by its meta tags: title, description, image_url, source_url, date (named in the title or the description)."""
    h = F.col(html)
    rows = text.once(df, key, page_title(h).alias("title"), F.coalesce(meta(h, "og:description"), meta(h, "twitter:description"), meta(h, "description")).alias("description"), F.coalesce(meta(h, "og:image"), meta(h, "twitter:image")).alias("image_url"), meta(h, "og:url").alias("source_url"))
    day = F.coalesce(dates.parse_date(F.col("title"), anchor), dates.parse_date(F.col("description"), anchor))
    return text.once(rows, *rows.columns, day.alias("date")).filter("title IS NOT NULL AND date IS NOT NULL")


def cards(df: DataFrame, key: str, html: str, block: str, fields: dict[str, str], anchor: Column, reject: str = "(?!)") -> DataFrame:
    """Events of repeated HTML blocks: key, pos, title, date, start_time, venue, href.

    ``block`` finds a block, ``fields`` the first group of each column in it; tags within are dropped. A date may be
    text or part of an address. Titles that ``reject`` finds are no events.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(block), F.lit(0))
    part = lambda name: text.squeeze(F.regexp_replace(F.regexp_extract("block", fields[name], 1), "<[^>]+>", " ")) if name in fields else F.lit("")
    rows = text.once(df.select(key, F.posexplode_outer(found).alias("pos", "block")).filter("block IS NOT NULL"), key, "pos", *(F.nullif(part(c), F.lit("")).alias(c) for c in ("title", "date", "time", "venue", "href")))
    day = F.coalesce(dates.parse_date(F.regexp_replace("date", r"^.*?(\d{4})/(\d{2})/(\d{2}).*$", "$1-$2-$3"), anchor), dates.parse_date(F.col("date"), anchor))
    rows = text.once(rows, key, "pos", text.clean_title(F.col("title")).alias("title"), day.alias("date"), dates.parse_time(F.coalesce("time", F.lit(""))).alias("start_time"), "venue", "href")
    return rows.filter(F.col("title").isNotNull() & F.col("date").isNotNull() & ~F.col("title").rlike(reject)).select(key, "pos", "title", "date", "start_time", "venue", "href")


def newsletter(df: DataFrame, key: str, html: str, anchor: Column) -> DataFrame:
    """Sections of a newsletter below its headings: key, pos, kind, title, date, start_time, venue.

    A heading, or a line like 'Title | date | place' below it, is an event if it has a date; sections of sponsors are
    'affiliate', those without any date 'news', and those that announce a list 'roundup'.
    """
    body = F.col("section")
    rows = df.select(key, F.posexplode(sections(F.col(html))).alias("pos", "section"))
    head = tag_text(body, "h[1-4]")
    rest = text.squeeze(F.regexp_replace(F.regexp_replace(body, r"(?is)<h[1-4]\b.*?</h[1-4]>", " "), "<[^>]+>", " "))
    lines = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)>"), F.lit(1)), lambda x: text.squeeze(F.regexp_replace(x, "<[^>]+>", " "))), lambda x: F.size(F.split(x, r"\s*\|\s*")) >= 2)
    rows = rows.select(key, "pos", head.alias("head"), rest.alias("rest"), F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))).alias("lines")).withColumn("line", F.explode("lines"))
    parts = F.split("line", r"\s*\|\s*")
    whole = F.concat_ws(" ", F.when(F.col("line") != "", F.col("line")).otherwise(F.concat_ws(" ", "head", "rest")))
    day = dates.parse_date(whole, anchor)
    sponsor = F.lower(F.concat_ws(" ", "head", "rest")).rlike(r"\b(?:sponsor(?:ed)?|promo code|affiliate|partner offer|discount)\b")
    lists = F.lower("head").rlike(r"\b(?:roundup|this week|weekend guide|\d+ things)\b") & (F.col("line") == "")
    kind = F.when(sponsor, "affiliate").when(lists, "roundup").when(day.isNull(), "news").otherwise("event")
    title = F.when(F.col("line") != "", parts[0]).otherwise(F.col("head"))
    return rows.select(key, "pos", kind.alias("kind"), text.clean_title(title).alias("title"), F.when(kind == "event", day).alias("date"), dates.time_from_text(F.lit(""), whole).alias("start_time"), F.get(parts, 2).alias("venue"))


def is_store_platform(html: Column) -> Column:
    """squarespace, bookmanager or null, by what a page loads."""
    return F.when(html.rlike(r"(?i)static1?\.squarespace\.com|squarespace-cdn"), "squarespace").when(html.rlike(r"(?i)bookmanager\.com"), "bookmanager")


def calendar_link(html: Column) -> Column:
    """The address of a page's calendar file."""
    return F.nullif(F.regexp_extract(html, r'(?i)href="([^"]+(?:\.ics|format=ical|/ical)[^"]*)"', 1), F.lit(""))

