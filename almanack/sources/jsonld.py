"""JSON in HTML: linked-data events, nested payloads and offers, read as variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import dates, text
from almanack.sources import tables

TYPES = ["Event", "MusicEvent", "ComedyEvent", "DanceEvent", "Festival", "FoodEvent", "LiteraryEvent", "SocialEvent", "SportsEvent", "TheaterEvent", "VisualArtsEvent", "ExhibitionEvent", "EducationEvent", "ScreeningEvent", "ChildrensEvent", "BusinessEvent", "CourseInstance", "EventSeries"]
LEVELS = 16  # opened in one round


def payloads(html: Column) -> Column:
    """The bodies of all linked-data scripts."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def next_data(html: Column) -> Column:
    """The state that a page's framework embeds."""
    return F.try_parse_json(F.regexp_extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1))


def parsed(body: Column) -> Column:
    """A variant, if need be after stripping semicolons at the end; else null."""
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(F.trim(body), r";+\s*$", "")))


def _within(v: Column) -> Column:
    """The values of a list or an object; null of others."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def nodes(df: DataFrame, key: str, variant: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, node): every object within a payload, at any depth, that is ``wanted`` (default: all).

    A row opens ``LEVELS`` levels of its payload in one expression; what is deeper is a row of the next round, until there is none.
    """
    none = F.array().cast("array<variant>")
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    fits = (lambda v: is_object(v)) if wanted is None else (lambda v: is_object(v) & wanted(v))
    step = lambda acc, _: F.struct(F.flatten(F.filter(F.transform(acc["front"], _within), lambda x: x.isNotNull())).alias("front"), F.concat(acc["found"], F.filter(acc["front"], fits)).alias("found"))
    level, out = df.select(key, F.col(variant).alias("v")), None
    while True:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.struct(F.array("v").alias("front"), none.alias("found")), step)
        flagged = lambda vs, is_open: F.transform(vs, lambda v: F.struct(v.alias("v"), F.lit(is_open).alias("open")))
        both = text.let(walked, lambda w: F.concat(flagged(w["found"], False), flagged(F.filter(w["front"], lambda v: _within(v).isNotNull()), True)))
        round_ = tables.settle(level.select(key, F.explode_outer(both).alias("x")).filter("x IS NOT NULL").select(key, "x.v", "x.open"), "nodes")  # outer: else the walk is repeated in a filter on its size
        done = round_.filter("NOT open").select(key, F.col("v").alias("node"))
        out = done if out is None else out.unionByName(done)
        level = round_.filter("open").select(key, "v")
        if level.isEmpty():
            return out


def _text(path: str) -> Column:
    return F.try_variant_get("node", path, "string")


def _kinds(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))


def _is_event(v: Column) -> Column:
    return F.arrays_overlap(_kinds(v), F.array(*map(F.lit, TYPES))) & F.try_variant_get(v, "$.name", "string").isNotNull()


def offers_price(offers: Column) -> Column:
    """free, $N of the first price that isn't 0, or unknown; one offer or a list, price or lowPrice."""
    listed = F.coalesce(F.try_variant_get(offers, "$", "array<variant>"), F.array(offers))
    raw = F.transform(listed, lambda o: F.coalesce(F.try_variant_get(o, "$.price", "string"), F.try_variant_get(o, "$.lowPrice", "string")))
    known = F.filter(raw, lambda p: p.isNotNull() & (p != ""))
    free = lambda p: (p.try_cast("double") == 0) | (F.lower(p) == "free")
    paid = F.try_element_at(F.filter(known, lambda p: ~F.coalesce(free(p), F.lit(False))), F.lit(1))
    plain = F.regexp_replace(F.coalesce(paid.try_cast("double").try_cast("decimal(12,4)").cast("string"), paid), r"\.?0+$", "")
    plain = F.when(paid.rlike(r"\."), plain).otherwise(paid)
    return F.when(paid.isNotNull(), F.concat(F.lit("$"), plain)).when(F.exists(known, free), "free").otherwise("unknown")


def events(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of the event schema's core from payloads of text: lists, graphs, item lists and sub-events are walked."""
    wanted = nodes(df.withColumn("__v", parsed(F.col(payload))), key, "__v", _is_event)
    start = dates.local_date_time(_text("$.startDate"))
    return wanted.select(
        key,
        _text("$.name").alias("title"),
        _text("$.description").alias("description"),
        F.try_to_date(start["date"], "yyyy-MM-dd").alias("date"),
        start["time"].alias("start_time"),
        F.struct(
            F.coalesce(_text("$.location.name"), _text("$.location[0].name"), _text("$.location")).alias("name"),
            F.coalesce(F.concat_ws(", ", _text("$.location.address.streetAddress"), _text("$.location.address.addressLocality")), _text("$.location.address")).alias("address"),
        ).alias("location"),
        F.coalesce(_text("$.image[0].url"), _text("$.image.url"), _text("$.image[0]"), _text("$.image")).alias("image_url"),
        _text("$.url").alias("source_url"),
        offers_price(F.try_variant_get("node", "$.offers", "variant")).alias("price"),
        F.coalesce(_text("$.organizer.name"), _text("$.organizer[0].name")).alias("organizer"),
        F.coalesce(_text("$.organizer.url"), _text("$.organizer[0].url")).alias("organizer_url"),
    ).distinct()


def tokens(df: DataFrame, key: str, variant: str, names: list[str]) -> DataFrame:
    """(key, token): the strings under any of the field names, anywhere in the payload."""
    under = lambda v: F.array_compact(F.array(*(F.try_variant_get(v, f"$['{n}']", "string") for n in names)))
    found = nodes(df, key, variant, lambda v: F.size(under(v)) > 0)
    each = under(F.col("node"))
    return found.select(key, F.explode(each).alias("token")).distinct()


def organizer_urls(df: DataFrame, key: str, variant: str) -> DataFrame:
    """(key, url): the addresses of organisers and hosts named anywhere in the payload, in canonical form."""
    found = nodes(df, key, variant)
    paths = ["$.organizer.url", "$.organizer.sameAs", "$.host.url", "$.calendar.url"]
    listed = [F.transform(F.try_variant_get("node", p, "array<variant>"), lambda o: F.try_variant_get(o, "$.url", "string")) for p in ("$.organizer", "$.hosts")]
    each = F.array_compact(F.concat(F.array(*(F.try_variant_get("node", p, "string") for p in paths)), *(F.coalesce(x, F.array().cast("array<string>")) for x in listed)))
    return found.select(key, F.explode(each).alias("url")).select(key, text.canonical_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
