"""The whole feed: admit, expand, resolve, enrich, score, rank; pure, with the clock and preferences as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.functions import dates, rules, scores, text
from almanack.operators import admission, enrich, graph, rank, resolve, state
from almanack.sources import tables
from almanack.sources.schema import conform


@dataclass
class Preferences:
    """Small, hand-kept settings."""

    disabled: list[str] = field(default_factory=list)
    trusted: list[str] = field(default_factory=list)
    exempt: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    blocked_words: list[str] = field(default_factory=list)
    away: list[str] = field(default_factory=list)
    home: list[str] = field(default_factory=list)
    preferred: list[str] = field(default_factory=list)
    source_quality: dict[str, int] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=lambda: {"music": ["concert", "live music", "dj"], "comedy": ["comedy", "stand-up"], "books": ["book", "reading"], "fitness": ["yoga", "run club"], "food": ["brunch", "dinner"]})
    venues: list[tuple[str, str]] = field(default_factory=list)
    hoods: list[tuple[str, str]] = field(default_factory=list)
    distance: dict[str, int] = field(default_factory=dict)
    #: Parts of addresses that the user picked, and words of titles; both lift the score, and rows that have them need less of it.
    curated: list[str] = field(default_factory=list)
    curated_hints: list[str] = field(default_factory=list)
    curated_points: int = 100


def _curated(p: Preferences):
    return admission.curated(F.col("source_url"), F.col("title"), p.curated, p.curated_hints)


MERGE = {
    "title": "longest", "description": "longest", "date": "least", "start_time": "latest", "end_time": "latest", "location": "first", "categories": "union", "source": "first", "source_url": "first", "image_url": "first", "image_hash": "first", "price": "first",
    "organizer": "first", "organizer_url": "first", "organizer_refs": "union", "account": "first", "likes": "most", "comments": "most", "video_views": "most", "account_followers": "most", "account_verified": "any", "is_pinned": "any",
    "user_saved": "any", "user_tagged": "any", "user_affinity": "any", "user_following": "any", "account_yield": "most", "account_posts": "most", "affinity_comentions": "most", "evergreen": "any", "attendance_signal": "most",
    "recurring": "any", "series_id": "first", "contributing_sources": "union", "contributing_accounts": "union", "first_seen_at": "least", "engagement_delta": "most", "seq": "least", "event_id": "first",
}


def admit(df: DataFrame, p: Preferences, today, excluded: DataFrame | None = None) -> DataFrame:
    """Filters in their order; all but that of excluded accounts, hosts and hints are narrow."""
    df = admission.future(admission.present(df, p.disabled), today)
    df = df.withColumn("start_time", F.coalesce("start_time", dates.time_from_text(F.col("title"), F.col("description"))))
    df = admission.far_future(df, today, p.trusted)
    words = F.concat_ws(" ", "title", "description", "location.name", "location.address")
    off = admission.blocked(words, p.blocked, p.blocked_words, p.away, p.home) | admission.glued_handle(F.col("title")) | (admission.shell(df.columns) & ~_curated(p))
    late = admission.past_midnight(F.col("start_time"), F.col("end_time"), F.col("title"), F.col("description"))
    kept = df.filter(~off & ~late & ~admission.phantom(F.col("recurring"), F.col("title"), F.col("date")))
    return kept if excluded is None else admission.excluded(kept, excluded)


def expand(df: DataFrame, weeks: int = 3) -> DataFrame:
    """Recurring rows become their dates; those share a series_id, which keeps later passes from folding them up again."""
    day = dates.recurring_weekday(F.concat_ws(" ", "title", "description"))
    out = df.withColumn("__w", day).withColumn("date", F.explode(dates.occurrences(F.col("date"), F.col("__w"), weeks)))
    series = F.when(F.col("__w").isNotNull(), F.coalesce("series_id", "event_id"))
    return out.withColumns({"recurring": F.coalesce("recurring", F.lit(False)) | F.col("__w").isNotNull(), "series_id": series, "event_id": F.when(F.col("__w").isNotNull(), text.short_id(F.col("source"), F.col("title"), F.col("date").cast("string"))).otherwise(F.col("event_id"))}).drop("__w")


def across_sources(rows: DataFrame) -> DataFrame:
    """Links (a, b) of one venue and day: different sources that share two words of four letters or more.

    Rows that share the same two words, of two sources or more, are all connected, so each is linked to the least of them.
    """
    long = F.array_sort(F.filter("__t", lambda w: F.length(w) >= 4))
    first = rows.select("event_id", "source", "__v", "date", long.alias("w")).withColumn("x", F.explode("w"))
    two = first.withColumn("y", F.explode(F.filter("w", lambda w: w > F.col("x")))).drop("w")
    by = ["__v", "date", "x", "y"]
    heads = two.groupBy(*by).agg(F.min("event_id").alias("a"), F.min("source").alias("s"), F.max("source").alias("t")).filter("s <> t").drop("s", "t")
    return two.join(heads, by).select("a", F.col("event_id").alias("b")).filter("a <> b").distinct()


def across_accounts(rows: DataFrame) -> DataFrame:
    """Links (a, b) of accounts' posts at one venue and day, where more than one account posts: half of the words and three of them."""
    posts = rows.filter(F.col("account").isNotNull() & (F.length("__v") >= 3))
    several = posts.groupBy("__v", "date").agg(F.min(F.lower("account")).alias("s"), F.max(F.lower("account")).alias("t")).filter("s <> t").select("__v", "date")
    return resolve.similar_pairs(posts.join(several, ["__v", "date"], "left_semi"), "event_id", ["__v", "date"], "__t", 0.5, 3).select("a", "b")


def series(rows: DataFrame) -> DataFrame:
    """Links (a, b) of one publisher's rows on different days that ``resolve.same_series`` holds for.

    Rows of a publisher, day and word set are one node; a word set's nodes meet another set's by its first and last day,
    which connects what all pairs of different days would.
    """
    host = F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    who = F.when(F.col("account").isNotNull(), F.concat(F.lit("account:"), F.lower("account"))).when(host != "", F.concat_ws(":", F.coalesce("source", F.lit("")), host))
    rows = rows.filter("series_id IS NULL AND date IS NOT NULL").select("event_id", "date", who.alias("p"), F.array_sort("__t").alias("t")).filter(F.col("p").isNotNull() & (F.size("t") > 0))
    nodes = rows.groupBy("p", "t", "date").agg(F.min("event_id").alias("n"))
    sets = nodes.groupBy("p", "t").agg(F.min("n").alias("k"), F.min(F.struct("date", "n")).alias("lo"), F.max(F.struct("date", "n")).alias("hi"))
    near = resolve.similar_pairs(sets, "k", ["p"], "t", 0.75, 1).select("a", "b").union(resolve.similar_pairs(sets, "k", ["p"], "t", 0.0, 4).select("a", "b")).distinct()
    both = near.union(near.select("b", "a")).union(sets.select("k", "k"))
    ends = sets.select(F.col("k").alias("a"), F.explode(F.array("lo", "hi")).alias("end"))
    of = nodes.join(sets.select("p", "t", "k"), ["p", "t"]).select(F.col("k").alias("b"), "n", "date")
    met = both.join(ends, "a").join(of, "b").filter(F.col("end.date") != F.col("date")).select(F.col("end.n").alias("a"), F.col("n").alias("b")).distinct()
    linked = met.select("a").union(met.select("b")).distinct().withColumnRenamed("a", "n")
    members = rows.join(nodes.join(linked, "n", "left_semi"), ["p", "t", "date"]).select(F.col("n").alias("a"), F.col("event_id").alias("b")).filter("a <> b")
    return met.union(members)


def resolve_all(df: DataFrame, p: Preferences) -> DataFrame:
    """Exact key, image, similar titles or image hashes of one venue and day, the same across sources and accounts, and a publisher's series; these link rows, components are merged at once."""
    keyed = df.withColumns({"__k": F.when(~F.col("source").isin(p.exempt), text.exact_key(F.col("title"), F.col("date"))), "__i": resolve.image_key(F.col("image_url"), F.col("date")), "__v": text.venue_key(F.col("location.name")), "__t": text.title_tokens(F.col("title"))})
    keyed = tables.settle(keyed.select("event_id", "image_hash", "source", "source_url", "account", "date", "series_id", "__k", "__i", "__v", "__t"), "keyed")
    links = None
    for k in ("__k", "__i"):
        heads = keyed.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("event_id").alias("a"))
        one = keyed.join(heads, k).select("a", F.col("event_id").alias("b")).filter("a <> b")
        links = one if links is None else links.unionByName(one)
    free = keyed.filter(~F.col("source").isin(p.exempt))
    placed = free.filter(F.col("__v") != "")
    near = resolve.similar_pairs(placed, "event_id", ["__v", "date"], "__t").select("a", "b")
    again = tables.settle(series(free), "series")
    alike = resolve.hamming_pairs(placed, "event_id", ["__v", "date"], "image_hash", 5).select("a", "b")
    for more in (near, alike, across_sources(placed), across_accounts(keyed), again):
        links = links.unionByName(more)
    roots = graph.components(tables.settle(links, "links"))
    returns = again.select(F.explode(F.array("a", "b")).alias("event_id")).distinct().withColumn("__again", F.lit(True))
    df = df.join(returns, "event_id", "left").withColumn("recurring", F.coalesce("recurring", F.lit(False)) | F.coalesce("__again", F.lit(False))).drop("__again")
    merged = df.join(roots.withColumnRenamed("node", "event_id"), "event_id", "left").withColumn("__root", F.coalesce("root", "event_id"))
    whole = conform(resolve.merge(merged, "__root", "scraped_at", "seq", MERGE).drop("__root"))
    return resolve.collapse_spam(whole, F.col("title"), F.col("source_url"), "date", "event_id", recurring=F.col("recurring"))


def score(df: DataFrame, p: Preferences, today, now, now_minutes) -> DataFrame:
    """Categories anew, neighbourhood, parts of the score and their bounded sum."""
    words = F.concat_ws(" ", "title", "description")
    df = df.withColumn("categories", enrich.indoors(enrich.categories(words, p.categories), F.col("location.name")))
    hood = enrich.neighborhood(F.col("location.neighborhood"), F.col("location.name"), F.concat_ws(" ", "title", "location.address"), p.venues, p.hoods)
    df = df.withColumn("location", F.coalesce(F.col("location"), F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("address", "string"), ("neighborhood", "string"), ("lat", "double"), ("lng", "double")))))).withColumn("location", F.col("location").withField("neighborhood", hood))
    known = lambda table, key, otherwise: F.coalesce(F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), key), F.lit(otherwise)) if table else F.lit(otherwise)
    parts = {
        "proximity": known(p.distance, F.col("location.neighborhood"), 500), "category": scores.categories(F.col("categories"), p.preferred), "price": scores.price(F.col("price")),
        "popularity": scores.popularity(F.col("likes"), F.col("comments"), F.col("video_views"), F.col("attendance_signal")), "source": known(p.source_quality, F.col("source"), 500),
        "completeness": scores.completeness(F.col("image_url"), F.col("description"), F.col("start_time"), F.col("location.name")),
        "title": text.title_quality(F.col("title")), "description": text.description_quality(F.col("description")), "time": dates.time_fit(F.col("start_time"), F.col("date")),
    }
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    picked = F.when(_curated(p), p.curated_points).otherwise(0)
    explicit = picked + F.when(flag("user_saved"), 250).when(flag("user_tagged"), 200).when(flag("user_affinity"), 100).when(flag("user_following"), 80).otherwise(0)
    cats = F.col("categories")
    hype = scores.trending(F.col("contributing_accounts"), F.col("engagement_delta"), F.col("first_seen_at"), F.col("date"), today, now)
    stacked = (
        scores.confirmation(F.col("contributing_sources"), F.col("contributing_accounts")) + scores.velocity(F.col("engagement_delta")) + scores.comentions(F.col("affinity_comentions")) + F.coalesce(scores.account_yield(F.col("account_yield"), F.col("account_posts")), F.lit(0))
        + scores.credibility(flag("account_verified"), F.col("account_followers")) + scores.content(F.col("image_url"), F.col("description")) + scores.hot(F.col("contributing_sources"), F.col("first_seen_at"), now)
        + scores.soon(F.col("date"), F.col("start_time"), today, now_minutes) + scores.weekday_fit(F.col("date"), cats) + scores.hour_fit(F.col("date"), F.col("start_time"), cats) + F.when(hype, 50).otherwise(0)
    )
    torn = F.size(admission.fragment_rules(F.col("title"), admission.FRAGMENTS)) > 0
    return df.withColumn("score", F.when(torn | (parts["title"] < 300), 0).otherwise(scores.final(scores.base(parts), explicit, stacked, F.lit(0), F.lit(0))).cast("long"))


def rank_all(df: DataFrame, p: Preferences) -> DataFrame:
    """Diversity, the floor, and the order by day and time."""
    floor = admission.floor_of(df.columns, _curated(p))
    df = df.withColumns({"__source": rank.source_key(F.col("account"), F.coalesce("organizer_url", "organizer"), F.col("source"), F.col("location.name")), "__topic": rank.primary_topic(F.col("categories"), F.col("title"))})
    df = rank.diversify(df, "score", "__source", "__topic", "event_id", floor, rules.SOURCE_STEPS, rules.TOPIC_STEPS)
    return df.filter(F.col("score") >= floor).drop("__source", "__topic").orderBy("date", F.coalesce("start_time", F.lit("")), F.desc("score"), "event_id")


def feed(raw: DataFrame, p: Preferences, today: str, now: str, previous: DataFrame | None = None, failed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """From raw rows, of any of the schema's columns, to a ranked feed.

    ``previous``: the last run's feed; the rows of sources that ``failed`` (source) are carried over until their date
    has passed, and the others say since when an event is known and how its engagement grew.  ``excluded`` (kind,
    pattern): accounts, hosts and hints that the user doesn't want.
    """
    day, at = F.lit(today).cast("date"), F.lit(now).cast("timestamp")
    rows = conform(raw)
    if previous is not None and failed is not None:
        rows = state.carry_over(rows, conform(previous), failed, day)
    whole = resolve_all(expand(admit(rows, p, day, excluded)), p)
    if previous is not None:
        whole = state.first_seen(whole, previous, "event_id", at)
    return rank_all(score(whole, p, day, at, F.hour(at) * 60 + F.minute(at)), p)
