"""Filters by which an event is admitted; each is a predicate over columns or a semi-join, with today as an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import dates, rules, text
from almanack.operators import relational

_FLAGS = ("user_saved", "user_tagged", "user_affinity", "user_following")


def conviction(columns: list[str]) -> Column:
    """Any of the user's own signals; a missing column is false."""
    out = F.lit(False)
    for c in _FLAGS:
        if c in columns:
            out = out | F.coalesce(F.col(c), F.lit(False))
    return out


def present(df: DataFrame, disabled: list[str]) -> DataFrame:
    """Title and date are there, and the source isn't switched off by name or host."""
    off = F.col("source").isin(disabled) | text.host_of(F.coalesce("source_url", F.lit(""))).isin(disabled)
    return df.filter((F.length(F.coalesce("title", F.lit(""))) > 0) & F.col("date").isNotNull() & ~F.coalesce(off, F.lit(False)))


def future(df: DataFrame, today: Column) -> DataFrame:
    """Dates from today on; evergreen rows are moved to today."""
    keeps = F.coalesce(F.col("evergreen"), F.lit(False))
    return df.filter(keeps | (F.col("date") >= today)).withColumn("date", F.when(keeps & (F.col("date") < today), today).otherwise(F.col("date")))


def far_future(df: DataFrame, today: Column, trusted: list[str], days: int = 180, captions: str = "social") -> DataFrame:
    """Dates over ``days`` ahead stay only for trusted sources or, but for the source of captions, if the year is written in the first 600 characters."""
    written = F.regexp_like(F.concat_ws(" ", "title", F.substring(F.coalesce("description", F.lit("")), 1, 600)), F.concat(F.lit(r"\b"), F.year("date").cast("string"), F.lit(r"\b")))
    return df.filter((F.datediff("date", today) <= days) | F.col("source").isin(trusted) | ((F.col("source") != captions) & written))


def blocked(title_and_text: Column, phrases: list[str], words: list[str], other_places: list[str], home: list[str]) -> Column:
    """A blocked phrase or word, or another city without a sign of the home city."""
    low = F.lower(title_and_text)
    away = low.rlike(rules.any_of(other_places, True)) & ~low.rlike(rules.any_of(home, True))
    return low.rlike(rules.any_of(phrases)) | low.rlike(rules.any_of(words, True)[:-2] + r"\b(?!')" if words else "(?!)") | away


def glued_handle(title: Column) -> Column:
    return title.rlike("^[A-Z][a-z]{13,} ")


def shell(columns: list[str]) -> Column:
    """Too little to show: short description, no image and no venue, and nobody vouches for it."""
    return (F.length(F.trim(F.coalesce("description", F.lit("")))) < 30) & (F.length(F.coalesce("image_url", F.lit(""))) == 0) & (F.length(F.coalesce("location.name", F.lit(""))) == 0) & ~conviction(columns)


_LATE = r"(?i)\b[1-5]\s*am\b|\b(?:past|after) midnight\b|\b(?:until|till?)\s*[1-5]\s*am\b|\bnight\s?club\b|\bbottle (?:service|package)\b|\bvip (?:table|booth)\b|\bafter\s?hours?\b|\b(?:edm|techno|house) (?:rave|warehouse|club)\b|\bwarehouse (?:party|set|rave)\b"


def past_midnight(start: Column, end: Column, title: Column, description: Column) -> Column:
    """Starts at 23:00 or later, ends before it starts or from 1 to 4 (00:00 is 'not set'), or says so."""
    s, e = dates.start_minutes(start), dates.start_minutes(end)
    ends = (e != 0) & ((F.floor(e / 60) < F.floor(s / 60)) | F.floor(e / 60).between(1, 4))
    said = F.concat_ws(" ", title, F.substring(F.coalesce(description, F.lit("")), 1, 200)).rlike(_LATE)
    return F.coalesce(s >= 23 * 60, F.lit(False)) | F.coalesce(ends, F.lit(False)) | said


def phantom(recurring: Column, title: Column, day: Column) -> Column:
    """A recurring row whose title names another month and day than its date."""
    named = dates.month_day(title, day, back=366)
    return F.coalesce(recurring, F.lit(False)) & named.isNotNull() & (F.date_format(named, "MM-dd") != F.date_format(day, "MM-dd"))


def excluded(df: DataFrame, rules_table: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows but those of excluded accounts or venues (equi, over name variants), hosts or title hints (contained).

    ``rules_table``: kind (account, host, hint), pattern.
    """
    names = rules_table.filter("kind = 'account'").select(F.explode(text.handle_variants(F.col("pattern"))).alias("name")).distinct()
    tried = df.select(key, F.explode(F.array_union(text.handle_variants(F.coalesce("account", F.lit(""))), text.handle_variants(F.coalesce("location.name", F.lit(""))))).alias("name"))
    by_name = tried.join(names, "name", "left_semi").select(key)
    one = F.lit(1).alias("w")
    hosts, hints = (rules_table.filter(F.col("kind") == k).select("pattern", one) for k in ("host", "hint"))
    flagged = relational.contains_max(df.withColumn("__u", F.lower(F.coalesce("source_url", F.lit("")))).withColumn("__t", F.lower("title")), key, "__u", hosts, "pattern", "w", "__h")
    flagged = relational.contains_max(flagged, key, "__t", hints, "pattern", "w", "__i")
    return relational.anti(flagged.filter("__h = 0 AND __i = 0").select(*df.columns), by_name, [key])


def curated(url: Column, title: Column, hosts: list[str], hints: list[str]) -> Column:
    """The address has a curated host or path in it, or the title a hint; both are hand-kept lists."""
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w)) if words else F.lit(False)
    return has(url, hosts) | has(title, hints)


def floor_of(columns: list[str], curated: Column) -> Column:
    """The least score that is shown, in thousandths."""
    return F.when(conviction(columns) | curated, 250).otherwise(350)


_GIVEAWAY = r"(?i)\b(?:giveaway|enter to win|tag (?:a|two|three|\d) friends?|link in bio to shop|sold out)\b"
_EVENT_SIGNS = [r"(?i)\b(?:tonight|tomorrow|this (?:week|weekend|" + rules.DAY[1:-1] + r"))\b", r"(?i)\b\d{1,2}(?::\d{2})?\s*[ap]m\b", r"(?i)\b" + rules.MONTH + r"\.?\s+\d{1,2}\b", r"(?i)\b(?:tickets?|rsvp|doors|free entry|admission)\b", r"(?i)\b(?:join us|come (?:by|through)|hosted by|live at)\b"]


def looks_like_event(caption: Column, vouched: Column) -> Column:
    """Two signs of an event, one for vouched posts, and none of a giveaway."""
    signs = sum((caption.rlike(p).cast("int") for p in _EVENT_SIGNS), F.lit(0))
    return (signs >= F.when(vouched, 1).otherwise(2)) & ~caption.rlike(_GIVEAWAY)


def fragment_rules(title: Column, table: list[tuple[str, str, str]]) -> Column:
    """Ids of the rules (id, kind, pattern) by which a title is a torn-off piece of a caption.

    Kinds: prefix and suffix phrases, contains, regex. All rules of a kind make
    one alternation, tested first; ids are found only for titles that match.
    """
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    test = {"prefix": lambda p: low.startswith(p), "suffix": lambda p: low.endswith(p), "contains": lambda p: low.contains(p), "regex": lambda p: low.rlike(p)}
    return F.array_compact(F.array(*(F.when(test[kind](pattern), name) for name, kind, pattern in table), F.lit(None).cast("string")))


#: A compact list of our own; callers bring theirs.
FRAGMENTS = [
    ("opener_pronoun", "regex", r"^(?:we|we're|i|i'm|our|my|it's|they)\b.*[a-z]$"),
    ("opener_call", "regex", r"^(?:swipe|tap|click|order|shop|dm|follow|tag|comment|use code)\b"),
    ("opener_link", "prefix", "http"),
    ("only_date", "regex", r"^(?:" + rules.MONTH + r"|\d{1,2}[/.])\W*\d{1,2}[a-z]{0,2}\W*$"),
    ("only_time", "regex", r"^\d{1,2}(?::\d{2})?\s*[ap]m[\s!.]*$"),
    ("open_end", "regex", r"\b(?:and|or|the|a|with|of|to|for)$"),
    ("ellipsis", "suffix", "…"),
    ("opener_joint", "regex", r"^(?:and|but|or|so|because|which|while|plus)\b"),
    ("opener_with", "regex", r"^(?:with|featuring|feat|ft)\b"),
    ("opener_thanks", "regex", r"^(?:thank you|thanks|shout ?out|congrats|congratulations|happy birthday)\b"),
    ("opener_credit", "regex", r"^(?:photos?|images?|video|credit)\b\s*(?:by|:)"),
    ("opener_question", "regex", r"^(?:did you|have you|are you|do you|what's|who's|ready)\b.*\?$"),
    ("practical", "regex", r"^(?:doors|tickets?|rsvp|entry|cover|ages?|address|location|when|where)\b\s*[:@]"),
    ("only_price", "regex", r"^\$\d+(?:\.\d\d)?(?:\s*(?:-|to)\s*\$?\d+)?\W*$"),
    ("only_day", "regex", r"^" + rules.DAY + r"s?\W*$"),
    ("only_handles", "regex", r"^(?:@[a-z0-9_.]+[\s,&]*)+$"),
    ("only_tags", "regex", r"^(?:#[a-z0-9_]+\s*)+$"),
    ("only_address", "regex", r"^\d{1,5}\s+[a-z].*\b(?:st|street|ave|avenue|blvd|road|rd|place)\.?$"),
    ("no_letters", "regex", r"^[\d\W]+$"),
    ("giveaway", "contains", "giveaway"),
]


def still_upcoming(day: Column, start: Column, today: Column, now_minutes: Column, grace: int = 180) -> Column:
    """Not past, and not begun over ``grace`` minutes ago today."""
    return (day > today) | ((day == today) & (F.coalesce(dates.start_minutes(start), F.lit(24 * 60)) + grace >= now_minutes))


def feature_ready(columns: list[str]) -> Column:
    """Has what a featured row needs: start, actionable place, image and a description of 40 characters."""
    return F.col("start_time").isNotNull() & (F.length(F.coalesce("location.name", F.lit(""))) > 2) & ~F.lower(F.coalesce("location.name", F.lit(""))).isin("tba", "online", "various") & (F.length(F.coalesce("image_url", F.lit(""))) > 0) & (F.length(F.coalesce("description", F.lit(""))) >= 40)
