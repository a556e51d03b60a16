"""String functions as column expressions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import rules

#: Pictographs and what joins them.
_PICTURES = r"\p{So}\x{FE0F}\x{200D}"


def _rewrite(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``select`` whose columns are computed once a row: filters on them are not moved before it, which would compute them a second time."""
    return df.select(F.explode_outer(F.array(F.struct(*columns))).alias("__x")).select("__x.*")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)


def _at(words: Column, i: Column | int) -> Column:
    """The word at a place from 1, or from the end if below 0; empty beyond both."""
    return F.coalesce(F.get(words, (F.lit(i) if isinstance(i, int) else i) + F.when(F.lit(i) < 0 if isinstance(i, int) else i < 0, F.size(words)).otherwise(-1)), F.lit(""))


def _is_day(word: Column) -> Column:
    """A weekday's name or its beginning, with or without a mark behind it."""
    return F.substring(F.lower(word), 1, 3).isin([d for d in rules.WEEKDAYS if len(d) == 3])


def _without_tail(words: Column, is_one: Callable[[Column], Column], least: int) -> Column:
    """The words without those of a kind at their end, if they are ``least`` or more."""

    def cut(w: Column) -> Column:
        other = F.array_position(F.transform(F.reverse(w), lambda x: ~is_one(x)), True).cast("int")
        return let(F.when(other > 0, other - 1).otherwise(F.size(w)), lambda n: F.slice(w, 1, F.size(w) - F.when(n >= least, n).otherwise(0)))

    return let(words, cut)


def _original(w: Column) -> Column:
    return F.when((F.lower(_at(w, 1)) == "copy") & (F.lower(_at(w, 2)) == "of") & (F.size(w) > 2), F.slice(w, 3, F.greatest(F.size(w), F.lit(1)))).otherwise(w)


def _handle(word: Column) -> Column:
    """A scan reads the @ of a venue's handle as a capital letter."""
    endings = F.array(*map(F.lit, rules.PLACE_WORDS))
    return F.when(word.rlike("^[GCOQ][a-z]{6,}$") & F.exists(endings, lambda e: F.endswith(word, e)), F.concat(F.lit("@"), F.substring(word, 2, 100))).otherwise(word)


def _undated(w: Column) -> Column:
    """Without 'on', a weekday, a month and a day at the end."""
    dated = (F.lower(_at(w, -4)) == "on") & _is_day(_at(w, -3)) & F.substring(F.lower(_at(w, -2)), 1, 3).isin(list(rules.MONTHS)) & _at(w, -1).rlike(r"^\d{1,2}\D{0,3}$")
    return F.when((F.size(w) > 4) & dated, F.slice(w, 1, F.size(w) - 4)).otherwise(w)


def _name(w: Column) -> Column:
    """What stands before a colon, if the caption goes on behind it; else all."""
    colon = F.array_position(F.transform(w, lambda x: F.endswith(x, F.lit(":"))), True).cast("int")

    def cut(at: Column) -> Column:
        head = F.regexp_replace(F.array_join(F.slice(w, 1, F.greatest(at, F.lit(0))), " "), ":$", "")
        goes_on = F.lower(_at(w, at + 1)).isin([o + "," for o in rules.NOW_WORDS]) | (F.lower(_at(w, at + 1)).isin("on", "this") & _is_day(_at(w, at + 2)))
        return F.when((at > 0) & (F.length(F.array_join(w, " ")) > 30) & (F.length(head) >= 8) & goes_on, head).otherwise(F.array_join(w, " "))

    return let(colon, cut)


def clean_title(title: Column) -> Column:
    """Display titles, word by word: entities, the mark of copied listings, pictographs, walls of tags or mentions, a date at the end, a caption after the name."""
    t = title
    for name, sign in rules.ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(sign))
    w = F.transform(let(_words(t), _original), _handle)
    w = _words(F.regexp_replace(F.array_join(w, " "), rf"^[{_PICTURES}\s]+", ""))
    for sign, least in (("#", 2), ("@", 3)):
        w = _without_tail(w, lambda x, sign=sign: F.startswith(x, F.lit(sign)), least)
    return F.regexp_replace(let(let(w, _undated), _name), r"(\p{So})\1{2,}", "$1")


def _link(word: Column) -> Column:
    return F.lower(word).rlike("^https?://")


def _mark(word: Column) -> Column:
    """A tag, a mention, a link, or a word of marks and pictographs alone."""
    return F.startswith(word, F.lit("#")) | F.startswith(word, F.lit("@")) | _link(word) | ~word.rlike(r"[\p{L}\p{N}]")


def _points_to_biography(text: Column) -> Column:
    """'in bio', with or without a word between."""
    words = F.transform(_words(text), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", ""))
    near = lambda w: F.transform(w, lambda x, i: (x == "bio") & ((F.coalesce(F.get(w, i - 1), F.lit("")) == "in") | (F.coalesce(F.get(w, i - 2), F.lit("")) == "in")))
    return F.lower(text).contains("bio") & F.exists(let(words, near), lambda x: x)


def _cut(body: Column, limit: int) -> Column:
    cut = F.substring(body, 1, limit)
    sentence, word = F.regexp_extract(cut, r"(?s)^(.*[.!?]) ", 1), F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    return F.when(F.length(body) <= limit, body).when(F.length(sentence) - 1 > 0.6 * limit, sentence).when(F.length(word) > 0.7 * limit, F.concat(word, F.lit("…"))).otherwise(F.concat(cut, F.lit("…")))


def clean_description(text: Column, limit: int = 250) -> Column:
    """Captions for display: only lines with a word of their own stay, links and calls to a biography go, tags at the end, too; cut at a sentence or word near ``limit``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    useful = F.filter(lines, lambda x: F.exists(_words(x), lambda w: ~_mark(w)) & ~((F.length(x) < 80) & _points_to_biography(x)))
    body = F.array_join(F.filter(_words(F.array_join(useful, " ")), lambda w: ~_link(w)), " ")
    sentences = F.split(F.regexp_replace(body, r"(\p{So})\1{2,}", "$1"), r"(?<=[.!?])\s+")
    plain = let(sentences, lambda all_: F.filter(all_, lambda s, i: ~(_points_to_biography(s) & ((F.length(s) < 60) | ((i == F.size(all_) - 1) & (i > 0))))))
    return let(F.array_join(_without_tail(_words(F.array_join(plain, " ")), lambda w: F.startswith(w, F.lit("#")), 1), " "), lambda body: _cut(body, limit))


def title_tokens(title: Column) -> Column:
    """Distinctive words of a title: letters and digits, over two characters, no stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    stop = F.array(*map(F.lit, rules.STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def exact_key(title: Column, date: Column) -> Column:
    """Key of pass one: the first six distinctive words in sorted order, and the date; null without any word."""
    words = F.array_sort(F.slice(title_tokens(title), 1, 6))
    return F.when(F.size(words) > 0, F.md5(F.concat(F.array_join(words, " "), F.lit(":"), F.coalesce(date.cast("string"), F.lit("")))))


def venue_key(name: Column) -> Column:
    """Venues that differ in suffixes, spelling of 'and' or a trailing address are one."""
    v = _rewrite(F.lower(F.substring_index(F.coalesce(name, F.lit("")), ",", 1)), ("&", " and "), (r"\btheatre\b", "theater"), (r"\bcentre\b", "center"), (r"\bsaint\b", "st"), (r"^the\s+", ""), (r"[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(F.trim(v), r"(?:\s+(?:nyc|ny|bk|brooklyn|new york|bar|club|hall))+$", ""))


def fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def handle_variants(c: Column, suffixes: tuple[str, ...] = ("nyc", "bk", "brooklyn", "ny")) -> Column:
    """A folded name with and without the usual suffixes."""
    base = F.regexp_replace(fold(c), "(?:" + "|".join(suffixes) + ")$", "")
    return F.array_distinct(F.filter(F.array(fold(c), base, *(F.concat(base, F.lit(s)) for s in suffixes)), lambda x: F.length(x) > 0))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of a SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text has."""
    low = F.lower(text)
    return sum((low.contains(p).cast("int") for p in phrases), F.lit(0))


def title_quality(title: Column) -> Column:
    """0 to 1000: empty, shouting, links, too short or too long titles are poor."""
    t, letters = F.trim(F.coalesce(title, F.lit(""))), F.regexp_replace(F.coalesce(title, F.lit("")), "[^A-Za-z]", "")
    words = F.size(F.split(t, r"\s+"))
    return (
        F.when(F.length(t) < 4, 0)
        .when(t.rlike(r"(?i)https?://|www\."), 100)
        .when(F.length(letters) * 2 < F.length(t), 250)
        .when((F.length(letters) > 12) & (F.upper(letters) == letters), 500)
        .when((words < 2) | (F.length(t) > 120), 600)
        .when((words >= 3) & (words <= 12), 1000)
        .otherwise(800)
    )


def description_quality(text: Column) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < 20, 200).when(n < 60, 500).when(n <= 600, 1000).otherwise(800)


def garbled(text: Column) -> Column:
    """Words without a vowel or with odd characters are over a third of six or more."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.length(w) > 1)
    odd = F.filter(words, lambda w: ~F.lower(w).rlike("[aeiouy0-9]") | w.rlike(r"[|\\~^{}<>]"))
    return (F.size(words) >= 6) & (F.size(odd) * 3 > F.size(words))


def price_of(text: Column) -> Column:
    """free, $N or unknown; 'free' counts as a whole word only."""
    paid = F.regexp_extract(F.coalesce(text, F.lit("")), r"\$(\d+(?:\.\d{2})?)", 1)
    return F.when(F.lower(text).rlike(r"\bfree\b|\$0(?![.\d])|\bno (?:cover|charge)\b|\bcomplimentary\b"), "free").when(F.length(paid) > 0, F.concat(F.lit("$"), paid)).otherwise("unknown")


#: What begins a section of a caption on a new line: bullets and pictographs, points, days, dates, times.
_STARTS = [r"[•●▪\-*–→►]", r"\p{So}", r"\d{1,2}[.)]\s", "(?:" + rules.DAY[1:-1] + r")\b", rules.MONTH + r"\.?\s+\d", r"\d{1,2}[/.]\d{1,2}\b", r"\d{1,2}(?::\d\d)?\s*[ap]m\b"]


def split_caption(text: Column) -> Column:
    """Sections of a caption at blank lines, rules, and lines that begin with a bullet, a pictograph, a point, a day, a date or a time; sections under 15 characters join the one before."""
    parts = F.filter(F.transform(F.split(text, r"(?im)\n\s*(?:-{3,}|={3,}|_{3,}|~{3,})\s*\n|\n\s*\n|\n(?=\s*(?:" + "|".join(_STARTS) + "))"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.length(x) < 15) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x))),
    )
    return joined


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s\"'<>)]+"), F.lit(0)))


def mentions(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w.])@([A-Za-z0-9_.]{2,30})"), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")))


def canonical_url(url: Column) -> Column:
    """Scheme https, host lower-cased without www., no query, fragment or trailing slash."""
    u = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?i:https?)://([^/]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?i:https?)://[^/]+(/.*)?$", 1), "/+$", "")
    return F.when(F.length(host) > 0, F.concat(F.lit("https://"), host, path))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#:]+)", 1)), r"^www\.", "")


def caption_of_preview(text: Column) -> Column:
    """The quoted caption in a preview like 'N likes, M comments - name on DATE: "caption"'."""
    inner = F.regexp_extract(text, r'(?s):\s*[“"](.*)[”"]\.?\s*$', 1)
    return F.when(F.length(inner) > 0, inner).otherwise(text)


def first_line(text: Column) -> Column:
    """A caption's title: its first line that isn't a date, address, link or tag line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 4) & ~x.rlike(r"(?i)^(?:when|where|date|time|doors|tickets?|rsvp|address)\b|^https?://|^[#@]|^\d{1,2}[:/]"))
    return F.try_element_at(lines, F.lit(1))


def location_of(text: Column) -> Column:
    """What stands after a pin, 'where:' or 'at' with a capital letter."""
    pin = F.regexp_extract(text, r"(?:📍|(?i:where|location|venue)\s*:)\s*([^\n|]+)", 1)
    at = F.regexp_extract(text, r"\b(?:at|@)\s+((?:The\s+)?[A-Z][\w'&]*(?:\s+[A-Z][\w'&]*){0,4})", 1)
    return F.when(F.length(pin) > 0, F.trim(pin)).when(F.length(at) > 0, at)


def attendance_signal(text: Column) -> Column:
    """2 for stated intent to come, 1 more for tagging two or more friends."""
    intent = F.lower(F.coalesce(text, F.lit(""))).rlike(r"\b(?:going|i'?ll be there|see you there|count me in|can'?t wait|got (?:my )?tickets?)\b")
    return F.when(intent, 2).otherwise(0) + F.when(F.size(mentions(text)) >= 2, 1).otherwise(0)


def display_time(hhmm: Column) -> Column:
    h, m = F.substring(hhmm, 1, 2).try_cast("int"), F.substring(hhmm, 4, 2)
    return F.concat((F.pmod(h + 11, F.lit(12)) + 1).cast("string"), F.when(m != "00", F.concat(F.lit(":"), m)).otherwise(""), F.when(h < 12, " AM").otherwise(" PM"))


def display_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.regexp_replace(F.format_number(n / 1e6, 1), r"\.0$", ""), F.lit("M"))).when(n >= 1000, F.concat(F.regexp_replace(F.format_number(n / 1e3, 1), r"\.0$", ""), F.lit("k"))).otherwise(n.cast("string"))
