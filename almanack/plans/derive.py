"""Queries over the scalar rules: texts are dealt to the rows of ``events`` by their id, and the oracle states what each must become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import dates, scores
from almanack.functions import text as tx
from almanack.operators import admission, enrich, profile
from almanack.plans.registry import query
from almanack.sources import documents
from almanack.sources.tables import load


def pick(values: list) -> Column:
    """The value that a row's id deals it."""
    return F.get(F.array(*map(F.lit, values)), F.pmod("event_id", F.lit(len(values))).cast("int"))


def _sql(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]"
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def dealt(values: list) -> str:
    """``pick`` in the oracle's dialect."""
    return f"({_sql(values)})[CAST(event_id % {len(values)} AS INT) + 1]"


def both(cases: list[tuple]) -> list[list]:
    return [list(x) for x in zip(*cases)]


_TITLES = both([
    ("Copy of Book &amp; Wine", "Book & Wine"), ("🎉 Party Time #fun #nyc", "Party Time"), ("Show with Ann on FRI, JUL 10", "Show with Ann"), ("Great Reading Series Night: Tonight, we gather", "Great Reading Series Night"),
    ("TIDES: Songs of the Sea", "TIDES: Songs of the Sea"), ("Charbormuseum opening", "@harbormuseum opening"), ("a   b", "a b"), ("Talk @one @two @three", "Talk"), ("Fire 🔥🔥🔥🔥 Night", "Fire 🔥 Night"), ("Reading by one #tag", "Reading by one #tag"), ("Copy of", "Copy of"),
])


@query(f"SELECT event_id, {dealt(_TITLES[1])} AS title FROM events")
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of display titles."""
    return load(spark, sf_dir, "events").select("event_id", tx.clean_title(pick(_TITLES[0])).alias("title"))


_BODIES = both([
    ("Hello there\nLink in bio!\n#a #b\n@x @y\nhttps://a.b/c", "Hello there"), ("See https://a.b/c now", "See now"), ("Nice show #fun #art", "Nice show"), (None, ""), ("🔥🔥\nDoors at seven", "Doors at seven"),
    ("Come dance with us all night long at the old hall by the river, friends. Tickets in our bio!", "Come dance with us all night long at the old hall by the river, friends."), ("word " * 80, "word " * 49 + "word…"), ("One two three four. " * 20, ("One two three four. " * 12).strip()),
])


@query(f"SELECT event_id, {dealt(_BODIES[1])} AS description FROM events")
def description_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of descriptions."""
    return load(spark, sf_dir, "events").select("event_id", tx.clean_description(pick(_BODIES[0])).alias("description"))


_KEYS = both([
    ("The Jazz Evening Concert", "concert evening jazz", "the-jazz-evening-concert"), ("concert: EVENING jazz!", "concert evening jazz", "concert-evening-jazz"), ("the and for", None, "the-and-for"),
    ("Seven Words Make Long Titles Very Hard", "long make seven titles very words", "seven-words-make-long-titles-very-hard"),
])
_VENUES = both([("The Bell House, 149 7th St", "bell house"), ("Lyric Theatre & Bar NYC", "lyric theater and"), ("Saint Ann's Hall", "st ann s"), (None, "")])


@query(f"""
SELECT event_id, CASE WHEN {dealt(_KEYS[1])} IS NOT NULL THEN md5({dealt(_KEYS[1])} || ':' || CAST(ts AS DATE)) END AS key, {dealt(_KEYS[2])} AS slug,
  substr(sha256(event_type || '|' || {dealt(_KEYS[0])}), 1, 16) AS id, {dealt(_VENUES[1])} AS venue FROM events
""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys, slugs, short ids and venue keys."""
    title = pick(_KEYS[0])
    return load(spark, sf_dir, "events").select("event_id", tx.exact_key(title, F.to_date("ts")).alias("key"), tx.slug(title).alias("slug"), tx.short_id(F.col("event_type"), title).alias("id"), tx.venue_key(pick(_VENUES[0])).alias("venue"))


_GRADES = both([("", 0), ("abc", 0), ("see www.x.com for it", 100), ("12 34 56 78 a", 250), ("JAZZ NIGHT AT THE HALL", 500), ("Jazz", 600), ("Jazz Night Downtown", 1000), ("Jazz Night", 800)])


@query(f"SELECT event_id, {dealt(_GRADES[1])} AS quality FROM events")
def title_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of title qualities."""
    return load(spark, sf_dir, "events").select("event_id", tx.title_quality(pick(_GRADES[0])).alias("quality"))


_RECURRING = both([("every friday at the bar", 4), ("Tuesdays @ 7", 1), ("March 27 Sundays", None), ("weekly on wed", 2), ("one night only every friday", None), ("nothing", None), ("every other sunday", 6), ("Friday nights of jazz", 4), ("the debut, on fridays", None), ("x" * 110 + " mondays", None), ("5/9 mondays", None)])


@query(f"SELECT event_id, {dealt(_RECURRING[1])} AS weekday FROM events")
def recurring_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and weak signs of a weekly event, and what vetoes them."""
    return load(spark, sf_dir, "events").select("event_id", dates.recurring_weekday(pick(_RECURRING[0])).alias("weekday"))


_CLOCKS = both([
    ("7:30 PM", "19:30", "19:30"), ("8am", "08:00", "08:00"), ("run club 7:30", "07:30", None), ("concert 8:00", "20:00", None), ("at 3:00", "15:00", None), ("at 9:00", None, None), ("12am", "00:00", None),
    ("doors at 7pm, show 8pm", "19:00", "19:00"), ("2pm to 5pm", "14:00", None), ("", None, None),
])


@query(f"SELECT event_id, {dealt(_CLOCKS[1])} AS parsed, {dealt(_CLOCKS[2])} AS inferred FROM events")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with and without am and pm; start times that a text implies."""
    t = pick(_CLOCKS[0])
    return load(spark, sf_dir, "events").select("event_id", dates.parse_time(t).alias("parsed"), dates.time_from_text(F.lit(""), t).alias("inferred"))


_DAYS = ["tonight!", "tomorrow", "this friday", "in 10 days", "2026-08-09 x", "7/4/2026", "July 14, 2026", "Mar 3", "soon", "next monday"]


@query(f"""
SELECT event_id, CASE event_id % 10 WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 2 THEN d + CAST((4 - w + 7) % 7 AS INT) WHEN 3 THEN d + 10 WHEN 4 THEN DATE '2026-08-09' WHEN 5 THEN DATE '2026-07-04' WHEN 6 THEN DATE '2026-07-14'
  WHEN 7 THEN DATE '2024-03-03' WHEN 9 THEN d + CAST(CASE WHEN w = 0 THEN 7 ELSE (7 - w) % 7 END AS INT) END AS date, ({_sql(_DAYS)})[CAST(event_id % 10 AS INT) + 1] AS words
FROM (SELECT event_id, CAST(ts AS DATE) AS d, isodow(ts) - 1 AS w FROM events)
""")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several formats and relative phrases, from the row's own day."""
    return load(spark, sf_dir, "events").select("event_id", dates.parse_date(pick(_DAYS), F.to_date("ts")).alias("date"), pick(_DAYS).alias("words"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 2 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) END AS date,
  CASE event_id % 3 WHEN 2 THEN NULL WHEN 1 THEN strftime(ts, '%H:%M') ELSE strftime(ts - INTERVAL 5 HOUR, '%H:%M') END AS time FROM events
""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times with a zone, without one, and dates alone, as seen in the city (five hours west in January)."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.pmod("event_id", F.lit(3)) == 2, F.date_format("ts", "yyyy-MM-dd")).when(F.pmod("event_id", F.lit(3)) == 1, iso).otherwise(F.concat(iso, F.lit("Z")))
    return load(spark, sf_dir, "events").select("event_id", dates.local_date_time(text).alias("x")).select("event_id", "x.date", "x.time")


_STARTS = both([("fitness", "morning meet", "11:00"), ("music", "", "20:00"), ("books", "", "19:00"), ("other", "", None), ("art", "opening reception", "18:00"), ("theater", "x", "19:30")])


@query(f"SELECT event_id, {dealt(_STARTS[2])} AS start FROM events")
def default_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A likely start by the words, else by the category."""
    return load(spark, sf_dir, "events").select("event_id", dates.default_start(F.array(pick(_STARTS[0])), pick(_STARTS[1])).alias("start"))


_SOCIAL = both([
    ('9 likes, 2 comments - ann on May 1: "Jazz at @Blue.Hall. and @bob"', "Jazz at @Blue.Hall. and @bob", "blue.hall,bob", 1, "Blue Hall"), ("see you there! @a @ann @bea", "see you there! @a @ann @bea", "ann,bea", 3, None),
    ("mail a@b.co", "mail a@b.co", "", 0, None), ("📍 Green Room\nat The Loft Club tonight", "📍 Green Room\nat The Loft Club tonight", "", 0, "Green Room"), ("Salon at The Loft Club tonight", "Salon at The Loft Club tonight", "", 0, "The Loft Club"),
])
_SOCIAL[4][0] = None


@query(f"SELECT event_id, {dealt(_SOCIAL[1])} AS caption, {dealt(_SOCIAL[2])} AS mentioned, {dealt(_SOCIAL[3])} AS signal, {dealt(_SOCIAL[4])} AS place FROM events")
def social_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions in previews, mentions, signs of attendance and places."""
    t = pick(_SOCIAL[0])
    return load(spark, sf_dir, "events").select("event_id", tx.caption_of_preview(t).alias("caption"), F.array_join(tx.mentions(t), ",").alias("mentioned"), tx.attendance_signal(t).alias("signal"), tx.location_of(t).alias("place"))


_NAMES = both([("Ann Smith", True, False), ("Blue Bar Club", False, False), ("Ann B. Smith", True, False), ("brrk xqz | {a} tst kjh wrt", False, True), ("one two three four five six", False, False)])


@query(f"SELECT event_id, {dealt(_NAMES[1])} AS personal, {dealt(_NAMES[2])} AS garbled FROM events")
def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of persons, and text that a scan garbled."""
    return load(spark, sf_dir, "events").select("event_id", profile.personal_name(pick(_NAMES[0])).alias("personal"), tx.garbled(pick(_NAMES[0])).alias("garbled"))


_URLS = both([("https://www.x.com/e/jazz-1?a=1", "event", False, False), ("https://x.com/o/ann", "organizer", False, False), ("https://linktr.ee/ann", "other", True, False), ("https://off.example.com/events/1", "event", False, True), ("http://beacons.ai/x/", "other", True, False)])


@query(f"SELECT event_id, {dealt(_URLS[1])} AS kind, {dealt(_URLS[2])} AS listing, {dealt(_URLS[3])} AS disabled FROM events")
def url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an address leads to: an event, an organiser, a list of links, a host that is switched off."""
    u = pick(_URLS[0])
    return load(spark, sf_dir, "events").select("event_id", documents.platform(tx.canonical_url(u)).alias("kind"), documents.lists_links(u).alias("listing"), documents.disabled(u, ["example.com"]).alias("disabled"))


_ADMIT = both([  # start, end, title, description, image, venue, late, phantom, away, shell, ready
    ("23:00", None, "Jazz", "x", "", "", True, False, False, True, False), ("20:00", "02:00", "Jazz", "A long evening of music with friends, all are welcome", "http://i/x.jpg", "Blue Hall", True, False, False, False, True),
    ("20:00", "00:00", "Jazz in Boston", "x", "", "Hall", False, False, True, False, False), (None, None, "open until 2am", "", "", "", True, False, False, True, False), ("19:00", "21:00", "Boston band in Brooklyn", "", "", "", False, False, False, True, False),
    ("19:00", None, "Jazz on March 3", "A long evening of music with friends, all are welcome", "http://i/x.jpg", "TBA", False, True, False, False, False),
])


@query(f"SELECT event_id, {', '.join(f'{dealt(_ADMIT[i])} AS {name}' for i, name in zip(range(6, 11), ['late', 'phantom', 'away', 'shell', 'ready']))} FROM events")
def admission_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late hours, dates that the title contradicts, other cities, rows with too little to show, rows fit to be featured."""
    names = ["start_time", "end_time", "title", "description", "image_url", "venue"]
    rows = load(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"), *(pick(v).alias(n) for n, v in zip(names, _ADMIT)))
    rows = rows.withColumn("location", F.struct(F.col("venue").alias("name")))
    return rows.select(
        "event_id", admission.past_midnight(F.col("start_time"), F.col("end_time"), F.col("title"), F.col("description")).alias("late"), admission.phantom(F.lit(True), F.col("title"), F.col("date")).alias("phantom"),
        admission.blocked(F.col("title"), [], [], ["boston"], ["brooklyn"]).alias("away"), admission.shell(rows.columns).alias("shell"), F.coalesce(admission.feature_ready(rows.columns), F.lit(False)).alias("ready"),
    )


@query("""
SELECT event_id FROM (SELECT *, CAST(ts AS DATE) AS d, hour(ts) * 60 + minute(ts) AS m FROM events) WHERE d > DATE '2024-01-20' OR (d = DATE '2024-01-20' AND m + 180 >= 720)
""")
def still_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to come, and those of today that began three hours ago at most (at noon)."""
    rows = load(spark, sf_dir, "events")
    return rows.filter(admission.still_upcoming(F.to_date("ts"), F.date_format("ts", "HH:mm"), F.lit("2024-01-20").cast("date"), F.lit(720))).select("event_id")


@query("""
SELECT event_id, CAST(ts AS DATE) AS date FROM events WHERE event_type <> 'error' AND (CAST(ts AS DATE) - DATE '2024-01-10' <= 14 OR event_type = 'purchase' OR (event_type <> 'view' AND event_id % 2 = 0))
""")
def far_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over two weeks ahead stay for a trusted source, or with their year written, but not for captions; a source switched off goes."""
    rows = load(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"), F.col("event_type").alias("source"), F.concat_ws(" ", F.lit("Gala"), F.when(F.col("event_id") % 2 == 0, "2024")).alias("title"), F.lit("12024").alias("description"), F.lit("https://x.com").alias("source_url"))
    return admission.far_future(admission.present(rows, ["error"]), F.lit("2024-01-10").cast("date"), ["purchase"], 14, "view").select("event_id", "date")


_FLOORS = "CASE WHEN event_type = 'purchase' OR event_id % 5 = 0 THEN 250 ELSE 350 END"


@query(f"SELECT event_id, {_FLOORS} AS floor, CAST(floor(value * 8) AS BIGINT) >= {_FLOORS} AS shown FROM events WHERE value IS NOT NULL")
def score_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score that is shown: lower for what the user vouches for and for curated hosts."""
    rows = load(spark, sf_dir, "events").filter("value IS NOT NULL").withColumn("user_saved", F.col("event_type") == "purchase")
    host = F.when(F.col("event_id") % 5 == 0, "https://good.example/e/1").otherwise("https://x.example/1")
    rows = rows.withColumn("floor", admission.floor_of(rows.columns, admission.curated(host, F.lit(""), ["good.example"], [])))
    return rows.select("event_id", "floor", (F.floor(F.col("value") * 8) >= F.col("floor")).alias("shown"))


_PREFIX = both([("Ann Lee, Bo Day, Cy Fox", "comedy", "Comedy: Ann Lee, Bo Day, Cy Fox"), ("The Long Road by Ann Lee", "books", "Book club: The Long Road by Ann Lee"), ("Ann Lee, Bo Day", "comedy", "Ann Lee, Bo Day"), ("The Long Road by Ann Lee", "music", "The Long Road by Ann Lee")])


@query(f"""
SELECT event_id, {dealt(_PREFIX[2])} AS title, CASE WHEN event_id % 3 = 0 THEN 'music' ELSE 'outdoors,music' END AS categories, CASE WHEN event_id % 2 = 0 THEN 'own' WHEN event_type IN ('view', 'click') THEN 'of ' || event_type END AS image,
  CASE WHEN event_id % 7 = 0 THEN 'saved,free' WHEN event_id % 2 = 0 THEN 'free' ELSE '' END AS reasons, CASE WHEN event_id % 7 = 0 THEN 'personal' ELSE 'adjacent' END AS lane FROM events
""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of bare titles, no outdoors in a hall, images by source, reasons and lanes."""
    rows = load(spark, sf_dir, "events").withColumns({"source": F.col("event_type"), "image_url": F.when(F.col("event_id") % 2 == 0, "own")})
    images = spark.createDataFrame([("view", "of view"), ("click", "of click")], "source string, image_url string")
    inside = F.when(F.col("event_id") % 3 == 0, "Town Hall").otherwise("Park")
    saved = F.col("event_id") % 7 == 0
    return enrich.default_image(rows, images).select(
        "event_id", enrich.title_prefix(pick(_PREFIX[0]), F.array(pick(_PREFIX[1]))).alias("title"), F.array_join(enrich.indoors(F.array(F.lit("outdoors"), F.lit("music")), inside), ",").alias("categories"), F.col("image_url").alias("image"),
        F.array_join(enrich.reasons((saved, "saved"), (saved | (F.col("event_id") % 2 == 0), "free")), ",").alias("reasons"), enrich.lane(saved).alias("lane"),
    )


_POINTS = both([  # sources, accounts, posts, share, delta, comentions, followers, verified, likes, price; then what they are worth
    (1, 1, 3, 0.9, 0, 0, 0, False, 0, "free", 0, 0, 0, 0, 0, 400, 1000), (2, 2, 5, 0.5, 10, 1, 5000, True, 30, "$20", 110, 60, 20, 30, 55, 500, 850), (3, 3, 9, 0.1, 150, 3, 25000, False, 150, "$50", 190, 20, 70, 70, 25, 600, 600),
    (4, 4, 9, 0.25, 500, 5, 100000, True, 5000, "$100", 260, 40, 100, 100, 60, 1000, 400), (5, 1, 9, 0.01, 49, 2, 10, False, 1500, "unknown", 160, 0, 20, 50, 0, 900, 600),
])


@query(f"SELECT event_id, {', '.join(f'{dealt(_POINTS[i])} AS {n}' for i, n in zip(range(10, 17), ['confirmed', 'yielded', 'rising', 'named', 'credible', 'popular', 'priced']))} FROM events")
def point_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers of points: confirmation, yield, velocity, co-mentions, credibility, popularity and price."""
    sources, accounts, posts, share, delta, named, followers, verified, likes, price = (pick(v) for v in _POINTS[:10])
    some = lambda n: F.sequence(F.lit(1), n)
    zero = F.lit(0)
    return load(spark, sf_dir, "events").select(
        "event_id", scores.confirmation(some(sources), some(accounts)).alias("confirmed"), scores.account_yield(share, posts).alias("yielded"), scores.velocity(delta).alias("rising"), scores.comentions(named).alias("named"),
        scores.credibility(verified, followers).alias("credible"), scores.popularity(likes, zero, zero, zero).alias("popular"), scores.price(price).alias("priced"),
    )


@query("""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, hour(ts) AS h, hour(ts) * 60 + minute(ts) - 720 AS gone, isodow(ts) - 1 AS w, CAST(CAST(ts AS DATE) - DATE '2024-01-20' AS INT) AS n FROM events)
SELECT event_id, CASE WHEN n < 0 THEN 0 WHEN n = 0 THEN CASE WHEN gone < 0 THEN 30 WHEN gone <= 180 THEN 120 WHEN gone <= 360 THEN 100 ELSE 70 END WHEN n = 1 THEN 60 WHEN n <= 4 THEN 40 WHEN n <= 7 THEN 30 WHEN n <= 14 THEN 15 ELSE 0 END AS soon,
  CASE WHEN w IN (4, 5) THEN 50 WHEN w <= 2 THEN -30 ELSE 0 END + CASE WHEN w IN (3, 4, 5) THEN 10 * CASE WHEN w IN (4, 5) THEN 1 ELSE 4 END ELSE 0 END AS weekday,
  CASE WHEN h BETWEEN 18 AND 21 THEN 40 WHEN h BETWEEN 17 AND 22 THEN 20 WHEN h BETWEEN 9 AND 15 AND w < 5 THEN -20 ELSE 0 END AS hour FROM e
""")
def time_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for the days and hours left, for the weekday (parties with music, 60 at most) and for the hour."""
    day, start, cats = F.to_date("ts"), F.date_format("ts", "HH:mm"), F.array(F.lit("parties"), F.lit("music"))
    return load(spark, sf_dir, "events").select("event_id", scores.soon(day, start, F.lit("2024-01-20").cast("date"), F.lit(720)).alias("soon"), scores.weekday_fit(day, cats).alias("weekday"), scores.hour_fit(day, start, cats).alias("hour"))


@query("""
WITH m AS (SELECT event_id, round(2 * 3958.8 * asin(sqrt(pow(sin(radians(value / 500) / 2), 2) + cos(radians(40.7)) * cos(radians(40.7 + value / 500)) * pow(sin(radians(value / 1000) / 2), 2))), 6) AS miles FROM events WHERE value IS NOT NULL)
SELECT event_id, miles, CASE WHEN miles <= 1 THEN 60 WHEN miles <= 3 THEN 40 WHEN miles <= 6 THEN 20 WHEN miles >= 15 THEN -30 ELSE 0 END AS near FROM m
""")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Miles between two places, and their points."""
    v = F.col("value")
    rows = load(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", F.round(scores.miles(F.lit(40.7), F.lit(-74.0), 40.7 + v / 500, -74.0 + v / 1000), 6).alias("miles"))
    return rows.withColumn("near", scores.near(F.col("miles")))


_BIOS = both([("Live music venue", 100, 5000, 80, 1000), ("my cat", 100, 100, 0, 0), ("tickets here", 10, 900_000, 1, 410), (None, 0, 600, 0, 250)])


@query(f"""
SELECT event_id, {dealt(_BIOS[4])} AS account, least(250, CASE WHEN event_id % 2 = 0 THEN 150 ELSE 0 END + least(100, 30 * (CASE WHEN event_type = 'view' THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)) + CASE WHEN event_id % 5 = 0 THEN 50 ELSE 0 END) AS profile,
  round(least(250, least(150, 40 * log2(1 + event_id % 9)) + least(60, 20 * log2(1 + event_id % 4))) - least(200, 60 * log2(1 + event_id % 6)), 6) AS used FROM events
""")
def interest_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of accounts, boosts of an interest profile, and boosts of use, which saturate."""
    bio, posts, followers, events, _ = (pick(v) for v in _BIOS)
    words = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 3 == 0, "jazz"))
    rows = load(spark, sf_dir, "events").withColumns({"account": F.lit("a"), "categories": F.array(F.lit("c"))})
    count = lambda key, n: F.create_map(F.lit(key), F.pmod("event_id", F.lit(n)))
    return rows.select(
        "event_id", scores.account_score(bio, posts, followers, events).alias("account"), profile.profile_boost(F.col("event_id") % 2 == 0, words, ["view", "jazz"], F.col("event_id") % 5 == 0, F.lit(False)).alias("profile"),
        F.round(profile.boost(rows, "account", "categories", count("a", 9), count("c", 4), count("a", 6)), 6).alias("used"),
    )


_CAPTIONS = both([
    ("Our week of music\n\nFriday: Jazz Night at Blue Hall\nSaturday: Art Walk downtown", ["Our week of music", "Friday: Jazz Night at Blue Hall", "Saturday: Art Walk downtown"]), ("Picks for you here\n• Jazz Night at Blue Hall\n- Art Walk downtown, free\n1) Book Swap at noon", ["Picks for you here", "• Jazz Night at Blue Hall", "- Art Walk downtown, free", "1) Book Swap at noon"]),
    ("July 4 Jazz Night downtown\nshort\nJuly 5 Art Walk downtown", ["July 4 Jazz Night downtown\nshort", "July 5 Art Walk downtown"]), ("The first long section\n-----\nThe second long section\n7/9 The third long section\n8pm The fourth section", ["The first long section", "The second long section", "7/9 The third long section", "8pm The fourth section"]),
    ("The first long section\n\ntiny\n\nThe second long section", ["The first long section tiny", "The second long section"]), ("🎟 Tickets for the jazz night\n📍 The Blue Hall downtown", ["🎟 Tickets for the jazz night", "📍 The Blue Hall downtown"]),
])


@query(f"SELECT event_id, array_to_string({dealt(_CAPTIONS[1])}, '|') AS sections FROM events")
def caption_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions cut into sections at every kind of boundary."""
    return load(spark, sf_dir, "events").select("event_id", F.array_join(tx.split_caption(pick(_CAPTIONS[0])), "|").alias("sections"))

