import datetime as dt
import json

from pyspark.sql import functions as F

from almanack.operators import profile
from almanack.sources import documents, jsonld, platforms

D = dt.date


def test_records_of_platforms(spark):
    api = {"event": {"name": "Salon", "url": "https://l.example/x", "start_at": "2026-07-05T00:30:00Z", "geo_address_info": {"address": "Hall", "full_address": "1 Main St, Brooklyn"}}, "calendar": {"name": "Host"}, "guest_count": 12}
    app = {"title": "Picnic", "startDate": "2026-07-06T18:00:00", "timezone": "America/New_York", "description": "<p>Bring food</p>", "goingGuestCount": 3}
    df = spark.createDataFrame([(1, json.dumps(api)), (2, "{"), (3, json.dumps({"event": {}}))], "id int, p string")
    r = platforms.records(df, "id", "p", platforms.API_ROW, "api").collect()
    assert [(x.title, x.date, x.start_time, x.location.name, x.organizer, x.attendance) for x in r] == [("Salon", D(2026, 7, 4), "20:30", "Hall", "Host", 12)]
    rows = platforms.records(spark.createDataFrame([(1, json.dumps(app))], "id int, p string"), "id", "p", platforms.APP_STATE, "app")
    assert rows.first().description == "Bring food"
    assert platforms.in_scope(rows, ["brooklyn"], ["America/New_York"]).count() == 1 and platforms.in_scope(rows, ["brooklyn"], []).count() == 0


def test_posts_and_listings(spark):
    posts = [("ann", "Jazz Night at Blue Hall\nthis friday 8pm, tickets at the door", dt.datetime(2026, 7, 1, 9), "https://p/1", ["https://i/1.jpg", "http://i/2.jpg"], 5, 1), ("bob", "GIVEAWAY tonight 8pm tag 2 friends", dt.datetime(2026, 7, 1, 9), "u", [], 0, 0), ("cy", "hello world", dt.datetime(2026, 7, 1, 9), "u", [], 0, 0)]
    df = spark.createDataFrame(posts, "account string, caption string, posted_at timestamp, url string, images array<string>, likes long, comments long")
    (r,) = platforms.posts(df, "saved").collect()
    assert (r.account, r.title, r.date, r.start_time, r.image_url, r.user_saved) == ("ann", "Jazz Night at Blue Hall", D(2026, 7, 3), "20:00", "https://i/1.jpg", True)
    html = '<a href="/a">Poetry Salon - New York, NY $35.00</a><a href="/b">Book - Austin, TX $20</a><a href="/c">About</a>'
    got = platforms.product_titles(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h", "New York").collect()
    assert [(x.href, x.title, x.price) for x in got] == [("/a", "Poetry Salon", "$35.00")]
    page = "<dl><dt>Date:</dt><dd>July 5</dd></dl>"
    assert spark.createDataFrame([(page,)], "h string").select(platforms.label_values(F.col("h"), "Date")).first()[0] == "July 5"


def test_lanes_and_circuit(spark):
    rows = spark.createDataFrame([("x", "low"), ("x", "saved"), ("y", "low")], "k string, lane string")
    assert {(r.k, r.lane) for r in platforms.lane_priority(rows, "k", ["saved", "low"]).collect()} == {("x", "saved"), ("y", "low")}
    runs = spark.createDataFrame([("a", i, f) for i, f in enumerate([False, True, True, False])], "k string, i int, f boolean")
    assert [r.i for r in platforms.circuit(runs, "k", "i", F.col("f")).orderBy("i").collect()] == [0, 1, 2]


def test_profiles(spark):
    acts = spark.createDataFrame([(1, "save", "ann", "x.com"), (1, "hide", "bob", None), (1, "open", "ann", None)], "user_id long, action string, account string, host string")
    assert {(r.dim, r.key): r.weight for r in profile.counters(acts, ["account", "host"]).collect()} == {("account", "ann"): 4, ("account", "bob"): 0, ("host", "x.com"): 3}
    one = spark.createDataFrame([({"a": 1}, "a", -5)], "m map<string,int>, k string, n int").select(profile.bump(F.col("m"), F.col("k"), F.col("n"))).first()[0]
    assert one == {"a": 0}
    ids = spark.createDataFrame([("1",), ("2",)], "event_id string")
    live, stub = spark.createDataFrame([("1", "now", 5)], "event_id string, title string, score int"), spark.createDataFrame([("1", "then"), ("2", "old")], "event_id string, title string")
    assert {tuple(r) for r in profile.saved(ids, live, stub).collect()} == {("1", "now", 5), ("2", "old", None)}
    names = spark.createDataFrame([("Ann Smith",), ("Blue Bar Club",), ("Ann B. Smith",)], "n string").select(profile.personal_name(F.col("n"))).collect()
    assert [r[0] for r in names] == [True, False, True]
    got = spark.createDataFrame([(True, "jazz and books", False)], "f boolean, w string, c boolean").select(profile.profile_boost(F.col("f"), F.col("w"), ["jazz", "books"], F.col("c"), F.lit(False))).first()[0]
    assert got == 210
    com = spark.createDataFrame([("A", "s", ["music"], ["x"], ["4-evening"], 2), ("B", "s", ["art"], ["x"], ["5-night"], 0)], "name string, summary string, categories array<string>, hoods array<string>, slots array<string>, event_count int")
    assert [r.name for r in profile.directory(com, hoods=["x"]).collect()] == ["A", "B"] and profile.directory(com, categories=["art"], active=True).count() == 0


def test_payloads_are_walked_sixteen_levels_a_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(jsonld.tables, "settle", lambda df, name, settle=jsonld.tables.settle: written.append(name) or settle(df, name))
    bodies = [(1, '{"a":[{"k":"x"},{"b":{"k":5,"c":[[{"k":"y"}]]}}]}'), (2, "[1,2]"), (3, "null"), (4, None), (5, '"s"'), (6, '{"k":null}'), (8, "{}"), (9, '{"a":' * 13 + '{"k":"z"}' + "}" * 13)]
    walked = lambda rows: spark.createDataFrame(rows, "i long, t string").select("i", F.try_parse_json("t").alias("v"))
    assert sorted(map(tuple, jsonld.tokens(walked(bodies), "i", "v", ["k"]).collect())) == [(1, "5"), (1, "x"), (1, "y"), (9, "z")] and len(written) == 1
    deep = walked([*bodies, (7, '{"a":' * 40 + '{"k":"deep"}' + "}" * 40)])
    assert {(r.i, r["count"]) for r in jsonld.nodes(deep, "i", "v").groupBy("i").count().collect()} == {(1, 5), (6, 1), (7, 41), (8, 1), (9, 14)} and len(written) == 4


def test_dates_of_pages_and_cards_are_read_once_a_row(spark):
    df = spark.createDataFrame([(1, '<meta property="og:title" content="Gala, May 5, 2024">'), (2, '<li class="event"><a>Gala</a><time>May 5, 2024</time></li>')], "i long, html string")
    meta = documents.open_graph(df, "i", "html", F.lit(D(2024, 1, 1)))
    cards = documents.cards(df, "i", "html", *platforms.CARDS["items"], F.lit(D(2024, 1, 1)))
    for found, i in ((meta, 1), (cards, 2)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MMMM d, yyyy") == 2  # of two texts, and not again in a filter
        assert [(r.i, r.date) for r in found.collect()] == [(i, D(2024, 5, 5))]
