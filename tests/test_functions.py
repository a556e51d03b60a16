import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanack.functions import dates, scores, text
from almanack.operators import admission

D = dt.date


def values(spark, rows, schema, *columns):
    got = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in got]


def test_titles(spark):
    cases = [("Copy of Book &amp; Wine", "Book & Wine"), ("🎉 Party Time #fun #nyc", "Party Time"), ("Show with Ann on FRI, JUL 10", "Show with Ann"), ("Great Reading Series Night: Tonight, we gather", "Great Reading Series Night"), ("BERTHA: Grateful Drag", "BERTHA: Grateful Drag"), ("Gbrooklynmuseum opening", "@brooklynmuseum opening"), ("a   b", "a b")]
    assert values(spark, [(a,) for a, _ in cases], "t string", text.clean_title(F.col("t"))) == [b for _, b in cases]


def test_descriptions(spark):
    long = "One two three four. " * 20
    cases = [("Hello there\nLink in bio!\n#a #b\n@x @y\nhttps://a.b/c", "Hello there"), ("See https://a.b/c now", "See now"), ("Nice show #fun #art", "Nice show"), (None, "")]
    assert values(spark, [(a,) for a, _ in cases], "t string", text.clean_description(F.col("t"))) == [b for _, b in cases]
    cut = values(spark, [(long,)], "t string", text.clean_description(F.col("t")))[0]
    assert cut.endswith(".") and 150 < len(cut) <= 250


def test_prices_and_keys(spark):
    cases = [("Free entry", "free"), ("freedom fighters", "unknown"), ("tickets $25.00 at door", "$25.00"), ("no cover", "free"), (None, "unknown")]
    assert values(spark, [(a,) for a, _ in cases], "t string", text.price_of(F.col("t"))) == [b for _, b in cases]
    day = F.lit("2026-07-01").cast("date")
    a, b, c = values(spark, [("The Jazz Evening Concert",), ("concert: EVENING jazz!",), ("the and for",)], "t string", text.exact_key(F.col("t"), day))
    assert a == b and c is None


def test_times(spark):
    cases = [("doors at 7pm, show 8pm", "19:00"), ("come at 7:30pm", "19:30"), ("2pm to 5pm", None), ("", None)]
    assert values(spark, [(a,) for a, _ in cases], "t string", dates.time_from_text(F.lit(""), F.col("t"))) == [b for _, b in cases]
    cases = [("7:30 PM", "19:30"), ("8am", "08:00"), ("run club 7:30", "07:30"), ("concert 8:00", "20:00"), ("at 3:00", "15:00"), ("at 9:00", None), ("12am", "00:00")]
    assert values(spark, [(a,) for a, _ in cases], "t string", dates.parse_time(F.col("t"))) == [b for _, b in cases]


def test_iso(spark):
    cases = [("2026-05-26T22:00:00Z", ("2026-05-26", "18:00")), ("2026-05-26T22:00:00", ("2026-05-26", "22:00")), ("2026-05-26", ("2026-05-26", None)), ("2026-05-26Tbad", ("2026-05-26", None)), ("2026-01-01T02:00:00+00:00", ("2025-12-31", "21:00"))]
    got = values(spark, [(a,) for a, _ in cases], "t string", dates.local_date_time(F.col("t")))
    assert [tuple(x) for x in got] == [b for _, b in cases]


def test_recurrence(spark):
    cases = [("every friday at the bar", 4), ("Tuesdays @ 7", 1), ("March 27 Sundays", None), ("weekly on wed", 2), ("one night only every friday", None), ("nothing", None)]
    assert values(spark, [(a,) for a, _ in cases], "t string", dates.recurring_weekday(F.col("t"))) == [b for _, b in cases]
    got = values(spark, [(D(2026, 7, 3), 4), (D(2026, 7, 1), None)], "d date, w int", dates.occurrences(F.col("d"), F.col("w"), 3))
    assert got == [[D(2026, 7, 3), D(2026, 7, 10), D(2026, 7, 17)], [D(2026, 7, 1)]]


def test_relative_dates(spark):
    anchor = F.lit("2026-07-01").cast("date")  # a Wednesday
    cases = [("tonight!", D(2026, 7, 1)), ("tomorrow", D(2026, 7, 2)), ("this friday", D(2026, 7, 3)), ("next wednesday", D(2026, 7, 8)), ("in 10 days", D(2026, 7, 11)), ("this weekend", D(2026, 7, 4)), ("soon", None)]
    assert values(spark, [(a,) for a, _ in cases], "t string", dates.relative_date(F.col("t"), anchor)) == [b for _, b in cases]
    cases = [("June 20", D(2026, 6, 20)), ("Jan 5", D(2027, 1, 5)), ("2026-08-09 x", D(2026, 8, 9)), ("7/4/2026", D(2026, 7, 4)), ("x", None)]
    assert values(spark, [(a,) for a, _ in cases], "t string", dates.parse_date(F.col("t"), anchor)) == [b for _, b in cases]


def test_urls_and_handles(spark):
    assert values(spark, [("HTTP://www.A.com/x/?q=1#f",), ("junk",)], "u string", text.canonical_url(F.col("u"))) == ["https://a.com/x", None]
    assert values(spark, [("hi @Ann and a@b.co @bob.",)], "u string", text.mentions(F.col("u"))) == [["ann", "bob"]]
    assert "foobar" in values(spark, [("Foo Bar NYC",)], "u string", text.handle_variants(F.col("u")))[0]
    assert values(spark, [("13:05",), ("09:00",)], "t string", text.display_time(F.col("t"))) == ["1:05 PM", "9 AM"]
    assert values(spark, [(950,), (1500,), (2_000_000,)], "n long", text.display_count(F.col("n"))) == ["950", "1.5k", "2M"]


@pytest.mark.parametrize("score", [(900, 500, 999), (100, 0, -999), (0, 0, 0)])
def test_scores_are_bounded(spark, score):
    got = values(spark, [score], "b int, e int, s int", scores.final(F.col("b"), F.col("e"), F.col("s"), F.lit(0), F.lit(0)))[0]
    assert 0 <= got <= 1000
    assert got == max(0, min(1000, score[0] + score[1] + max(-200, min(320, score[2]))))


def test_tiers_and_distance(spark):
    assert values(spark, [(0,), (10,), (49,), (500,)], "d int", scores.velocity(F.col("d"))) == [0, 20, 20, 100]
    assert abs(values(spark, [(40.0, -74.0, 41.0, -74.0)], "a double, b double, c double, d double", scores.miles(F.col("a"), F.col("b"), F.col("c"), F.col("d")))[0] - 69.1) < 0.1
    assert values(spark, [(0b1011, 0b0001)], "a long, b long", scores.hamming(F.col("a"), F.col("b"))) == [2]


def test_late_and_fragments(spark):
    cases = [(("23:00", None, "x"), True), (("20:00", "02:00", "x"), True), (("20:00", "00:00", "x"), False), ((None, None, "open until 2am"), True), (("19:00", "21:00", "Reading"), False)]
    assert values(spark, [a for a, _ in cases], "s string, e string, t string", admission.past_midnight(F.col("s"), F.col("e"), F.col("t"), F.lit(""))) == [b for _, b in cases]
    cases = [("Swipe for details", ["opener_call"]), ("July 4th", ["only_date"]), ("Dinner and", ["open_end"]), ("Jazz at the Hall", [])]
    assert values(spark, [(a,) for a, _ in cases], "t string", admission.fragment_rules(F.col("t"), admission.FRAGMENTS)) == [b for _, b in cases]
