"""State over streams with late rows, timers and a start from the last run, against a walk in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from almanack.streaming import lifecycle, windows

SCHEMA = "event_id long, k string, ts timestamp, o string, at long, status string"
BEGIN = dt.datetime(2024, 1, 1)


def walk(rows, upto, cool, dead_at=3):
    out, standing = [], {}
    for key in {r[1] for r in rows} - {None}:
        strikes, since = 0, None
        for at, _, o in sorted((r[2], r[0], r[3]) for r in rows if r[1] == key and r[2] and r[2] <= upto and r[3] not in (None, "timeout")) + [(upto, 0, None)]:
            if since and since + cool <= at:
                out.append((key, since + cool, "retest", strikes))
                since = None
            if o == "ok":
                out += [(key, at, "alive", 0)] if strikes >= dead_at else []
                strikes, since = 0, None
            elif o:
                strikes += 1
                if strikes >= dead_at:
                    out += [] if since else [(key, at, "dead", strikes)]
                    since = at
        standing[key] = (strikes, since)
    return sorted(out), {k: v for k, v in standing.items() if v[0]}


def some_log(n=260):
    rng = random.Random(7)
    rows = [(i, rng.choice("abcde"), BEGIN + dt.timedelta(microseconds=rng.randrange(30 * 86_400_000_000)), rng.choice(["ok", "gone", "gone", "gone", "timeout", None])) for i in range(n)]
    return rows + [(900, None, BEGIN, "gone"), (901, "a", None, "gone"), (902, "quiet", BEGIN + dt.timedelta(days=8), "gone"), (903, "quiet", BEGIN + dt.timedelta(days=8), "gone"), (904, "quiet", BEGIN + dt.timedelta(days=8), "gone")]


@pytest.mark.parametrize("cut_days", [0, 9])
def test_a_stream_with_late_rows_equals_the_walk(spark, cut_days):
    rows, cool = some_log(), dt.timedelta(days=3)
    cut = BEGIN + dt.timedelta(days=cut_days)
    log = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    rules = {"key": "k", "outcome": "o", "seq": "event_id", "transient": ["timeout"], "cool_days": 3}
    before = lifecycle.standing(log, upto=F.lit(cut), **rules)
    standing = walk(rows, cut, cool)[1]
    assert {r.k: (r.strikes, r.since) for r in before.collect()} == standing
    late = (F.unix_timestamp("ts") + F.pmod(F.hash("event_id"), F.lit(172_000))) - int((BEGIN - dt.datetime(1970, 1, 1)).total_seconds())
    stream = windows.replay(log.filter(F.col("ts") > F.lit(cut)), F.least(F.floor(late / (6 * 86_400)), F.lit(4)).cast("int"), 5, "log")
    out = windows.drain(lifecycle.health(stream, delay="2 days", before=before, **rules), "health").collect()
    last = max(r[2] for r in rows if r[1] and r[2] and r[3] not in (None, "timeout")) - dt.timedelta(days=2)
    last = last.replace(microsecond=last.microsecond // 1000 * 1000)
    got = sorted((r.k, r.at, r.status, r.strikes) for r in out)
    assert got == [x for x in walk(rows, last, cool)[0] if x[1] > cut]
    assert {x[2] for x in got} == {"dead", "retest", "alive"} and any(x[0] == "quiet" and x[2] == "retest" for x in got)
