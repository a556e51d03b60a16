"""What is kept from run to run and added to: components, sketches, joins of streams."""

import datetime as dt
import random

import pytest

from almanack.operators import graph, sketches
from almanack.plans import registry
from almanack.streaming import windows


def brute(edges, rank):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g, key=lambda y: (y not in rank, rank.get(y, 0), y)) for g in groups.values() for x in g}


@pytest.mark.parametrize("ranked", [False, True])
def test_runs_equal_one_over_all_edges(spark, ranked):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(5, 5), (7, 8), (7, 8)]
    rank = {x: (x * 37) % 121 for x in range(118)} if ranked else {x: x for x in range(120)}  # 118 and 119 have none
    ranks = spark.createDataFrame(list(rank.items()), "node long, rank long") if ranked else None
    known = spark.createDataFrame([], "node long, root long")
    for i in range(3):
        part = spark.createDataFrame(edges[i::3], "a long, b long")
        before = {r.node: r.root for r in known.collect()}
        known = spark.createDataFrame(graph.extend(known, part, ranks).collect(), "node long, root long")
        after = {r.node: r.root for r in known.collect()}
        met = {before.get(x, x) for e in edges[i::3] for x in e}
        assert all(after[n] == r for n, r in before.items() if r not in met)  # what no new edge touches stays
    assert after == brute(edges, rank)


def test_no_new_edges(spark):
    known = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    none = spark.createDataFrame([], "a long, b long")
    assert sorted(map(tuple, graph.extend(known, none).collect())) == [(1, 1), (2, 1)]


def test_merged_sketches_are_as_good_as_one(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 2}", i % 5, rng.choice([0, 1, rng.randrange(3000)]), rng.gauss(0, 1)) for i in range(20_000)] + [("none", 0, None, None)]
    df = spark.createDataFrame(rows, "source string, run int, who long, value double")
    kept = sketches.sketched(df, ["source", "run"], "who", "value")
    once = {r.source: r for r in sketches.merged(kept, ["source"]).select("source", "n", sketches.distinct().alias("d"), sketches.quantile(0.25).alias("q")).collect()}
    twice = sketches.merged(sketches.merged(kept, ["source", "run"]), ["source"])
    again = {r.source: r for r in twice.select("source", "n", sketches.distinct().alias("d")).collect()}
    tops = {r.source: r.top for r in sketches.frequent(kept, ["source"], 2).collect()}
    for s in ("s0", "s1"):
        mine = [r for r in rows if r[0] == s]
        users, values = {r[2] for r in mine}, sorted(r[3] for r in mine)
        assert once[s].n == again[s].n == len(mine) and abs(once[s].d - len(users)) <= sketches.ERROR * len(users) and once[s].d == again[s].d
        assert abs(sum(v <= once[s].q for v in values) / len(values) - 0.25) <= sketches.ERROR
        assert {t["item"] for t in tops[s]} == {0, 1} and all(abs(t["count"] - sum(r[2] == t["item"] for r in mine)) <= len(mine) / sketches.ITEMS for t in tops[s])
    assert (once["none"].n, once["none"].d, once["none"].q) == (1, 0, None)


def test_followed_in_a_batch(spark):
    rng = random.Random(4)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(900))
    a, b = ([(i, rng.choice([1, 2, None]), rng.choice([at(), None])) for i in range(80)] for _ in range(2))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and x[2] and y[2] and x[2] < y[2] <= x[2] + dt.timedelta(minutes=30))
    left, right = (spark.createDataFrame(r, "id long, k long, ts timestamp") for r in (a, b))
    assert sorted((r.id, r.then_id) for r in windows.followed(left, right, "k", 30).collect()) == want and want


def test_stored_sketches_where_nobody_is_frequent(spark, tmp_path):
    """As many users as rows: none is sure to be frequent, and none needs to be. Beside them, a user just above 1/ITEMS of many is found."""
    rows = [(i, dt.datetime(2024, 1, 1 + i % 9), i, "even", float(i % 50), None) for i in range(12000)]
    rows += [(i, dt.datetime(2024, 1, 1 + i % 9), None if i % 7 == 0 else -1 if i % 400 == 1 else i, "one", float(i % 50), None) for i in range(12000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in registry.QUERIES["stored_sketches"](spark, str(tmp_path)).collect()}
    assert got == {("even", 12000, 12000, True, True, True), ("one", 12000, len({r[2] for r in rows[12000:]} - {None}), True, True, True)}
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    tops = {r.event_type: r.top for r in sketches.frequent(sketches.sketched(df, ["event_type"], "user_id", "value"), ["event_type"], 1).collect()}
    assert [t["item"] for t in tops["one"]] == [-1]


def test_stars_are_contracted_before_the_walk(spark, monkeypatch):
    """Of 4,000 edges to 20 hubs, two runs walk some of each hub and of each root that they meet; a node with a null neighbour stays alone."""
    from almanack.sources import tables

    walked, settle = [], tables.settle
    monkeypatch.setattr(tables, "settle", lambda df, name: (out := settle(df, name), name == "met" and walked.append(out.count()))[0])
    edges = [(100 + i, i % 20) for i in range(4000)] + [(20 + i, i % 7) for i in range(20)]
    rank = {x: -x for x in range(4100)}
    ranks = spark.createDataFrame(list(rank.items()), "node long, rank long")
    known = spark.createDataFrame([], "node long, root long")
    for part in (edges[:2000], edges[2000:] + [(5000, None)]):
        known = spark.createDataFrame(graph.extend(known, spark.createDataFrame(part, "a long, b long"), ranks).filter("node IS NOT NULL").collect(), "node long, root long")
    assert {r.node: r.root for r in known.collect()} == brute(edges, rank) | {5000: 5000}
    assert len(walked) == 2 and max(walked) <= 100
