"""Top-k similarity and hash neighbours: equal to all pairs, with rows that grow with the input."""

import random

import pytest

from almanack.operators import communities

PROFILE = "k long, categories array<string>, hoods array<string>, cadence string, c long, m long, cats string"


def brute(rows, k):
    def part(x, y, w):
        x, y = ({v for v in s or [] if v is not None} for s in (x, y))
        return len(x & y) * w // len(x | y) if x | y else 0

    out = []
    for a, ca, ha, wa in rows:
        found = sorted((-(part(ca, cb, 500) + part(ha, hb, 200) + (150 if wa and wa == wb else 0)), b) for b, cb, hb, wb in rows if b != a)
        out += [(a, b, -s, i) for i, (s, b) in enumerate(found[:k], 1) if s < 0]
    return sorted(out)


def profiles(n, seed, vocabulary, many):
    rng = random.Random(seed)
    pick = lambda v: [f"v{int(v * rng.random() ** 2)}" for _ in range(rng.randint(0, many))]
    return [(i, pick(vocabulary), pick(vocabulary), rng.choice(["weekly", "monthly", "once", None, ""])) for i in range(n)]


@pytest.mark.parametrize("n, vocabulary, many", [(150, 12, 5), (150, 400, 3), (120, 3, 2)])
def test_most_similar_equals_all_pairs(spark, n, vocabulary, many):
    rows = profiles(n, 5, vocabulary, many) + [(1000, None, None, None), (1001, [None, "v1", "v1"], [], "once"), (1002, [], [], "weekly")]
    rows += [(2000 + i, ["v0", "v1"], ["v2"], "weekly") for i in range(12)]
    got = communities.most_similar(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], PROFILE), "k", 4).collect()
    assert sorted((r.a, r.b, r.similarity, r["rank"]) for r in got) == brute(rows, 4)


def test_most_similar_of_none(spark):
    assert communities.most_similar(spark.createDataFrame([], PROFILE), "k").count() == 0


def test_rows_met_grow_with_the_communities(spark, monkeypatch):
    """Profiles over a vocabulary that grows with them, as places do: all candidates of all levels, and what all pairs would be."""
    counted, candidates = [], communities._candidates

    def noted(*args):
        found = candidates(*args)
        counted[-1] += found.count()
        return found

    monkeypatch.setattr(communities, "_candidates", noted)
    for n in (200, 400, 800):
        counted.append(0)
        rng = random.Random(n)
        pick = lambda: [f"v{rng.randrange(n)}" for _ in range(4)]
        base = [(pick(), pick(), rng.choice(["weekly", "monthly"])) for _ in range(n // 10)]
        rows = []
        for i in range(n):
            cats, hoods, cadence = rng.choice(base)
            rows.append((i, cats[: rng.randint(2, 4)] + [f"v{rng.randrange(n)}"], hoods, cadence))
        communities.most_similar(spark.createDataFrame(rows, "k long, categories array<string>, hoods array<string>, cadence string"), "k", 4).collect()
    assert counted[2] < 2.6 * counted[1] < 2.6 * 2.6 * counted[0] and counted[2] < 0.1 * 800 * 800
