"""Rules of any number: joined and array-borne tables give the same."""

import random
import re

import pytest

from almanack.operators import enrich, phrases, relational, stats


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def some_texts(n=80):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["ab", "Cd", "é", "f9", "the"]) + rng.choice([" ", ", ", "-", "! "]).strip() for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return [*texts, (500, None), (501, ""), (502, "  !! "), (503, "the " * 3000 + "end of it"), (None, "the end"), (504, "ab cd é f9 the end of it all")]


def test_found_phrases_equals_brute_force(spark):
    rules = ["the", "ab cd", "AB,  cd!", "the end", "end of it", "ab cd é f9 the end of it all", "ab cd é f9 the end of it not", "the the the the the the", "nowhere", "", None, "!!"]
    rng = random.Random(4)
    rules += [" ".join(rng.choice(["ab", "cd", "é", "f9", "the"]) for _ in range(rng.randint(1, 7))) for _ in range(150)]
    texts = some_texts()
    want = {(i, r) for i, t in texts for r in rules if words(r) and i is not None and f" {' '.join(words(r))} " in f" {' '.join(words(t))} "}
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "k long, t string, name string, size int")
    got = phrases.found_phrases(df, "k", "t", spark.createDataFrame([(r,) for r in rules], "rule string"), "rule").filter("k IS NOT NULL").collect()
    assert {(r.k, r.rule) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("n", [0, 1])
def test_no_rules_or_no_texts(spark, n):
    df = spark.createDataFrame(some_texts()[: 5 * n], "k long, t string")
    rules = spark.createDataFrame([("ab",)][: 1 - n], "rule string")
    assert phrases.found_phrases(df, "k", "t", rules, "rule").count() == phrases.found_needles(df, "k", "t", rules, "rule").count() == 0


def test_tables_of_rules_of_both_sizes_agree(spark, monkeypatch):
    texts = spark.createDataFrame([r for r in some_texts() if r[0] is not None], "k long, t string")
    rng = random.Random(5)
    needles = ["the", "b,", "é", "", "end of it all", "zzz", "he the the t"] + ["".join(rng.choice("abCd é,f9the") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rules = spark.createDataFrame([(r, rng.randint(-3, 90), f"v{i}", f"n{i}", i % 3) for i, r in enumerate(dict.fromkeys(needles))], "needle string, w int, v string, name string, least int")

    def results():
        return [
            sorted((r.k, r.hit) for r in relational.contains_max(texts, "k", "t", rules, "needle", "w", "hit").collect()),
            sorted((r.k, r.needle, r.v) for r in enrich.longest_match(texts, "k", "t", rules, "needle", "v").collect()),
            sorted(map(tuple, stats.must_surface(texts, ["t"], rules).collect())),
        ]

    few = results()
    monkeypatch.setattr(relational, "RULES", 3)
    assert results() == few and any(h for _, h in few[0]) and few[1]


def test_most_parts_that_no_rule_has_are_held_back_before_the_shuffle(spark):
    rules = [(f"w{i} w{i + 1}" + " tail of manymany words" * (i % 2), i) for i in range(1000)]
    parts = spark.createDataFrame([(k, f"w{i} w{i + 1 + k}") for k in range(5) for i in range(1000)], "k long, anchor string")
    anchors = spark.createDataFrame([(r[0],) for r in rules if r[1] % 2 == 0], "anchor string")
    got = [tuple(r) for r in phrases._sieved(parts, anchors, 500).collect()]
    assert {a for k, a in got if k == 0} >= {r[0] for r in rules if r[1] % 2 == 0} and 500 <= len(got) < 1500
    texts = spark.createDataFrame([(i, f"W{i}, w{i + 1}; tail of manymany words") for i in range(1, 1000, 10)], "k long, t string")
    found = phrases.found_phrases(texts, "k", "t", spark.createDataFrame(rules, "rule string, w int"), "rule", carry=("w",)).collect()
    assert sorted(tuple(r) for r in found) == [(i, *rules[i]) for i in range(1, 1000, 10)]
    anchors = {r.name: r.anchor for r in phrases._long_anchors(spark.createDataFrame([(r[0],) for r in rules if r[1] % 2], "name string")).collect()}
    assert len(set(anchors.values())) == 500  # the longest part is common to all: others stand for the names
