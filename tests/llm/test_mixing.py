import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from almanack.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, weight string, bin string, target string, words string"


def u(i, text):
    name = f"{'' if i is None else i}:{text or ''}"
    return (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_targets(sizes, cap=3):
    """By rounds: who is above the cap stops there, and the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = Fraction(total - sum(cap * sizes[s] for s in stopped))
        open_ = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return {s: float(share[s]) if s in share else float(cap * sizes[s]) for s in names}
        stopped |= above


def brute(rows, weights):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets, out = brute_targets(sizes), []
    for s in sizes:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: -math.log(u(r[0], r[1])) / weights.get(r[0], 1))
        budget = round(targets[s])
        epochs = budget // sizes[s] if sizes[s] else 0
        left = budget - epochs * sizes[s]
        for i, t, _ in mine:
            more = min(size(t), left)
            left -= more
            out.append((i, size(t), sizes[s], round(targets[s], 6), epochs * size(t) + more))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 80]))), f"s{i % 7}") for i in range(150)]
    rows += [(200 + i, "a b\tc\x0bd e", "few") for i in range(2)]
    return rows + [(300, None, "empty"), (301, "  \n", "empty"), (302, "one", None), (None, " two words ", None), (None, " two words ", None), (5, "again é", "s1"), (400, "x " * 3000, "s3")]


@pytest.mark.parametrize("bins", [1, 5, mixing.BINS])
def test_equals_brute_force(spark, bins):
    rows = some_rows()
    weights = {i: [2.0, 0.5, 1.0][i % 3] for i in range(0, 150, 2)}
    known = spark.createDataFrame([*weights.items(), (0, 0.1), (None, 9.0), (7, None), (9, -1.0)], "doc_id long, weight double")
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)
    got = mixing.mix(docs, known, bins=bins).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows, weights)
    again = mixing.mix(docs.repartition(5), known, bins=bins).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_targets_are_met_and_no_document_is_taken_too_often(spark):
    docs = spark.createDataFrame([(i, t, s) for i, t, s in some_rows()], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken = {}
    for r in rows:
        assert r.epochs * r.size <= r.taken <= min(r.epochs + 1, 3) * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in rows:
        assert abs(taken[r.source] - r.target) <= 0.5
    assert taken["few"] == 3 * 8 and taken["empty"] == 0


def test_heavier_documents_are_taken_first(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'w w' AS text", "if(id < 2000, 'a', if(id < 2500, 'b', 'c')) AS source")
    weights = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    rows = mixing.mix(docs, weights).filter("source = 'a'").collect()
    share = [sum(r.taken for r in rows if r.doc_id % 2 == k) / sum(r.size for r in rows if r.doc_id % 2 == k) for k in (0, 1)]
    assert rows[0].epochs == 0 and share[0] > 1.8 * share[1]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    assert mixing.mix(none, mixing.quality(spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_one_source_without_words(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_only_data_frame_functions_run(spark):
    docs = spark.createDataFrame(some_rows(), "doc_id long, text string, source string")
    plan = mixing.mix(docs, mixing.quality(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
