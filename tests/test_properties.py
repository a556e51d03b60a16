from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanack.operators import rank, resolve

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xy"), st.integers(0, 1000)), min_size=1, max_size=25)


@few
@given(rows)
def test_diversity_keeps_survivors_at_the_floor(spark, found):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "k long, s string, t string, score long")
    after = {r.k: r.score for r in rank.diversify(df, "score", "s", "t", "k", F.lit(350)).collect()}
    for i, (_, _, before) in enumerate(found):
        assert after[i] <= before
        assert before < 350 or after[i] >= 350


@few
@given(rows)
def test_merge_is_idempotent_and_ignores_row_order(spark, found):
    listed = [(f"{s}{t}", i, v) for i, (s, t, v) in enumerate(found)]
    schema = "key string, event_id long, value long"
    how = {"event_id": "least", "value": "most"}
    once = resolve.merge(spark.createDataFrame(listed, schema), "key", "event_id", "event_id", how).select("key", "event_id", "value")
    want = sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, resolve.merge(once, "key", "event_id", "event_id", how).select("key", "event_id", "value").collect())) == want
    back = resolve.merge(spark.createDataFrame(listed[::-1], schema), "key", "event_id", "event_id", how).select("key", "event_id", "value")
    assert sorted(map(tuple, back.collect())) == want


@few
@given(st.lists(st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "ee", "ff"]), min_size=1, max_size=5, unique=True), min_size=2, max_size=12))
def test_prefix_filter_loses_no_pair(spark, sets):
    df = spark.createDataFrame([(i, "v", s) for i, s in enumerate(sets)], "k long, v string, t array<string>")
    got = {(r.a, r.b) for r in resolve.similar_pairs(df, "k", ["v"], "t", 0.5, 1).collect()}
    heads = {}
    for i, s in enumerate(sets):
        heads.setdefault(tuple(sorted(s)), i)
    want = {(heads[tuple(sorted(s))], i) for i, s in enumerate(sets) if heads[tuple(sorted(s))] != i}
    reps = [(i, set(s)) for s, i in heads.items()]
    want |= {(min(i, j), max(i, j)) for i, a in reps for j, b in reps if i != j and 2 * len(a & b) >= len(a | b) and a & b}
    assert got == want
