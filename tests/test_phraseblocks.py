"""Counted rules by blocks and buckets: brute force, equal hashes, and what is shuffled."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from almanack.operators import phraseblocks as pb
from almanack.plans import registry

SPELL = ["ab", "Cd", "é", "f9", "the", "ＡＢ", "Ünd", "數", "x" * 70]


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(texts, rules):
    found = {}
    for key, text in texts:
        w = words(text)
        found.setdefault(key, set()).update(r for r in rules if f" {r} " in f" {' '.join(w)} ")
    return sorted((k, len(rs), max(rules[r] for r in rs), min((-rules[r], r.encode()) for r in rs)[1].decode()) for k, rs in found.items() if rs)


def runs_of(texts, sizes):
    out = {}
    for _, t in texts:
        w = words(t)
        for n in sizes:
            for i in range(len(w) - n + 1):
                run = " ".join(w[i : i + n])
                out[run] = out.get(run, 0) + 1
    return out


def some(seed, n=120):
    rng = random.Random(seed)
    texts = [(i, "".join(rng.choice(SPELL) + rng.choice([" ", ", ", "-", "! ", "\n"]) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    texts += [(500, None), (501, ""), (502, "  !! "), (503, "the " * 3000 + "end of it"), (504, "ab cd é f9 the end of it all"), (3, "the end of it"), (3, None)]
    names = {" ".join(words(" ".join(rng.choice(SPELL) for _ in range(rng.randint(1, 7))))) for _ in range(200)} | {"end of it", "the", "the the the the the the"}
    return texts, {r: rng.choice([-5, 0, 7, 7, 7, 2**40]) for r in sorted(names)}


@pytest.mark.parametrize("small", [False, True])
def test_counted_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and buckets
        for name, value in (("BLOCK", 300), ("RULES", 9), ("TEXT", 500)):
            monkeypatch.setattr(pb, name, value)
    texts, rules = some(small)
    df = spark.createDataFrame([*texts, (None, "the end of it")], "k long, t string")
    table = spark.createDataFrame([*rules.items(), ("", 9), (None, 9), ("AB, cd", 9), (" ab", 9)], "rule string, w long")
    got = pb.counted(df, "k", "t", table, "rule", "w")
    rows = [tuple(r) for r in got.collect()]
    want = brute(texts, rules)
    assert got.columns == ["k", "n_rules", "weight", "rule"] and sorted(r for r in rows if r[0] is not None) == want
    assert [r[1:] for r in rows if r[0] is None] == [r[1:] for r in brute([(0, "the end of it")], rules)]


@pytest.mark.parametrize("texts, rules", [([], [("ab", 1)]), ([("a", "ab")], []), ([("a", "ab"), ("b", "cd cd"), ("c", None)], [("ab", 1)])])
def test_few_or_none(spark, texts, rules):
    got = pb.counted(spark.createDataFrame(texts, "k string, t string"), "k", "t", spark.createDataFrame(rules, "rule string, w long"), "rule", "w")
    assert [tuple(r) for r in got.collect()] == ([("a", 1, 1, "ab")] if texts and rules else [])


def test_runs_of_one_hash_are_told_apart_by_their_characters(monkeypatch):
    monkeypatch.setattr(pb, "_mix", lambda x: x & np.uint64(3))
    texts, rules = some(5)
    rows = [(k, " ".join(words(t))) for k, t in texts if words(t)]
    random.Random(1).shuffle(rows)
    sieves, bits, sizes = [np.full(1 << 13, 255, np.uint8)] * 2, 1, sorted({len(r.split()) for r in rules})
    dealt = pa.Table.from_batches(pb._dealt(bits)([pa.RecordBatch.from_arrays([pa.array(rules), pa.array(rules.values(), pa.int64())], ["name", "weight"])]))
    runs = pb._Runs(pa.array(t for _, t in reversed(rows)), sieves, sizes)
    cuts = runs.cuts(bits)
    sent = pa.table([pa.array([0, 1], pa.int32()), pa.array([0, 0], pa.int32()), pa.array([pb._pack_names(runs.spell(cuts[b], cuts[b + 1])) if cuts[b] < cuts[b + 1] else b"" for b in (0, 1)])], ["bucket", "block", "names"])
    found = pa.concat_tables(pb._met(dealt.filter(pc.equal(dealt["bucket"], b)), sent.slice(b, 1)) for b in (0, 1) if cuts[b] < cuts[b + 1])
    got = pb._counted(pa.array(k for k, _ in rows), pa.array(t for _, t in rows), found, sieves, sizes, bits)
    assert sorted(zip(*(x.to_pylist() for x in got), strict=True)) == brute(rows, rules)


def shuffled(spark, frame):
    """Rows of the shuffles that a step and its frame write."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList()))}
    before = stages()
    rows = frame().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return len(rows), sum(n for k, n in stages().items() if k not in before)


def test_rows_shuffled_by_phrase_rules_do_not_grow_with_copies_of_texts(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(n))
    docs = [text(60) for _ in range(50)]
    spark.createDataFrame([(i, j, text(20)) for i in range(30) for j in range(3)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "1/conversations.parquet"))
    spark.read.parquet(str(tmp_path / "1/conversations.parquet")).write.parquet(str(tmp_path / "20/conversations.parquet"))
    for n in (1, 20):
        spark.createDataFrame([(i + 50 * k, d) for k in range(n) for i, d in enumerate(docs)], "doc_id long, text string").write.parquet(str(tmp_path / f"{n}/documents.parquet"))
    (n1, one), (n20, twenty) = (shuffled(spark, lambda n=n: registry.QUERIES["phrase_rules"](spark, str(tmp_path / str(n)))) for n in (1, 20))
    assert n20 == 20 * n1 > 0 and twenty < 1.2 * one + 100


@pytest.mark.parametrize("n", [0, 1, 120])
def test_runs_said_equal_brute_force(spark, n):
    texts = some(7, n)[0] if n > 1 else [(1, "ab")] * n
    got = pb.said(spark.createDataFrame(texts, "k long, t string"), "t", (1, 2, 3, 6)).collect()
    assert {r.phrase: r.weight for r in got} == runs_of(texts, (1, 2, 3, 6)) and len(got) == len({r.phrase for r in got})


def test_runs_said_in_several_chunks(monkeypatch):
    monkeypatch.setattr(pb, "CHUNK", 100)
    texts = [t for t in (" ".join(words(t)) for _, t in some(8)[0]) if t]
    batches = pa.table([pa.array(texts)], ["text"]).to_batches(max_chunksize=50)
    got = pb._summed(pa.Table.from_batches(list(pb._said(2, (1, 2, 6))(batches)))).to_pydict()
    assert dict(zip(got["phrase"], got["weight"], strict=True)) == runs_of([(0, t) for t in texts], (1, 2, 6))
