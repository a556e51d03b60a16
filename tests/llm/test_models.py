import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from almanack.llm import decontam, langid, toxicity
from almanack.llm import textbytes as tb

DOCS = "doc_id long, text string, lang string, score string"


def test_gradients_through_time():
    rng = np.random.default_rng(1)
    m = langid.BiGRU(3, 4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    data, size, label = rng.integers(97, 102, (6, 5)).astype(np.uint8), np.array([6, 5, 4, 3, 1]), np.array([0, 1, 2, 1, 0])
    _, g = m.gradients(data, size, label)
    for k in m.p:
        at = (98, 3) if k[0] == "x" else tuple(rng.integers(0, s) for s in m.p[k].shape)
        old, e = m.p[k][at], 1e-5
        m.p[k][at] = old + e
        a, _ = m.gradients(data, size, label)
        m.p[k][at] = old - e
        b, _ = m.gradients(data, size, label)
        m.p[k][at] = old
        assert abs(g[k][at] - (a - b) / 2 / e) < 1e-7


def words(lang, n, rng):
    stems = {"aa": ["tion", "the", "ing", "and"], "bb": ["ción", "que", "ños", "las"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(0)
    rows = [(i, words("aa" if i % 2 else "bb", rng.randint(5, 40), rng), "aa" if i % 2 else "bb", "s") for i in range(120)]
    odd = [(900, None, "aa", "s"), (901, "", None, "s"), (902, "123 !!! 45", "aa", "s"), (903, "１２３ —", "bb", "s"), (904, "x" * 3000, None, "s"), (None, "the and", None, "s")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    learn = langid.bucket() % 4 != 2
    names, model = langid.train(docs, learn)
    got = {r.doc_id: r for r in langid.label(docs, names, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903))
    assert got[904].lang_pred in names and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep(docs, names, model, 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} | {904, None}
    none, blank = langid.train(docs.limit(0), learn)
    assert {r.lang_pred for r in langid.label(docs, none, blank, carry=["doc_id"]).collect()} == {"und"}
    assert langid.label(docs.limit(0), names, model).count() == 0


def one_by_one(model, text, window, context):
    """A text's mean probabilities, one byte after the other in plain Python."""
    cell = lambda d, h, c: (lambda x, u: (lambda z, r: (lambda new: new + z * (h - new))(np.tanh(x[2 * n :] + r * u[2 * n :])))(*np.split(1 / (1 + np.exp(-(x[: 2 * n] + u[: 2 * n]))), 2)))(model.p["x" + d][c], h @ model.p["u" + d] + model.p["q" + d])
    n, found = model.hidden, []
    for first in range(0, len(text), window):
        last = min(first + window, len(text))
        some = text[max(0, first - context) : last + context]
        states = {}
        for d, order in (("f", range(len(some))), ("b", range(len(some) - 1, -1, -1))):
            h = np.zeros(n)
            for i in order:
                states[d, i] = h = cell(d, h, some[i])
        for i in range(first - max(0, first - context), last - max(0, first - context)):
            e = np.exp(states["f", i] @ model.p["vf"] + states["b", i] @ model.p["vb"] + model.p["c"])
            found.append(e / e.sum())
    return np.mean(found, 0)


def test_every_byte_is_labelled_and_pooled(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 10)
    monkeypatch.setattr(langid, "CONTEXT", 3)
    monkeypatch.setattr(langid, "LANES", 4)
    m = langid.BiGRU(3, 4, seed=2)
    texts = [b"a, b 12", b"x" * 10, b"", b"the words of a text, of 47 bytes and some marks", "né à".encode(), b"y"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.pooled(m, np.frombuffer(b"".join(texts), np.uint8), off)
    for t, p in zip(texts, got):
        assert np.allclose(p, one_by_one(m, t, 10, 3) if t else 0, atol=1e-5)


def test_pieces_reach_from_beginning_to_end():
    assert langid.pieces(pa.array(["ABcdefgh", "", None, "ab"]), 3, 4) == [[b"abcd", b"efgh"], [], [], [b"ab"]]
    assert langid.pieces(pa.array(["abcdefghijklmnop"]), 3, 4) == [[b"abcd", b"ghij", b"mnop"]]


def test_repeated_rows_ties_and_long_texts(spark):
    rows = [(7, "the and " * 5, "aa", "s")] * 3 + [(8, "que las " * 5, "bb", "s")] * 2 + [(9, "the and ing " * 90_000, "aa", "s"), (10, "que " * 9, "bb", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    assert langid.sample(docs, F.lit(True)).count() == 4
    names, model = langid.train(docs, F.lit(True))
    got = langid.label(docs, names, model, carry=["doc_id"]).collect()
    assert len(got) == 7 and all(len({(r.lang_pred, r.score) for r in got if r.doc_id == i}) == 1 for i in (7, 8))
    assert next(r.lang_pred for r in got if r.doc_id == 9) == "aa"
    even = langid.BiGRU(2)
    even.p = {k: v * 0 for k, v in even.p.items()}
    assert {r.lang_pred for r in langid.label(docs, ["p", "q"], even, carry=["doc_id"]).collect()} == {"p"}


def test_toxicity(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 60))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vile", "Awful"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "vile " * 5000, "en", "s"), (None, "w1", None, "s")]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    fold = toxicity.bucket() % 5
    w = toxicity.train(docs, lab, fold != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, w).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    assert got[902] >= 0.5 and got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert len(w[0]) < 2000  # sparse
    nothing = toxicity.train(docs, lab.limit(0), fold != 0)
    assert max(r.score for r in toxicity.score(docs, nothing).collect()) < 0.5
    assert toxicity.score(docs.limit(0), w).count() == 0


def test_ftrl_is_the_plain_recurrence():
    """One coordinate after the other, in plain Python."""
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(16), rng.randint(0, 6))), np.int64), rng.randint(0, 1)) for _ in range(60)]
    model = toxicity.FTRL(4, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        l1 = 0 if i == 16 else 0.3
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.1)

    for at, y in rows:
        model.learn(at, y)
        some = {i: weight(i) for i in [*at.tolist(), 16]}
        g = 1 / (1 + math.exp(-sum(some.values()))) - y
        for i, w in some.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(17)])


def test_repeated_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a vile b", "en", "s")] * 3 + [(2, "a b c", "en", "s")] * 2, DOCS)
    lab = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.places(toxicity.sample(docs, lab, F.lit(True))).collect()
    assert sorted((r.doc_id, r.toxic) for r in rows) == [(1, 1), (2, 0)]
    assert toxicity.shift(np.array([3.0, 1.0, -1.0]), np.array([1, 1, 0])) == 0.0 and toxicity.shift(np.array([3.0, 1.0, -1.0]), np.array([1, 0, 0])) == -2.0


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, window):
    phrases = {}
    for item, t in items:
        w = words_of(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for d in docs:
        w, hit, found = words_of(d[1]), set(), set()
        for p, owners in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= owners
        out.append((d[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(0)
    some = lambda n: [rng.choice(["a", "B", "cé", "d1", "e"]) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([0, 2, 3, 5, 9])))) for i in range(12)] + [(3, "a a a a"), (None, "e e"), (40, None)]
    docs = [(i, ", ".join(some(rng.choice([0, 1, 4, 30, 200])) + [f"x{i}"] * rng.randrange(3)), "en", "s") for i in range(80)] + [(900, None, None, "s"), (901, "", None, "s"), (902, items[4][1] or "a b", None, "s"), (None, "e e e", None, "s")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.BENCHMARK_BYTES, 20):  # the second: many blocks
        monkeypatch.setattr(decontam, "BENCHMARK_BYTES", size)
        got = decontam.mark(df, bench, carry=["doc_id"], window=4)
        assert sorted(map(tuple, got.drop("spans").collect()), key=str) == brute(docs, items, 4)
    kept = decontam.keep(df, bench, window=4)
    assert kept.columns == df.columns and kept.count() == sum(not r[5] for r in brute(docs, items, 4))
    text = {d[0]: d[1] for d in docs}
    for r in got.collect():
        inside = sum(len(words_of((text[r.doc_id] or "").encode()[s.begin : s.end].decode())) for s in r.spans)
        assert inside == r.n_hit
    assert decontam.mark(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.mark(df.limit(0), bench).count() == 0


def test_fm_index_ranks():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 11, 300)
    w = decontam.WaveletMatrix(s, 10)
    c, at = rng.integers(0, 11, 200), rng.integers(0, 301, 200)
    assert w.rank(c, at).tolist() == [int((s[:i] == x).sum()) for x, i in zip(c, at)]


def test_edited_copies_are_located():
    """Copies share the words before a phrase and all of it but the last word, at all eight alignments."""
    phrase = [f"p{i}" for i in range(13)]
    for shift in range(8):
        for tails in itertools.permutations(["p12", "q", "r"]):
            before = [f"w{i}" for i in range(7)]
            texts = [" ".join([f"w{j % 7}" for j in range(shift)] * (i == 0) + before + phrase[:12] + [tail] + after.split()) for i, (tail, after) in enumerate(zip(tails, ["w1 w2", "w3 q", "r w4"]))]
            one = decontam.Phrases([("x", " ".join(phrase)), ("words", " ".join([*before, "q", "r"]))])
            words = tb.Words(pa.array(texts, pa.large_string()))
            hit, pairs = one.hits(words)
            held = [i for i, tail in enumerate(tails) if tail == "p12"]
            assert [(int(p) // len(one.names), one.names[p % len(one.names)]) for p in pairs] == [(i, "x") for i in held]
            at = words.of[held[0]] + shift * (held[0] == 0) + 7
            assert np.flatnonzero(hit).tolist() == list(range(at, at + 13))


def test_suffixes_are_sorted_to_the_end_of_their_runs():
    rng = np.random.default_rng(2)
    run = rng.integers(1, 4, 60)
    text = np.concatenate([run, [0], run[5:], [1, 0], run[:40], [2, 0], run, [0]])
    nth = np.cumsum(text == 0)
    key = lambda i: [(int(s), int(n) if s == 0 else 0) for s, n in zip(text[i:], nth[i:])]
    assert decontam.suffix_array(text).tolist() == sorted(range(len(text)), key=key)
    index = decontam.FMIndex(text, 3)
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))


def test_labels_bucket(spark):
    got = spark.createDataFrame([(12,)], "doc_id long").select(toxicity.bucket(), F.lit(1)).first()[0]
    assert got == zlib.crc32(b"12")


def test_every_language_is_learnt(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", f"l{i % 70}", "s") for i in range(700)], DOCS)
    rows = langid.sample(docs, F.lit(True), per_language=4, languages=20).collect()
    assert len({r.lang for r in rows}) == len(rows) == 70
    assert len(langid.sample(docs, F.lit(True), per_language=4, languages=70).collect()) == 280
