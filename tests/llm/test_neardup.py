import random

import numpy as np
import pyarrow as pa
import pytest

from almanack.llm import neardup as nd

SCHEMA = "doc_id long, text string, lang string, key string"


def words_of(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(rows):
    def runs(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [runs(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            s = sets[i] | sets[j]
            if (s and 10 * len(sets[i] & sets[j]) >= 8 * len(s)) or (rows[i][1] or "").lower() == (rows[j][1] or "").lower():
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((x, min((y for y in g if y is not None), default=None), len(g)) for g in groups.values() for x in g)


def some_rows(n=120):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                if w:
                    w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((i, " ".join(w), "en", "k"))
        else:
            rows.append((i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 3, 60, 120]))), "en", None))
    return rows + [(500, None, None, None), (501, "", "en", "k"), (502, "one two", "en", "k"), (503, "ONE two!", "en", "k"), (504, "... !", "en", "k")]


@pytest.mark.parametrize("block", [500, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    """The second case: buckets of several cells and blocks. A column named node, and a text of a megabyte with a near copy."""
    monkeypatch.setattr(nd, "BLOCK", block)
    long = " ".join(f"l{i}" for i in range(150_000))
    rows = [*some_rows(), (600, long, "en", "k"), (601, long + " more", "en", "k")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("key", "node")
    got = nd.classes(docs.select("doc_id", "text")).collect() if block == 500 else nd.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == brute(rows[:-2]) + [(600, 600, 2), (601, 600, 2)]
    assert all((r.n_links > 0) == (len({x.node for x in got if x.class_id == r.class_id}) > 1) for r in got)


@pytest.mark.parametrize("block", [500, 3])
def test_words_of_any_length_equal_brute_force(spark, monkeypatch, block):
    """What differs are words of 3 to 300 letters."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng, rows = random.Random(11), []
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for i in range(60):
        base = [word(rng.choice([3, 6, 60, 300])) for _ in range(rng.choice([60, 200]))]
        rows.append((3 * i, " ".join(base), "en", "k"))
        for copy in (1, 2):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 8])):
                w[rng.randrange(len(w))] = word(rng.choice([3, 60, 120, 300]))
            rows.append((3 * i + copy, " ".join(w), "en", "k"))
    got = nd.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == brute(rows)


@pytest.mark.parametrize("letters", [6, 60, 120, 300])
def test_pairs_at_the_threshold_are_not_missed(letters):
    """40 pairs of 400 short words of which 8 differ (a similarity of 0.82) share a band, however long those are."""
    rng, texts = random.Random(letters), []
    for _ in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        v = list(w)
        for k in range(8):
            v[25 + 50 * k] = "".join(rng.choice("abcdefghij") for _ in range(letters))
        texts += [" ".join(w), " ".join(v)]
    keys = nd.band_keys(nd.dart_signatures(*nd.elements(pa.array(texts))))
    assert all((keys[i] == keys[i + 1]).any() for i in range(0, 80, 2))


def test_repeated_lines_do_not_make_texts_alike(spark):
    line = "the same line of words again "
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + " " + line * 60, "en", None) for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert nd.keep(docs).count() == 2
    assert {r.class_size for r in nd.classes(docs, counted=True).collect()} == {2}


def test_keep_has_one_row_of_each_class(spark):
    rows = some_rows(60) + [(7, "seven " * 30, "en", "a"), (7, "seven " * 30, "en", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = nd.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == nd.classes(docs).select("node", "class_id").join(nd.classes(docs).select("node"), "node").select("class_id").distinct().count()


def test_keep_tells_classes_apart_without_ids(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = text("b") + " more"
    rows = [(None, text(f"n{j}x"), "en", None) for j in range(20)] + [(None, text("n3x") + " more", "en", None), (7, text("a"), "en", None), (7, text("b"), "en", None), (9, near, "en", None), (None, text("a"), "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    named = nd.classes(docs).select("class_id", "class_size").distinct().collect()
    assert len(named) == len({r.class_id for r in named}) == 22 and sum(r.class_size for r in named) == len(rows)
    kept = nd.keep(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 20
    assert len({r.text.removesuffix(" more") for r in kept}) == len(kept) == 22
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(7, text("a")), (7, text("b"))]


def test_empty_table(spark):
    assert nd.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 300), rng.uniform(0.2, 4, 300)
    b[:250] = a[:250]
    sig = nd.dart_signatures(np.concatenate([ids, ids]), np.concatenate([a, b]), np.array([0, 300, 600]), 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig != 0).all()
