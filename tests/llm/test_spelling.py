import random
import re
import zlib

import pytest

from almanack.llm import spelling as sp

SCHEMA = "doc_id long, text string, lang string, word string, n long, key long, short int, form string, root string"


def brute(rows, length=5, times=3, thin=97):
    low, counts = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % thin == 0 else w
            counts[w] = counts.get(w, 0) + 1
    n = {w: k for w, k in counts.items() if len(w) >= length and k >= times}
    shorter = lambda w: [w[:i] + w[i + 1 :] for i in range(len(w))]

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and a in shorter(b)

    near = {w: [x for x in n if x != w and is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def some_rows(n=120, seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéxÿ") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "ababab", "station", "Stationen"]

    def wrong(w):
        k, i = rng.randrange(4), rng.randrange(len(w))
        return w if k == 3 else w[:i] + (rng.choice("abé") if k else "") + w[i + (k < 2) :]

    rows = []
    for i in range(n):
        picked = [rng.choice(base[: rng.choice([4, 12, 29])]) for _ in range(40)]
        rows.append((i, rng.choice([" ", "-", "1"]).join(wrong(w) if rng.random() < 0.4 else w.upper() if rng.random() < 0.1 else w for w in picked), "en"))
    long = "".join(rng.choice("abcxyz") for _ in range(3000))
    rows += [(500 + i, " ".join([long, long[:-1], long[:100] + long[101:], "Ünder", "ünder", "Straße", "×÷×÷×"]), "de") for i in range(4)]
    return rows + [(600, None, None), (601, "", "en"), (None, "station station station", None), (None, "station", None), (601, "again again again again", "en"), (601, "again again again again", "en")]


@pytest.mark.parametrize("hot, thin", [(sp.HOT, 97), (6, 7), (1, 3)])
def test_equals_brute_force(spark, hot, thin):
    """The second and third case: keys that are cut, down to single letters, and many words without a letter."""
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3, "f", "r") for r in rows], SCHEMA).repartition(5)
    got = sp.variants(docs, thin=thin, hot=hot).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str) == brute(rows, thin=thin)


def test_a_task_counts_in_a_bounded_table(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD", 5)
    rows = some_rows(30)
    got = sp.variants(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("part", [1, 24, 10_000])
def test_near_in_finds_every_pair(monkeypatch, part):
    monkeypatch.setattr(sp, "PART", part)
    rng = random.Random(1)
    for letters, size in (("ab", 7), ("abcdefgh", 14), ("aé", 30)):
        some = {"".join(rng.choice(letters) for _ in range(size + rng.randrange(2))).encode("latin-1") for _ in range(200)}
        some |= {w[:3] + w[4:] for w in some if len(w) > size} | {w[:5] + b"a" + w[6:] for w in some}
        want = {frozenset((a, b)) for a in some for b in some if len(a) == size and len(a) <= len(b) and sp.one_edit(a, b)}
        assert {frozenset(p) for p in sp.near_in(list(some), size)} == want and want


def test_one_edit():
    rng = random.Random(0)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))).encode() for _ in range(2))
        a, b = sorted((a, b), key=len)
        want = sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
        assert sp.one_edit(a, b) == want


def test_rows_written_for_a_hot_gram_grow_with_the_words(spark):
    rng, made = random.Random(6), []
    for n in (200, 400, 800):
        words = sorted({"qqq" + "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)})
        rows = sp.postings(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 5)
        cut = sp.cut(sp.cut(rows, 2), 8)
        made.append((rows.count() / len(words), cut.count() / len(words)))
    assert max(a for a, _ in made) <= 12 and max(b for _, b in made) <= 12 * 2 * 8


def test_empty_table(spark):
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
