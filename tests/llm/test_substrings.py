import hashlib
import random

import numpy as np
import pytest

from almanack.llm import substrings as sub

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {}
    for _, t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.choice([8, 15, 40]))) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(shared) if rng.random() < 0.2 else word() for _ in range(rng.randint(0, 30)))
        rows.append((i, t, "en"))
    rows += [(100, "a" * 500, "en"), (101, "xy" * 90, None), (102, None, None), (103, "", "fr"), (104, "b" * 51, "en"), (None, rows[3][1] + "!", "en"), (5, rows[5][1], "en")]
    return rows


@pytest.mark.parametrize("hot, blocks, split", [(4096, 8, 8 << 20), (3, 100, 300), (2, 1, 90)])
def test_equals_brute_force(spark, monkeypatch, hot, blocks, split):
    """The second case: blocks that are merged, and texts in parts; the third: segments cut anew down to windows."""
    monkeypatch.setattr(sub, "HOT", hot)
    monkeypatch.setattr(sub, "BLOCKS", blocks)
    monkeypatch.setattr(sub, "SPLIT", split)
    rows = some_rows(1) + [(200, "-" * 700 + "mid" * 200 + "." * 900, "en"), (201, "q" + "-" * 60 + "mid" * 20, "en"), (202, "ab" * 30 + "cd" * 600, "en")]
    got = sub.digests(spark.createDataFrame(rows, SCHEMA), length=50, gram=20)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


def test_rows_of_a_hot_key_grow_with_the_texts(spark, monkeypatch):
    """A passage in 100, 200 and 400 texts, with keys that are hot from 8 segments on: all rows that are written or dealt to tasks."""
    monkeypatch.setattr(sub, "HOT", 8)
    monkeypatch.setattr(sub, "BLOCKS", 2)
    counted, table, dealt = [], sub.shared.table, sub.dealt

    def noted(df):
        counted[-1] += df.count()
        return df

    monkeypatch.setattr(sub.shared, "table", lambda df, name: noted(table(df, name)))
    monkeypatch.setattr(sub, "dealt", lambda *args: noted(dealt(*args)))
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    texts = ["".join(rng.choice("stuvwxyz ") for _ in range(40)) + passage + "".join(rng.choice("stuvwxyz ") for _ in range(40)) for _ in range(400)]
    for n in (100, 200, 400):
        counted.append(0)
        rows = [(i, t, "en") for i, t in enumerate(texts[:n])]
        got = sub.digests(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 200)
    assert counted[2] < 2.3 * counted[1] < 2.3 * 2.3 * counted[0] and counted[2] < 400 * 200


def test_long_runs_take_seconds(spark):
    """Whole texts of a megabyte and more: one letter, blanks in a text, a counter."""
    lines = "".join(f"line {i:07d} of a long list of lines that differ by their number only\n" for i in range(9000))
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "a" * 5_000_000, "en"), (2, words + " " * 1_500_000 + words[::-1], "en"), (3, lines, "en"), (4, "x" + "a" * 210, "en"), (5, "no " + words[:150], "en")]
    got = {r.doc_id: r for r in sub.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (5_000_000, 1)
    assert (got[2].n_removed, got[2].n_spans) == (1_500_000 + 0, 1) and got[2].kept_sha256 == hashlib.sha256((words + words[::-1]).encode()).hexdigest()
    assert got[3].n_removed == 0 and (got[4].n_removed, got[4].n_spans) == (210, 1) and got[5].n_removed == 0


def test_periodic_stretches():
    rng = random.Random(7)
    for _ in range(40):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        s = bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 60))) + word * (900 // len(word)) + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 60)))
        n = len(s) - 50 + 1
        parts, whole = sub.periodic(s, n, 50, 20)
        seen, kept = set(), [s[a + i : a + i + 50] for a, m in parts for i in range(m)]
        for a, m in parts + whole:
            seen |= set(range(a, a + m))
        assert seen == set(range(n))
        for a, m in whole:
            assert all(s.count(s[i : i + 50]) and kept.count(s[i : i + 50]) >= 2 for i in range(a, a + m))


def test_empty_table(spark):
    assert sub.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(40)] + [b"a" * 70]
    chunk = sub.Chunk(parts, 5)
    ends = chunk.end.tolist()
    key = lambda p: ([b + 10**6 for b in chunk.data[p : ends[p]].tolist()], ends[p])
    want = sorted(range(len(ends)), key=lambda p: [*key(p)[0], ends[p]])
    assert chunk.order.tolist() == want
    lcp = sub.kasai(chunk.data, chunk.order, chunk.rank, chunk.off[:-1], chunk.end)
    for r in range(1, len(want)):
        a, b = (chunk.data[p : ends[p]].tobytes() for p in (want[r - 1], want[r]))
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[r] == n


def test_sliding():
    v = np.random.default_rng(0).integers(0, 50, 37).astype(np.uint64)
    for w in (1, 5, 36, 37, 50):
        assert sub.sliding(v, w, True)[: max(0, 38 - w)].tolist() == [v[i : i + w].min() for i in range(max(0, 38 - w))]
