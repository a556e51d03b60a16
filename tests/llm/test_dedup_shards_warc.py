import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanack.llm import exactdedup, sharding, warc

DOCS = "doc_id long, text string, kept string, h int"


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def some_docs():
    rng = random.Random(0)
    rows = [(i, rng.choice(["Same", "same", "SAME É", "same É", f"t{i}", None, "", "long " * 3000]), "x", i) for i in range(200)]
    return rows + [(777, "tie", "a", 1), (777, "tie", "b", 2), (None, "t1", "c", 3), (None, "only nulls", "d", 4)]


@pytest.mark.parametrize("budget", [exactdedup.BUDGET, 3000])
def test_exact_dedup(spark, budget):
    rows = some_docs()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = exactdedup.mark(df, budget).select("doc_id", "keep_id", "group_size", "text_sha256", F.col("kept").cast("int")).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    want = sorted(((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=str)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert sum(r[4] for r in got) == len(groups)
    kept = exactdedup.keep(df, budget)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exactdedup.mark(df.limit(0)).count() == 0


def test_grace_spills_and_cleans_up(tmp_path):
    records = iter([(hash(("k", i % 500)), b"%d" % (i % 500) * 50, 1, i, 1) for i in range(2000)])
    out = list(exactdedup.grace(records, 2000, folder=str(tmp_path)))
    assert len(out) == 500 and all(r[2] == 4 for r in out) and not list(tmp_path.iterdir())


def test_same_hash_different_contents():
    out = list(exactdedup.grace(iter([(5, b"a", 1, 1, 1), (5, b"b" * 90, 1, 2, 1), (5, b"a", 1, 3, 1)]), 50))
    assert sorted((r[1][:1], r[2], r[3]) for r in out) == [(b"a", 2, 3), (b"b", 1, 2)]


def test_minimax_is_least():
    rng = random.Random(0)
    for _ in range(60):
        sizes, k = np.array([rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))]), rng.randrange(1, 6)
        capacity, cuts = sharding.minimax(sizes, k)
        sums = [int(sizes[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:])]
        assert len(sums) == k and sum(sums) == sizes.sum() and max(sums) <= capacity
        best = {(len(sizes), 0): 0}

        def least(at, parts):
            if (at, parts) not in best:
                best[at, parts] = min((max(int(sizes[at:to].sum()), least(to, parts - 1)) for to in range(at, len(sizes) + 1)), default=10**9) if parts else (0 if at == len(sizes) else 10**9)
            return best[at, parts]

        assert capacity == least(0, k)


def least_capacity(sizes, k):
    """By trying every capacity that is a sum of neighbours."""
    sums = {sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}

    def fits(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            n, room = (n, room - s) if s <= room else (n + 1, capacity - s)
        return n <= k

    return min(c for c in sums if fits(c))


@pytest.mark.parametrize("bits, hot", [(18, 0), (3, 0), (2, 40), (4, 400)])
def test_capacity_is_least_over_groups(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(sharding, "ATOM_BITS", bits)
    rng = random.Random(bits)
    texts = ["w" * rng.choice([1, 5, 40, 300]) + str(i % 70) for i in range(110)] + ["hot text"] * hot
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.text: r.key for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("key")).distinct().collect()}
    groups = {}
    for t in texts:
        groups[keys[t]] = groups.get(keys[t], 0) + len(t) + 1
    want = least_capacity([groups[x] for x in sorted(groups)], 6)
    sums = {}
    for r in sharding.shards(df, 6).collect():
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert max(sums.values()) == want


def test_shards(spark):
    rows = some_docs()
    got = sharding.shards(spark.createDataFrame(rows, DOCS).repartition(3), 4).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    crc = {}
    for r in got:
        crc.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in crc.values())
    assert sharding.shards(spark.createDataFrame([], DOCS)).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "x" * 100_000), (5, "http://e", "x" * 100_000), (None, "http://n", "<p>é</p>"), (7, "http://x\r\ny", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    paths = warc.write(df, str(tmp_path / "w"))
    got = sorted(map(tuple, warc.digests(warc.assemble(warc.read(paths))).collect()), key=str)
    groups = {}
    for i, _, t in pages:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, _, t in pages:
        b, top = (t or "").encode(), max((x for x in groups[t or ""] if x is not None), default=None)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    whole = warc.assemble(warc.read(paths))
    assert whole.filter("request IS NULL OR metadata IS NULL").count() == 0
    assert {r[0] for r in whole.filter("response.type = 'response'").select(F.decode("response.payload", "utf-8")).collect()} == {t or "" for _, _, t in pages}
    assert warc.digests(warc.assemble(warc.read(warc.write(df.limit(0), str(tmp_path / "e"))))).count() == 0
