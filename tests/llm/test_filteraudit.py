import random
import re
from itertools import permutations

import pytest

from almanack.llm import filteraudit as fa

SCHEMA = "doc_id long, text string, lang string, A string, name string, part string, good long, salt string, is_first long"


def failures(rows):
    """A set of letters for each row, by the contract's words."""
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows) else set()
        out.append(f)
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails, out, shapley = failures(rows), {}, {}
    for part in {g or "" for _, _, g, *_ in rows}:
        mine = [(i, f) for (i, _, g, *_), f in zip(rows, fails) if (g or "") == part]
        for p in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(p, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                n = sum(x in f for _, f in mine)
                out[part, "".join(p), step] = [len(left), len(gone), n - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def some_rows():
    rng, rows = random.Random(4), []
    for i in range(160):
        n = rng.choice([20, 99, 100, 101, 150])
        w = [rng.choice(["Upper", "WORD", "é", "plain"]) + str(rng.randrange(rng.choice([40, 5000]))) for _ in range(n)]
        w[3] = rng.choice(["x", "#", "a|b", "100%", "ok"])
        rows.append((i, rng.choice([" ", "\n", "\x0b ", "  "]).join(w), rng.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[rng.randrange(160)][1], "en") for i in range(40)]
    rows += [(300, None, "fr"), (301, "", "fr"), (301, "", "fr"), (300, None, "fr"), (None, rows[0][1], "en"), (None, "", None), (7, "again", "de"), (7, "AGAIN", "de")]
    return [*rows, (400, "long " * 200_000, "en")]


def collected(df):
    rows = df.collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_brute_force(spark):
    rng, rows = random.Random(9), some_rows()
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 220, 2)] + [(2, 1, 1), (4, None, None), (None, 1, 1), (999, 1, 1), (301, 0, 1)]
    docs = spark.createDataFrame([(*r, "a", "n", "p", 1, "s", 0) for r in rows], SCHEMA).repartition(5)
    known = spark.createDataFrame([(*r, "A", 1) for r in labels], "doc_id long, quality int, toxic int, name string, salt int")
    assert collected(fa.audit(fa.joint(fa.flags(docs, known)))) == brute(rows, labels)


def test_counts_of_the_sets_are_of_joint_failures(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fails, parts = failures(rows), [g or "" for _, _, g in rows]
    for r in fa.joint(fa.flags(docs, none)).collect():
        for s in range(32):
            wanted = {x for k, x in enumerate("ABCDE") if s >> k & 1}
            assert r["all"][s] == sum(p == r.part and wanted <= f for p, f in zip(parts, fails))
        assert not any(r.good) and not any(r.toxic)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    docs = spark.createDataFrame([(1, None, None)][:n], "doc_id long, text string, lang string")
    found = collected(fa.audit(fa.joint(fa.flags(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))))
    assert len(found) == 600 * n and all(v[:3] == ((0, 1, 0) if k[1][k[2] - 1] == "A" else (k[1].index("A") >= k[2], 0, 0)) for k, v in found.items())
