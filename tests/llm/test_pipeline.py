import os
import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_pipeline_by_stages(spark, tmp_path):
    """The rows of run() are those of brute force: what each stage must keep is known by construction."""
    import corpus_pipeline

    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["tion", "the", "ing", "and", "er", "st"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, text(60), "en", "s", 0) for i in range(80)]
    bench = [(i, text(30)) for i in range(3)]
    near = clean[0][1].split()
    near[30] = "changed"
    rows = clean + [
        (100, None, "en", "s", 0),
        (101, "123 456", "en", "s", 0),
        (102, clean[5][1].upper(), "en", "s", 0),  # a copy: it stays, 5 goes
        (103, " ".join(near), "en", "s", 0),  # near 0: it goes
        (104, text(20) + " " + bench[1][1], "en", "s", 0),  # contaminated
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r[0] for r in clean} - {5} | {102}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_stages_over_given_documents(spark):
    """Each stage against brute force on what the one before it kept, over the whole smallest tables."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, start = docs.columns, docs.collect()

    def step(name, rows):
        return stages[name](spark, spark.createDataFrame(rows, docs.schema), SF).collect()

    kept = start  # language_id: test_models has its accuracy
    again = step("exact_dedup", kept)
    last = {}
    for r in kept:
        key = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in again) == sorted(last.values())

    alone = step("near_dedup", again)
    sets, root = [runs(words(r.text), 5) for r in again], list(range(len(again)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(again)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(again):
        groups.setdefault(find(i), []).append(r.doc_id)
    assert sorted(r.doc_id for r in alone) == sorted(map(min, groups.values()))

    clean = step("decontamination", alone)
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        phrases |= runs(words(r.text), 13)

    def contaminated(t):
        w = words(t)
        hit = {i + k for n in {len(p) for p in phrases} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in phrases for k in range(n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in alone if not contaminated(r.text))
    assert all(list(r.asDict()) == columns for r in clean)

    pieces = step("packing", clean)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(encode.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clean}
    got, sequences = {}, {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        sequences[p.sequence_id] = sequences.get(p.sequence_id, 0) + p.length
    assert got == want and max(sequences.values()) <= 1024
