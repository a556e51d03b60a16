import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanack.llm import tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    slots = tokenfile.PerfectHash.build(h).slots(h)
    assert sorted(slots) == list(range(5000))


def test_equal_hashes_are_refused():
    with pytest.raises(ValueError):
        tokenfile.PerfectHash.build(np.array([3, 3, 5], np.uint64))


def test_shard_access():
    key, off = np.array([5, -3, 9, 0]), np.array([0, 3, 3, 7, 8])
    valid, nth = np.array([True, True, True, False]), np.zeros(4, np.uint32)
    ids = np.array([1, 2, 70000, 4, 5, 6, 7, 8], np.uint32)
    s = tokenfile.Shard(io.BytesIO(tokenfile.shard_bytes(key, valid, nth, ids, off)))
    place, size = s.lookup(np.array([9, 5, -3, 12345]))
    assert place.tolist()[:3] == [3, 0, 3] and size.tolist() == [4, 3, 0, 0] and place[3] == -1
    assert s.ids(3, 4).tolist() == [4, 5, 6, 7] and s.width == 4
    assert tokenfile.Shard(io.BytesIO(tokenfile.shard_bytes(key[:0], valid[:0], nth[:0], ids[:0], off[:1]))).lookup(key)[0].tolist() == [-1] * 4


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = [(i * 7 % 101, f"Word {i} and " * (i % 9)) for i in range(101)] + [(500, None), (501, ""), (3, "again"), (3, "again"), (None, "no id"), (502, "long " * 9000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, start string").repartition(3)
    rows = tokenfile.digests(tokenfile.read(tokenfile.write(df, WORDS, str(tmp_path / "tok"), shard_ids=500))).collect()
    whole, at, want = Tokenizer.from_file(WORDS), 0, []
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashed[d[1]], d[1] is not None)):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert tokenfile.read(tokenfile.write(df.limit(0), WORDS, str(tmp_path / "none"))).count() == 0
