import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from almanack.llm import packing
from almanack.llm import textbytes as tb
from almanack.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", "x  y  z \n\n\t q", "<|endoftext|> a<|endoftext|>b  ", "don't 'S I'll", "é ́ x　a   b", "1234 567", "日本語 テキスト", "\x00 a\x0b b\x0c\x85c", "x" * 5000, "word " * 3000]


@pytest.mark.parametrize("path, keep", [(BYTES, True), (WORDS, False)])
def test_ids_are_those_of_whole_texts(path, keep):
    from tokenizers import Tokenizer

    whole, coder = Tokenizer.from_file(path), Encoder(path, keep)
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("ab é\n'.,1 \t") for _ in range(rng.randrange(200))) for _ in range(200)]
    for _ in range(2):  # the second time all pieces are known
        ids, off = coder.encode(pa.array([*texts, None]), 7)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 7]
        assert ids[off[-2] :].tolist() == [7]


@pytest.mark.parametrize("path, keep", [(BYTES, True), (WORDS, False)])
def test_pieces_that_polynomials_take_for_one(path, keep, monkeypatch):
    """The Thue-Morse word of 1,024 letters and its complement, in two blocks; then all pieces with one hash."""
    from tokenizers import Tokenizer

    whole, coder = Tokenizer.from_file(path), Encoder(path, keep)
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    texts = [one, one.translate(str.maketrans("ab", "ba")), one]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [coder.encode(pa.array([t]))[0].tolist() for t in texts] == want
    assert len(set(tb.hash_strings(pa.array(texts)).tolist())) == 2
    monkeypatch.setattr(tb, "hash_strings", lambda values: np.zeros(len(values), np.uint64))
    coder = Encoder(path, keep)
    for t in ("a b c", "b c d", "c a", "d d abc ab"):
        assert coder.encode(pa.array([t]))[0].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_hashes_tell_lengths_and_tails_apart():
    some = ["", "\0", "\0\0", "a", "a\0", "a" * 8, "a" * 9, "b" + "a" * 8, "a" * 64, "a" * 65, "a" * 66, "x" * 16 + "y", "y" + "x" * 16]
    assert len(set(tb.hash_strings(pa.array(some)).tolist())) == len(some)


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 900)
    part = packing.differencing(sizes, 100)
    sums = np.bincount(part, sizes, 100)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 50


@pytest.mark.parametrize("m", [1, 2, 7])
def test_windows_rise_until_all_fit(m):
    sizes = np.array([60, 50, 40, 30, 20, 10])
    part, n = packing.deal(sizes, 64, m)
    assert np.bincount(part, sizes, n).max() <= 64 and n >= m


def check(rows, docs, window):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTES)
    want = sorted((i, (*whole.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in docs if i is not None)
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want:
        ps = sorted(pieces[i], key=lambda r: r.start)
        at = 0
        for p in ps:
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    waste = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        waste += 0 if at & (at - 1) == 0 else window - at
    return waste, sum(len(ids) for _, ids in want)


def test_pack(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 300, 2000])))) for i in range(150)] + [(900, None), (901, ""), (None, "null id"), (902, "long " * 20000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, length string, sequence_id int").repartition(2)
    rows = packing.digests(packing.pack(df, BYTES)).collect()
    waste, total = check(rows, docs, 1024)
    assert waste < 0.02 * total
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_little_input_needs_no_padding(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    waste, _ = check(packing.digests(packing.pack(df, BYTES)).collect(), [(1, "a b c d e f g h i j")], 1024)
    assert waste == 0


def test_a_task_gives_its_memory_back():
    """What a worker has freed goes back to the system before and after a task, although something above it is still held."""
    code = """
import ctypes, re
import numpy as np
from almanack.llm import textbytes as tb
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
some = [np.ones(8000) for _ in range(3000)]  # 183 MB in pieces that aren't mapped one by one
pin = [np.ones(8000) for _ in range(3)]
del some
full = held()
list(tb.blocks(iter(())))
print(full - held(), hasattr(ctypes.CDLL(None), "malloc_trim"))
"""
    freed, glibc = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], check=True, capture_output=True, text=True).stdout.split()
    if glibc == "False":
        pytest.skip("glibc alone keeps freed memory and can give it back")
    assert int(freed) > 150
