"""Spelling variants: words that differ by one edit, found in a positional q-gram index with a count filter.

1. ``words``: tasks count the words of whole texts in a bounded table, so a
   frequent word leaves a task a few times at most; counts are summed.
2. ``postings``: a word of L letters, padded, has L + q - 1 grams.  One edit touches
   q of them, so near words share max(L) - 1 at least, at places that are the same
   or one apart.  In any fixed order of the grams (equal ones by place) the first
   that they share is one of the first q + 1 of both.  The order is by rarity, and
   the index is dealt out by such a gram, its place, and length: class L has the
   words of L letters and those of L + 1, which are sought among them.
3. ``near_in``: a task indexes the words of a key by (gram, place).  For each word,
   the posting lists that its grams may meet (the same place if lengths are the
   same, else the same or the one before) are merged by a heap, shortest first;
   the longest are only probed for words that can still reach the bound.  Pairs
   at the bound are verified.
4. A key of over ``HOT`` words is never one group: its words go on to keys of their
   own, the word without one of its 2, 8, 32, ... pieces.  One edit leaves all
   pieces but one whole, so near words share such a key, too.  When pieces are
   single letters, a key has at most twice as many words as there are letters.
5. ``variants``: a word's form is its near word of the largest count, if that is
   twice its own; roots follow forms by doubling, as counts double on the way.

The letters are a-z and U+00C0 to U+00FF (90 of them), so there are 91^3 grams at
most: what is broadcast is an array of that many ranks, 3 MB, for any corpus.

Edge cases: null text has no words; a null doc_id counts as empty in the checksum
that deletes letters; equal rows count as often as they stand; a word may be
megabytes long; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import shared
from almanack.llm import textbytes as tb

LENGTH, TIMES, THIN, Q, HOT = 5, 3, 97, 3, 2000
#: Words and bytes that a task counts before it gives them on; how often a word must stand in the
#: lists that are merged, the others being probed; words of one index.
HELD, HELD_BYTES, MERGED, PART = 200_000, 32 << 20, 2, 100
_BASE = 91
_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[0xC0:0x100] = np.arange(27, 91)


def words(docs: DataFrame, length: int = LENGTH, thin: int = THIN) -> DataFrame:
    """word, n: runs of letters of the whole texts, A-Z lower-cased; where ``thin`` divides the crc32 of ``<doc_id>:<run>``, one letter is left out."""

    runs = re.compile(f"[a-zÀ-ÿ]{{{length},}}")  # shorter ones can't become words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for block in tb.blocks(batches):
            texts = pc.fill_null(block.column("text").cast(pa.large_binary()), b"")
            for name, text in zip(block.column("doc_id").to_pylist(), texts):
                begin = crc32(f"{'' if name is None else name}:".encode())
                for w, n in Counter(runs.findall(text.as_py().lower().decode())).items():  # bytes.lower() knows A-Z only
                    h = crc32(w.encode(), begin)
                    if h % thin == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= length:
                        held += 0 if w in counts else len(w)
                        counts[w] = counts.get(w, 0) + n
                        if len(counts) >= HELD or held > HELD_BYTES:
                            yield out()
                            counts.clear()
                            held = 0
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of padded words (as Latin-1 bytes), and the n + 1 offsets of the words in them."""
    pad = b"\0" * (Q - 1)
    data = _CODE[np.frombuffer(pad + pad.join([*some, b""]), np.uint8)]
    size = np.array([len(w) + Q - 1 for w in some], np.int64)
    whole = len(data) - Q + 1
    code = np.zeros(max(whole, 0), np.int64)
    for j in range(Q):
        code = code * _BASE + data[j : j + whole]
    return code, np.concatenate([[0], np.cumsum(size)])


def ranks(vocabulary: DataFrame) -> np.ndarray:
    """The place of every gram in the order of rarity; tasks count, and at most 91^3 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(_BASE**Q, np.int64)
        for block in tb.blocks(batches, "word"):
            times += np.bincount(grams([w.encode("latin-1") for w in block.column("word").to_pylist()])[0], minlength=len(times))
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(times[some])], ["gram", "times"])

    found = vocabulary.select("word").mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(_BASE**Q, np.int64)
    times[found.column("gram").to_numpy()] = found.column("times").to_numpy()
    out = np.empty(len(times), np.int32)
    out[np.argsort(times, kind="stable")] = np.arange(len(times), dtype=np.int32)
    return out


_ROW = "key long, short int, word string, n long"


def _rows(key: list[int], short: list[int], word: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(short, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["key", "short", "word", "n"])


def postings(vocabulary: DataFrame, length: int) -> DataFrame:
    """key, short, word, n: each word under its q + 1 rarest grams and their places, in the class of its own length and in the one below."""
    rank = vocabulary.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for block in tb.blocks(batches, "word"):
            some, n = block.column("word").to_pylist(), block.column("n").to_pylist()
            code, off = grams([w.encode("latin-1") for w in some])
            rows: list[tuple] = []
            for i, w in enumerate(some):
                own = code[off[i] : off[i + 1]]
                for place in np.argsort(order[own], kind="stable")[: Q + 1].tolist():
                    g = int(own[place])
                    rows.append((place << 20 | g, len(w), w, n[i]))
                    if len(w) > length:  # in the class below, the gram may stand a place before
                        rows += [(at << 20 | g, len(w) - 1, w, n[i]) for at in (place, place - 1) if at >= 0]
            if rows:
                yield _rows(*map(list, zip(*rows)))

    return vocabulary.select("word", "n").mapInArrow(run, _ROW)


def without(data: bytes, short: int, pieces: int) -> Iterator[tuple[int, bytes, bytes]]:
    """What is before and after each piece of a word of ``short`` letters or one more; the piece of a longer word is a letter longer."""
    more, k = len(data) - short, min(pieces, short)
    at = [j * short // k for j in range(k + 1)]
    return ((j, data[: at[j]], data[at[j + 1] + more :]) for j in range(k))


def cut(rows: DataFrame, pieces: int) -> DataFrame:
    """The words of hot keys under keys of their own: each word without one of its pieces."""

    def name(key: int, piece: int, before: bytes, after: bytes) -> int:
        h = hashlib.blake2b(b"%d:%d:%d:" % (key, piece, len(before)) + before + after, digest_size=8)
        return int.from_bytes(h.digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "word"):
            for key, short, w, n in zip(*(block.column(c).to_pylist() for c in ("key", "short", "word", "n"))):
                names = [name(key, *part) for part in without(w.encode("latin-1"), short, pieces)]
                yield _rows(names, [short] * len(names), [w] * len(names), [n] * len(names))

    return rows.mapInArrow(run, _ROW)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether the second word is the first with one letter replaced or inserted."""
    low, high = 0, len(a)
    while low < high:  # the longest common beginning, by halving: a word may be long
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a != b and a[low + (len(a) == len(b)) :] == b[low + 1 :]


def near_in(some: list[bytes], short: int, pieces: int = 2) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of one edit, of the words of ``short`` letters and of one more; of the longer ones none with each other. An index of over ``PART`` words is divided by pieces, too."""
    if len(some) <= PART or pieces // 4 >= short:
        yield from indexed(some, short)
        return
    parts: dict[tuple, list[bytes]] = {}
    for w in some:
        for part in without(w, short, pieces):
            parts.setdefault(part, []).append(w)
    for part in parts.values():
        if len(part) > 1:
            yield from near_in(part, short, pieces * 4)


def indexed(some: list[bytes], short: int) -> Iterator[tuple[bytes, bytes]]:
    """``near_in`` by one index: words of ``short`` letters are sought among those before them, then the longer ones among all of those."""
    pad = b"\0" * (Q - 1)
    index: list[dict[bytes, list[int]]] = [{} for _ in range(short + Q)]  # by place, then by gram; the last place stays empty
    some = sorted(some, key=len)
    for j, w in enumerate(some):
        padded, size = pad + w + pad, len(w)
        own = [padded[at : at + Q] for at in range(size + Q - 1)]
        lists = [x for here, g in zip(index, own) if (x := here.get(g))]
        if size > short:  # beyond the letter more, grams stand a place before
            lists += [x for here, g in zip(index, own[1:]) if (x := here.get(g))]
        bound = size - 1  # as many grams as the longer word of a pair has letters, less one
        if len(lists) >= bound:
            lists.sort(key=len)
            few = len(lists) - bound + MERGED
            for i, same in groupby(merge(*lists[:few])):
                count, missing = len(list(same)), len(lists) - few
                for x in lists[few:]:
                    if count + missing < bound:
                        break
                    missing -= 1
                    count += i in x
                if count >= bound and one_edit(some[i], w):
                    yield some[i], w
        if size == short:
            for here, g in zip(index, own):
                here.setdefault(g, []).append(j)


def pairs(rows: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: near words of each key; a pair comes once for each key that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for block in tb.blocks(batches, "word"):
                yield from zip(*(block.column(c).to_pylist() for c in ("key", "short", "word", "n")))

        for (_, short), group in groupby(members(), key=lambda r: r[:2]):
            group = list(group)
            if len(group) == 1 or all(len(r[2]) > short for r in group):
                continue
            counts = {w.encode("latin-1"): (w, n) for _, _, w, n in group}
            near = [(*counts[a], *counts[b]) for a, b in near_in(list(counts), short)]
            if near:
                a, n_a, b, n_b = zip(*near)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64())], ["a", "b", "n_a", "n_b"])

    dealt = rows.repartition(shared.tasks(rows), "key", "short").sortWithinPartitions("key", "short")
    return dealt.mapInArrow(run, "a string, b string, n_a long, n_b long")


def near(vocabulary: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """word, other, other_n: all pairs of words of one edit, both ways; a table."""
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    rows, pieces, found = shared.table(postings(vocabulary, length), "spelling-postings"), 2, None
    while True:
        often = shared.table(rows.groupBy("key", "short").count().filter(F.col("count") > hot).select("key", "short"), "spelling-hot")
        last = pieces // 4 >= longest or often.isEmpty()
        part = shared.table(pairs(rows if last else rows.join(often, ["key", "short"], "left_anti")), "spelling-pairs")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        rows, pieces = shared.table(cut(rows.join(often, ["key", "short"], "left_semi"), pieces), "spelling-cut"), pieces * 4
    both = found.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(found.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    return shared.table(both.distinct(), "spelling-near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) of a word lead to; the way doubles each round, and there are no more rounds than a count has bits."""
    up = shared.table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        a, b = up.alias("a"), up.alias("b")
        step = a.join(b, F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        step = shared.table(step, "spelling-roots")
        up, still = step.select("word", "root"), step.filter("moved")
        if still.isEmpty():
            return up


def variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, thin: int = THIN, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``length`` letters that stands ``times`` times or more."""
    vocabulary = shared.table(words(docs, length, thin).filter(F.col("n") >= times), "spelling-words")
    best = near(vocabulary, length, hot).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    is_form = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    named = shared.table(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return named.join(roots(named.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
