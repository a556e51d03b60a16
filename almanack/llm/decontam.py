"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of documents.  Its words that some benchmark text has are the
alphabet; runs of them long enough to hold a phrase are laid end to end, each
closed by a separator, and indexed: suffix array, Burrows-Wheeler transform in a
wavelet matrix, and the suffix positions of every ``SAMPLE``-th place.  All
phrases are searched backwards at once; occurrences are located by walking to a
sampled position, and their words merge into spans to remove.

A phrase is a window of ``window`` consecutive words of a benchmark text; a text
of fewer words, but not none, is one phrase.  Tasks that read the benchmark write
its phrases to files in the shared folder, in blocks of ``BENCHMARK_BYTES``; tasks
that read documents hold ``HELD`` of them at most, and read the files once for
``TOGETHER`` shards if there are more.  A shard is indexed anew for each block, so
nothing bounds the benchmark and nothing of it passes through the driver.

Edge cases: null text has no words; a null item_id is listed as an empty string;
items that repeat a text, and rows that repeat an item, count as one each by
their item_id; documents without words are never contaminated; an empty
benchmark marks nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.llm import shared
from almanack.llm import textbytes as tb
from almanack.llm.shared import open_at

WINDOW, SAMPLE, BENCHMARK_BYTES = 13, 8, 4 << 20
HELD, TOGETHER = 4, 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many symbols at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.ranks = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ranks[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(place), place
        for i, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            bit = (symbol >> (self.bits - 1 - i)) & 1 == 1
            low1, high1 = ones[low], ones[high]
            low = np.where(bit, zeros + low1, low - low1)
            high = np.where(bit, zeros + high1, high - high1)
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, without ties, as a walk from row to row relies on it; separators (0) all differ, so no comparison goes beyond a run."""
    n, at = len(text), np.arange(len(text))
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    h = 1
    while True:
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], 0)
        after[ends] = 0
        key = rank * (n + int(text.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = step
        h *= 2
        if not n or step[-1] == n - 1:
            return order


class FMIndex:
    """Backward search and location over a text of symbols 1 to ``top`` in runs closed by 0."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bwt, self.wavelet = before, WaveletMatrix(before, top)
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, symbols: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase: the ``size`` symbols from its start on."""
        low, high = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        a, b = np.zeros_like(low), np.full(len(start), len(self.bwt))
        for j in range(size - 1, -1, -1):
            c = symbols[start[live] + j]
            base = self.first[c]
            a, b = base + self.wavelet.rank(c, a), base + self.wavelet.rank(c, b)
            on = a < b
            live, a, b = live[on], a[on], b[on]
        low[live], high[live] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix."""
        place, steps, rows, open_ = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(open_):
            hit = self.sampled[rows]
            place[open_[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps
            open_, rows = open_[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return place


class Phrases:
    """Phrases of a block of benchmark items as places in the items' words; ``owners`` lists the items of each phrase."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        words = tb.Words(pa.array([t for _, t in items], pa.large_string()))
        self.vocabulary, self.symbols = words.distinct, words.code.astype(np.int32) + 1
        found: dict[bytes, tuple[int, int, set]] = {}
        for (item, _), a, b in zip(items, words.of[:-1].tolist(), words.of[1:].tolist()):
            size = min(window, b - a)
            for i in range(a, b - size + 1 if size else a):
                found.setdefault(self.symbols[i : i + size].tobytes(), (size, i, set()))[2].add(item)
        self.names = sorted({item for item, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        self.groups = []  # (words of a phrase, their first places, first owner of each, owners)
        for size in sorted({s for s, _, _ in found.values()}):
            some = [(i, sorted(at[x] for x in owners)) for s, i, owners in found.values() if s == size]
            self.groups.append((size, np.array([i for i, _ in some], np.int32), np.concatenate([[0], np.cumsum([len(o) for _, o in some])]), np.array([x for _, o in some for x in o], np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0

    def hits(self, words: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and the pairs (document, item) as document * items + item."""
        hit = np.zeros(len(words.code), bool)
        if not self.groups or not len(words.code):
            return hit, np.zeros(0, np.int64)
        symbol = (pc.fill_null(pc.index_in(words.distinct, self.vocabulary), -1).to_numpy().astype(np.int64) + 1)[words.code]
        doc = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
        known = symbol > 0
        start = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])
        begin = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        size = np.bincount(run[known], minlength=len(begin))
        long = size >= self.shortest  # shorter runs hold no phrase
        begin, size = begin[long], size[long]
        if not len(begin):
            return hit, np.zeros(0, np.int64)
        offs = np.concatenate([[0], np.cumsum(size + 1)])
        word_at = np.arange(offs[-1]) - np.repeat(offs[:-1], size + 1) + np.repeat(begin, size + 1)
        text = symbol[np.minimum(word_at, len(symbol) - 1)]
        text[offs[1:] - 1] = 0
        index = FMIndex(text, len(self.vocabulary))
        cover, pairs = np.zeros(len(words.code) + 1, np.int64), [np.zeros(0, np.int64)]
        for length, start, first, owners in self.groups:
            low, high = index.search(self.symbols, start, length)
            n = high - low
            which = np.repeat(np.arange(len(start)), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            place = word_at[index.locate(rows)]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            both = np.unique(doc[place] * len(start) + which)
            d, p = both // len(start), both % len(start)
            k = first[p + 1] - first[p]
            item = owners[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[p], k)]
            pairs.append(np.repeat(d, k) * len(self.names) + item)
        return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs))


def phrase_files(benchmark: DataFrame, window: int = WINDOW) -> list[str]:
    """The paths of the benchmark's blocks of phrases in the shared folder."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    whole = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    folder = shared.place(benchmark.sparkSession, "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0

        def write() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.phrases"
            fs, at = open_at(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(pickle.dumps(Phrases(sorted(block, key=lambda x: (x[0], x[1] or "")), window), -1))
            return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                block.append((item, text))
                size += len(text or "")
                if size >= BENCHMARK_BYTES:
                    yield write()
                    block, size = [], 0
        if block:
            yield write()

    blocks = max(1, -(-whole // BENCHMARK_BYTES))
    return sorted(r.path for r in rows.coalesce(blocks).mapInArrow(run, "path string").collect())  # a path for each block


@lru_cache(maxsize=HELD)
def _phrases(path: str) -> Phrases:
    fs, at = open_at(path)
    with fs.open_input_file(at) as f:
        return pickle.loads(f.read())


def _found(paths: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tb.Words, np.ndarray, list[set]]]:
    """Blocks of documents, their words, which of those are hit by a phrase of any block, and the items of each document."""
    blocks = tb.blocks(batches)
    while some := list(islice(blocks, 1 if len(paths) <= HELD else TOGETHER)):
        words = [tb.Words(b.column("text")) for b in some]
        hit, found = [np.zeros(len(w.code), bool) for w in words], [[set() for _ in range(b.num_rows)] for b in some]
        for path in paths:
            phrases = _phrases(path)
            for i, w in enumerate(words):
                more, pairs = phrases.hits(w)
                hit[i] |= more
                for pair in pairs.tolist():
                    found[i][pair // len(phrases.names)].add(phrases.names[pair % len(phrases.names)])
        yield from zip(some, words, hit, found)


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<begin:long,end:long>>"
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _contaminated(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    """A twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def mark(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) and ``COLUMNS``, which replace columns of those names; spans are those of hit words, in bytes of the text."""
    paths, names = phrase_files(benchmark, window), [c.split()[0] for c in COLUMNS.split(", ")]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    docs = docs.select(*dict.fromkeys([*carry, "text"]))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, hit, found in _found(paths, batches):
            n = block.num_rows
            doc = np.repeat(np.arange(n), np.diff(words.of))
            n_words, n_hit = np.diff(words.of), np.bincount(doc, hit, n).astype(np.int64)
            joined = np.concatenate([[False], hit[:-1] & (doc[1:] == doc[:-1])]) if len(hit) else hit
            first = np.flatnonzero(hit & ~joined)
            last = np.flatnonzero(hit & ~np.append(joined[1:] & hit[1:], False)) if len(hit) else first
            ends = pa.StructArray.from_arrays([pa.array(words.starts[first] - words.off[doc[first]]), pa.array(words.ends[last] - words.off[doc[first]])], fields=list(_SPAN))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(n + 1)), pa.int32()), ends)
            digest = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() if f else none for f in found]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carry), pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(f) for f in found], pa.int64()), pa.array(digest), pa.array(_contaminated(n_words, n_hit)), spans], [*carry, *names])

    kinds = docs.select(*carry).schema
    for field in T.StructType.fromDDL(COLUMNS):
        kinds = kinds.add(field)
    return docs.mapInArrow(run, kinds)


def keep(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, whatever its columns."""
    paths = phrase_files(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, hit, _ in _found(paths, batches):
            doc = np.repeat(np.arange(block.num_rows), np.diff(words.of))
            yield block.filter(pa.array(~_contaminated(np.diff(words.of), np.bincount(doc, hit, block.num_rows))))

    return docs.mapInArrow(run, docs.schema)
