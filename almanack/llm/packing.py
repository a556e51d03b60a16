"""Packing of token ids into training windows by Karmarkar-Karp multiway differencing.

Whole windows are cut straight from a text.  What is left of it, under one
window, is cut into pieces of at most ``PIECE`` ids; a few hundred of them at a
time are dealt to m windows: partial partitions, each with a sum for every
window, are merged two by two, largest imbalance first, the fullest window of
one with the emptiest of the other.  Some pieces are ground to halves, quarters
and so on, since small ones even the windows out.  If a window gets more than
its capacity, more pieces are ground, and if that is of no use, m rises by one
and the pieces are dealt again.  The last ids of a task that can't fill windows
become sequences of a power of two, which need no padding.

Each task packs the texts it reads: there is no shuffle, memory is bounded by
``GROUP`` windows, and a task that is run again gives the same rows.

Edge cases: a null or empty text has its end id alone; equal rows are packed
each for itself; an empty table gives no rows; a null doc_id is kept; columns
other than the two named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import textbytes as tb
from almanack.llm.tokens import encoder

#: Ids in a piece of a remainder at most; windows dealt at a time; ids of a window left free on average.
PIECE, GROUP, SLACK = 256, 128, 4


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """The part, 0 to m - 1, of each size, so that the parts' sums are nearly equal."""
    n = len(sizes)
    left, right, made = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    heap = []
    for i, size in enumerate(sizes):
        sums, slots = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[0], slots[0] = size, i
        parts.append((sums, slots))
        heap.append((-int(size) if m > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = parts[a][0] + parts[b][0][::-1]
        x, y = parts[a][1], parts[b][1][::-1]
        slots = np.where(x < 0, y, x)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        left[made : made + len(both)], right[made : made + len(both)] = x[both], y[both]
        slots[both] = n + made + np.arange(len(both))
        made += len(both)
        order = np.argsort(-sums, kind="stable")
        parts[a], parts[b] = (sums[order], slots[order]), (None, None)
        heapq.heappush(heap, (-int(sums[order[0]] - sums[order[-1]]), a))
    part = np.zeros(n + made, np.int64)
    if n:
        slots = parts[heap[0][1]][1]
        part[slots[slots >= 0]] = np.flatnonzero(slots >= 0)
    for k in range(made - 1, -1, -1):
        part[left[k]] = part[right[k]] = part[n + k]
    return part[:n]


def deal(sizes: np.ndarray, capacity: int, m: int) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, m or more, of which none holds over ``capacity``."""
    while True:
        part = differencing(sizes, m)
        if np.bincount(part, sizes, m).max(initial=0) <= capacity:
            return part, m
        m += 1


def grind(pieces: list[tuple], n: int) -> list[tuple]:
    """The pieces, the ``n`` largest of them cut into a half, a quarter and so on, down to a few ids."""
    chosen = set(np.argsort(-_sizes(pieces), kind="stable")[:n].tolist())
    out = []
    for i, (doc, start, ids, total) in enumerate(pieces):
        if i in chosen:
            while len(ids) >= 8:
                half = len(ids) - len(ids) // 2
                out.append((doc, start, ids[:half], total))
                start, ids = start + half, ids[half:]
        out.append((doc, start, ids, total))
    return out


def _sizes(pieces: list[tuple]) -> np.ndarray:
    return np.array([len(p[2]) for p in pieces], np.int64)


class Packer:
    """Pieces in, rows (doc, start, ids, doc_tokens, sequence, offset) out."""

    def __init__(self, window: int, base: int):
        self.window, self.base, self.sequences = window, base, 0
        self.waiting: list[tuple] = []
        self.ids_waiting = 0
        self.rows: list[tuple] = []

    def _open(self, k: int = 1) -> int:
        self.sequences += k
        return self.base + self.sequences - k

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self.rows.append((doc, at, ids[at : at + w], n, self._open(), 0))
        rest = n - whole
        if rest:
            k = -(-rest // PIECE)
            ends = whole + np.arange(k + 1) * rest // k
            self.waiting += [(doc, int(a), ids[a:b], n) for a, b in zip(ends[:-1], ends[1:])]
            self.ids_waiting += rest
        if self.ids_waiting >= (GROUP + 2) * w:
            free, take = GROUP * (w - SLACK), 0
            while free >= len(self.waiting[take][2]):
                free -= len(self.waiting[take][2])
                take += 1
            self._windows(self.waiting[:take], GROUP)
            self.waiting = self.waiting[take:]
            self.ids_waiting = sum(len(p[2]) for p in self.waiting)

    def _windows(self, pieces: list[tuple], m: int) -> None:
        fine = grind(pieces, m // 2)
        part = differencing(_sizes(fine), m)
        if np.bincount(part, _sizes(fine), m).max(initial=0) > self.window:
            fine = grind(pieces, m)
            part, m = deal(_sizes(fine), self.window, m)
        first, filled = self._open(m), np.zeros(m, np.int64)
        for p, k in zip(fine, part):
            self.rows.append((*p, first + int(k), int(filled[k])))
            filled[k] += len(p[2])

    def finish(self) -> None:
        """The last windows, and sequences of a power of two for the ids that fill none."""
        m = self.ids_waiting // self.window
        spare = max(0, self.ids_waiting - m * (self.window - SLACK))
        sizes = [1 << b for b in range(spare.bit_length() - 1, -1, -1) if spare >> b & 1]
        sizes = [s for x in sizes for s in [min(x, self.window)] * -(-x // self.window)]
        for size in sizes:
            sequence, filled = self._open(), 0
            while filled < size:
                doc, start, ids, n = self.waiting.pop()
                if (over := len(ids) - (size - filled)) > 0:  # its beginning stays
                    self.waiting.append((doc, start, ids[:over], n))
                    start, ids = start + over, ids[over:]
                self.rows.append((doc, start, ids, n, sequence, filled))
                filled += len(ids)
        if self.waiting:
            self._windows(self.waiting, m)
        self.waiting, self.ids_waiting = [], 0

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(docs: DataFrame, tokenizer: str, *, window: int = 1024, end_id: int = 0, keep_space: bool = True) -> DataFrame:
    """All texts of ``docs`` as pieces of sequences of at most ``window`` ids.

    A row for each piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.  ``tokenizer`` is the path of a
    file of the tokenizers library, the same on all machines.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, schema = encoder(tokenizer, keep_space), Packer(window, TaskContext.get().partitionId() << 33), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, n, sequence, offset = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(doc, schema), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for block in tb.blocks(batches, limit=1 << 20):
            schema = block.schema.field("doc_id").type
            ids, off = coder.encode(block.column("text"), end_id)
            ids = ids.astype("<u4", copy=False)
            for doc, a, b in zip(block.column("doc_id").to_pylist(), off[:-1], off[1:]):
                packer.add(doc, ids[a:b])
            if packer.rows:
                yield out(packer.drain())
        packer.finish()
        if packer.rows:
            yield out(packer.drain())

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
