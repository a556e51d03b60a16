"""Whole texts of an Arrow batch as one byte array, cut up with numpy.

Texts are processed in blocks of a few megabytes, so memory does not follow the
batch size; a single longer text makes a block of its own.  Nulls are empty.
A Python worker lives on after a task, so what the task has freed goes back to
the system at its end and before the next.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_CODES = np.arange(256)
UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
LOWER = np.where(UPPER, _CODES + 32, _CODES).astype(np.uint8)
#: Bytes of words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts in them."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give memory that Arrow and the C library keep for later back to the system; glibc alone has ``malloc_trim``."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // limit)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches of a task."""
    release()
    batch = None
    for batch in batches:
        yield from slices(batch, column, limit)
    del batch
    release()


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Adjoining pieces of ``data`` as an Arrow array, without a copy per piece."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


class Words:
    """The words of a block: ``code[i]`` is the i-th word's place in ``distinct``; text d has words ``of[d]`` to ``of[d + 1]``."""

    def __init__(self, column: pa.Array, mask_of: np.ndarray = WORD):
        data, off = flat(column)
        low = LOWER[data]
        mask = mask_of[low]
        first = off[:-1][off[:-1] < off[1:]]
        before = np.empty_like(mask)
        before[1:] = mask[:-1]
        before[first] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.empty_like(mask)
        after[:-1] = mask[1:]
        after[off[1:][off[:-1] < off[1:]] - 1] = False
        ends = np.flatnonzero(mask & ~after) + 1
        self.low, self.off, self.starts, self.ends = low, off, starts, ends
        self.of = np.searchsorted(starts, off)
        pieces = np.concatenate([[0], np.cumsum(ends - starts)])
        coded = strings(low[mask], pieces).dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy(), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_strings(self.distinct)[self.code] if len(self.code) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = padded[:-1] << np.uint64(8) | padded[1:]
    w = w[:-2] << np.uint64(16) | w[2:]
    return (w[:-4] << np.uint64(32) | w[4:])[: len(data)]


#: Strings of over so many bytes are hashed by BLAKE2, one by one.
LONG = 64


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: every eight bytes are mixed in turn, so no algebra of the bytes makes two strings meet."""
    data, off = flat(values)
    size = np.diff(off)
    out = mix(size.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    if not len(data):
        return out
    chunk = words8(data)
    short = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        short = short[size[short] > at]
        left = np.minimum(size[short] - at, 8).astype(np.uint64)
        own = chunk[off[short] + at] >> (np.uint64(64) - np.uint64(8) * left)
        out[short] = mix(mix(out[short]) * np.uint64(0x9E3779B97F4A7C15) ^ own)
    for i in np.flatnonzero(size > LONG):
        out[i] = np.frombuffer(hashlib.blake2b(data[off[i] : off[i + 1]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def shingles(hashes: np.ndarray, of: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text, and their offsets; a text of fewer words, but not none, is one run."""
    count = np.diff(of)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offs = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], runs) + np.repeat(of[:-1], runs)
    end = np.repeat(of[1:], runs)
    acc = np.zeros(len(at), np.uint64)
    last = max(len(hashes) - 1, 0)
    for j in range(n):
        h = hashes[np.minimum(at + j, last)] if len(hashes) else acc
        acc = np.where(at + j < end, mix(acc + h + np.uint64(j + 1)), acc)
    return acc, offs
