"""Token ids in binary shard files with a minimal perfect hash index.

A shard file, all integers little-endian:

    8 bytes   b"TOKSHRD1"
    u64 x 5   documents n, ids, bytes of an id (2 or 4), levels, bytes of bitmaps
    u64 x L   bits of each level's bitmap
    bitmaps   one after the other
    u32 x n   fingerprints, by slot
    u64 x n   place of the first id, by slot
    u64 x n   number of ids, by slot
    i64 x n   document keys in file order, then u8 x n: 1 if the key isn't null
    u32 x n   which of the rows with that key, then the ids

The slot of a key comes from levels of bitmaps: each level hashes the keys that
the levels before it left over, and keys that meet no other set a bit; a key's
slot is the number of bits set before its own.  There are as many slots as
keys.  The stored fingerprint tells foreign keys from members.

Files go to a folder that all machines see, through ``pyarrow.fs``, under a name
of their own for each attempt; the manifest names those of the attempts that
counted.  Edge cases: a null or empty text has its end id alone; rows with the
same doc_id are ordered by a hash of their text, so that tasks can share them, and
told apart by their order within a file; null ids come first; an
empty table gives no file; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.llm import shared
from almanack.llm import textbytes as tb
from almanack.llm.shared import open_at
from almanack.llm.tokens import encoder

MAGIC = b"TOKSHRD1"
#: Ids in a file at most, but for a longer document; bits of a level for each key.
SHARD_IDS, BITS_PER_KEY = 16 << 20, 2
#: A level places over half of its keys, so only equal hashes get so far.
LEVELS = 80


def key_hash(key: np.ndarray, valid: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tb.mix(tb.mix(key.astype(np.int64).view(np.uint64)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (~valid).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _level(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tb.mix(h + np.uint64(level + 1) * np.uint64(0xA24BAED4963EE407)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes, from bitmaps in levels."""

    def __init__(self, sizes: list[int], maps: list[np.ndarray]):
        self.sizes, self.maps = sizes, maps
        self.before, total = [], 0
        for m in maps:
            self.before.append(total + np.concatenate([[0], np.cumsum(m)[:-1]]) if len(m) else np.zeros(0, np.int64))
            total += int(m.sum())

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, maps = [], []
        while len(h):
            if len(sizes) == LEVELS:
                raise ValueError(f"{len(h)} keys have hashes of others")
            bits = max(8, BITS_PER_KEY * len(h))
            at = _level(h, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            maps.append(alone)
            h = h[~alone[at]]
        return cls(sizes, maps)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for some of those that are no members."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, m) in enumerate(zip(self.sizes, self.maps)):
            at = _level(h[open_], level, bits)
            hit = m[at]
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return out


def shard_bytes(key: np.ndarray, valid: np.ndarray, nth: np.ndarray, ids: np.ndarray, off: np.ndarray) -> bytes:
    h = key_hash(key, valid, nth)
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    n = len(key)
    finger, place, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    finger[slot], place[slot], size[slot] = (h >> np.uint64(32)).astype(np.uint32), off[:-1], np.diff(off)
    packed = b"".join(np.packbits(m).tobytes() for m in mph.maps)
    head = np.array([n, len(ids), width, len(mph.sizes), len(packed), *mph.sizes], "<u8")
    return b"".join([MAGIC, head.tobytes(), packed, finger.tobytes(), place.tobytes(), size.tobytes(), key.astype("<i8").tobytes(), valid.astype("u1").tobytes(), nth.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file: keyed access to the ids of a document."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(8) != MAGIC:
            raise ValueError("this is no token shard")
        self.n, self.n_ids, self.width, levels, packed = map(int, self._read("<u8", 5))
        sizes = [int(x) for x in self._read("<u8", levels)]
        bits, maps = self._read("u1", packed), []
        for size in sizes:
            maps.append(np.unpackbits(bits[: -(-size // 8)], count=size).astype(bool))
            bits = bits[-(-size // 8) :]
        self.mph = PerfectHash(sizes, maps)
        self.finger, self.place, self.size = self._read("<u4", self.n), self._read("<u8", self.n), self._read("<u8", self.n)
        self.key, self.valid, self.nth = self._read("<i8", self.n), self._read("u1", self.n).astype(bool), self._read("<u4", self.n)
        self.data = file.tell()

    def _read(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)

    def lookup(self, key: np.ndarray, valid: np.ndarray | None = None, nth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each key; place -1 if the shard hasn't the key."""
        valid = np.ones(len(key), bool) if valid is None else valid
        h = key_hash(key, valid, np.zeros(len(key), np.uint32) if nth is None else nth)
        slot = self.mph.slots(h)
        if not self.n:
            return np.full(len(key), -1), np.zeros(len(key), np.int64)
        ok = (slot >= 0) & (self.finger[slot] == (h >> np.uint64(32)).astype(np.uint32))
        return np.where(ok, self.place[slot].astype(np.int64), -1), np.where(ok, self.size[slot].astype(np.int64), 0)

    def ids(self, place: int, size: int) -> np.ndarray:
        self.file.seek(self.data + place * self.width)
        return self._read(f"<u{self.width}", size)


def write(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2, keep_space: bool = False, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order below ``folder``.

    Returns the manifest, a table in the shared folder: part, sub (their order
    is that of the files), path, n_docs, n_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer, keep_space)
        keys, runs, sizes, sub, last, nth = [], [], [], 0, object(), 0

        def flush() -> pa.RecordBatch:
            nonlocal sub
            ids, off = np.concatenate(runs), np.concatenate([[0], np.cumsum(sizes)])
            valid = np.array([k is not None for k, _ in keys])
            blob = shard_bytes(np.array([k or 0 for k, _ in keys], np.int64), valid, np.array([j for _, j in keys], np.uint32), ids, off)
            path = f"{folder}/part-{part:06d}-{sub:04d}-{uuid.uuid4().hex}.tok"
            fs, at = open_at(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(blob)
            row = pa.RecordBatch.from_pylist([{"part": part, "sub": sub, "path": path, "n_docs": len(keys), "n_ids": len(ids)}])
            keys.clear(), runs.clear(), sizes.clear()
            sub += 1
            return row

        for block in tb.blocks(batches, limit=4 << 20):
            ids, off = coder.encode(block.column("text"), end_id)
            narrow = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
            at, names = 0, block.column("doc_id").to_pylist()
            for i, key in enumerate(names):
                nth = nth + 1 if key == last else 0
                last = key
                keys.append((key, nth))
                sizes.append(off[i + 1] - off[i])
                if sum_ids(runs) + off[i + 1] - off[at] >= shard_ids or i + 1 == len(names):
                    runs.append(narrow[off[at] : off[i + 1]])
                    at = i + 1
                    if sum_ids(runs) >= shard_ids:
                        yield flush()
        if keys:
            yield flush()

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"), "text")
    placed = placed.repartitionByRange("doc_id", "__h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "__h", F.asc_nulls_first("text")).drop("__h")
    return shared.table(placed.mapInArrow(run, "part long, sub long, path string, n_docs long, n_ids long"), "tokens-manifest")


def sum_ids(runs: list[np.ndarray]) -> int:
    return sum(map(len, runs))


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files, found by its key: doc_id, start (ids of all documents before it), n_tokens, ids (as stored, 32-bit)."""
    order = Window.orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_at(row["path"])
                with fs.open_input_file(at) as f:
                    shard = Shard(f)
                    place, size = shard.lookup(shard.key, shard.valid, shard.nth)
                    if (place < 0).any():
                        raise ValueError(f"{row['path']}: keys are missing from the index")
                    cuts = np.flatnonzero(np.diff(np.cumsum(size) // (1 << 20))) + 1
                    for a, b in zip([0, *cuts], [*cuts, shard.n]):
                        got = [shard.ids(int(p), int(s)).astype("<u4").tobytes() for p, s in zip(place[a:b], size[a:b])]
                        yield pa.RecordBatch.from_arrays([pa.array(shard.key[a:b], mask=~shard.valid[a:b]), pa.array(place[a:b] + row["base"]), pa.array(size[a:b]), pa.array(got, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(shared.tasks_of_files(manifest), "part", "sub").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def folder(spark: SparkSession) -> str:
    return shared.place(spark, "tokens")


