"""Exact deduplication by Grace hashing.

Records (hash, content, number of rows, largest id, rows with that id) go into
an open-addressing table that compares complete contents.  When the table's
contents pass ``budget`` bytes, all records are dealt to spill files by further
bits of the hash, and each file is deduplicated the same way in turn, until it
fits.  The same table runs twice: before the shuffle over each task's own rows,
so that a hot content leaves a task once, and after it over all of a hash.  No
task holds a group's rows: documents find their group by the content's digest.

Edge cases: null text counts as empty; only A-Z are lower-cased; a null doc_id
is below any other; of rows with the same text and the largest doc_id one stays
(any: they agree in both); an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import string
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import shared
from almanack.llm import textbytes as tb

#: Bytes of content in a table at most; spill files made at once.
BUDGET, FANOUT_BITS = 48 << 20, 4
_EMPTY = -1


class OpenTable:
    """Open addressing with linear probing; equality is that of the contents."""

    def __init__(self):
        self.slots, self.mask = [_EMPTY] * 1024, 1023
        self.records: list[list] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, n: int, top, n_top: int) -> None:
        at = h & self.mask
        while (k := self.slots[at]) != _EMPTY:
            found = self.records[k]
            if found[0] == h and found[1] == content:
                found[2] += n
                if top == found[3]:
                    found[4] += n_top
                elif found[3] is None or (top is not None and top > found[3]):
                    found[3], found[4] = top, n_top
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.records)
        self.records.append([h, content, n, top, n_top])
        self.bytes += len(content) + 200
        if 2 * len(self.records) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [_EMPTY] * (self.mask + 1)
        for k, record in enumerate(self.records):
            at = record[0] & self.mask
            while self.slots[at] != _EMPTY:
                at = (at + 1) & self.mask
            self.slots[at] = k


def grace(records: Iterator[tuple], budget: int = BUDGET, level: int = 0, folder: str | None = None) -> Iterator[list]:
    """The distinct contents of ``records`` with their numbers summed, in memory bounded by ``budget``."""
    table, own = OpenTable(), None
    last = (level + 1) * FANOUT_BITS > 60  # no bits are left that would divide the records
    try:
        for record in records:
            table.add(*record)
            if table.bytes > budget and not last:
                break
        else:
            yield from table.records
            return
        own = tempfile.mkdtemp(dir=folder, prefix="grace-")
        shift, mask = 60 - level * FANOUT_BITS, (1 << FANOUT_BITS) - 1
        files = [open(os.path.join(own, str(i)), "wb") for i in range(mask + 1)]  # noqa: SIM115
        try:
            for source in (table.records, records):
                for record in source:
                    pickle.dump(tuple(record), files[(record[0] & (1 << 64) - 1) >> shift & mask], -1)
                table = OpenTable()
        finally:
            for f in files:
                f.close()
        for f in files:
            yield from grace(_spilled(f.name), budget, level + 1, own)
            os.remove(f.name)
    finally:
        if own:
            shutil.rmtree(own, ignore_errors=True)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for block in tb.blocks(batches, "content"):
        yield from zip(*(block.column(c).to_pylist() for c in ("h", "content", "n", "top", "n_top")))


def _combine(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(grace(_rows(batches), budget)):
            h, content, n, top, n_top = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(content, pa.binary()), pa.array(n, pa.int64()), pa.array(top, pa.int64()), pa.array(n_top, pa.int64())], ["h", "content", "n", "top", "n_top"])

    return run


def _finish(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(grace(_rows(batches), budget)):
            _, content, n, top, n_top = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(c).hexdigest() for c in content]), pa.array(top, pa.int64()), pa.array(n, pa.int64()), pa.array(n_top, pa.int64())], ["text_sha256", "keep_id", "group_size", "n_top"])

    return run


def _parts(records: Iterator[list], limit: int = 4 << 20) -> Iterator[list[list]]:
    part, size = [], 0
    for record in records:
        part.append(record)
        size += len(record[1]) + 64
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A row for each distinct normalised text: text_sha256, keep_id, group_size, n_top (rows with keep_id)."""
    content = normalised()
    rows = docs.select(F.xxhash64(content).alias("h"), F.encode(content, "utf-8").alias("content"), F.lit(1).cast("long").alias("n"), F.col("doc_id").cast("long").alias("top"), F.lit(1).cast("long").alias("n_top"))
    local = rows.mapInArrow(_combine(budget), rows.schema)
    parts = shared.tasks(docs)
    return local.repartition(parts, "h").mapInArrow(_finish(budget), "text_sha256 string, keep_id long, group_size long, n_top long")


def _decided(named: DataFrame, found: DataFrame) -> DataFrame:
    """``named`` (doc_id, text_sha256 and more) with its groups and kept."""
    both = named.join(found, "text_sha256")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    several = top & (F.col("n_top") > 1)
    first = F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id")) == 1
    return both.filter(~several).withColumn("kept", top).unionByName(both.filter(several).withColumn("kept", first)).drop("n_top")


def mark(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``docs`` and keep_id, group_size, kept, text_sha256, which replace columns of those names."""
    taken = {"keep_id", "group_size", "kept", "text_sha256", "n_top"} & set(docs.columns)
    return _decided(docs.drop(*taken).withColumn("text_sha256", F.sha2(normalised(), 256)), groups(docs, budget))


def keep(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, whatever its columns."""
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(normalised(), 256).alias("text_sha256"))
    return _decided(named, groups(docs, budget)).filter("kept").select("row.*")
