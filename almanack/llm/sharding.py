"""Shards of nearly equal bytes: the minimax contiguous partition of ordered groups.

Equal texts are a group; groups are ordered by the first ``KEY_BITS`` bits of a
hash of their text.  A binary search finds the smallest capacity for which a
greedy walk over the groups needs no more than k shards; the cuts are then made
as even as that capacity allows, and go back to the rows (k - 1 numbers).

The walk sees groups in atoms, ranges of the hash, of which there are some
2^``ATOM_BITS`` at most whatever the input.  Atoms bound the capacity from both
sides: whole atoms from above, atoms that may be cut anywhere from below.  Where
a cut could lie between the bounds, atoms are divided further by their hash,
until the bounds meet or every atom in question is one group; so the capacity is
the least over groups, not over atoms.

Slots: rows are sorted by (shard, doc_id) over all tasks, and each task's rows
are numbered from the number of rows of their shard in the tasks before it; no
task has to hold a shard.

Edge cases: null text counts as empty; an empty table gives no rows; rows with
equal doc_id take slots next to each other; null ids come first; a group larger
than an even share is a shard's capacity, and some shards may then be empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import shared

KEY_BITS, ATOM_BITS = 63, 15


def feasible(prefix: np.ndarray, k: int, capacity: int) -> bool:
    """Whether a greedy walk covers all atoms with k runs of at most ``capacity``."""
    at, n = 0, len(prefix) - 1
    for _ in range(k):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at >= n:
            return True
    return False


def minimax(sizes: np.ndarray, k: int) -> tuple[int, list[int]]:
    """The smallest capacity, and k + 1 places that cut the atoms into runs within it."""
    prefix = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    n, total = len(sizes), int(prefix[-1])
    low, high = max(-(-total // k), int(sizes.max(initial=0))), total
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, k, middle):
            high = middle
        else:
            low = middle + 1
    least = [n]  # the first places from which the rest still fits
    for _ in range(k):
        least.append(int(np.searchsorted(prefix, prefix[least[-1]] - low, "left")))
    cuts = [0]
    for i in range(1, k):
        even = prefix[cuts[-1]] + (total - prefix[cuts[-1]]) / (k - i + 1)
        near = int(np.searchsorted(prefix, even))
        if near and abs(prefix[near - 1] - even) <= abs(prefix[min(near, n)] - even):
            near -= 1
        most = int(np.searchsorted(prefix, prefix[cuts[-1]] + low, "right")) - 1
        cuts.append(max(cuts[-1], min(max(near, least[k - i]), most)))
    return low, [*cuts, n]


class Atoms:
    """Ranges of the key in ascending order: their first key, bytes, and whether each is one group."""

    def __init__(self, rows: DataFrame):
        self.rows, self.shift = rows, KEY_BITS
        self.first, self.size, self.single = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self._divide([(0, (1 << KEY_BITS) - 1)])

    def _divide(self, ranges: list[tuple[int, int]]) -> None:
        """Put finer atoms in the place of those within the ranges (first and last key)."""
        width = sum(b - a + 1 for a, b in ranges)
        self.shift = max(0, min(self.shift - 1, (width - 1).bit_length() - ATOM_BITS))  # a bit more at least
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | F.col("key").between(a, b)
        found = self.rows.filter(inside).groupBy(F.shiftright("key", self.shift).alias("atom")).agg(F.sum("size").alias("size"), F.min("key").alias("least"), (F.min("key") == F.max("key")).alias("single")).drop("atom")
        found = found.toPandas()  # about 2^ATOM_BITS rows
        old = np.ones(len(self.first), bool)
        for a, b in ranges:
            old &= (self.first < a) | (self.first > b)
        first = np.concatenate([self.first[old], found["least"].to_numpy(np.int64)])
        order = np.argsort(first)
        self.first = first[order]
        self.size = np.concatenate([self.size[old], found["size"].to_numpy(np.int64)])[order]
        self.single = np.concatenate([self.single[old], found["single"].to_numpy(bool)])[order]

    def _reach(self, prefix: np.ndarray, k: int, capacity: int) -> list[int]:
        """The places in bytes that k runs end at most, if atoms of several groups could be cut anywhere."""
        ends, at = [], 0
        for _ in range(k):
            at = min(at + capacity, int(prefix[-1]))
            j = int(np.searchsorted(prefix, at, "right")) - 1
            if j < len(self.single) and self.single[j]:
                at = int(prefix[j])
            ends.append(at)
        return ends

    def settle(self, k: int) -> tuple[int, list[int]]:
        """The least capacity over groups, and the k - 1 keys at which shards begin."""
        while True:
            prefix = np.concatenate([[0], np.cumsum(self.size)])
            total, (most, cuts) = int(prefix[-1]), minimax(self.size, k)
            low, high = -(-total // k), most
            while low < high:
                middle = (low + high) // 2
                if self._reach(prefix, k, middle)[-1] >= total:
                    high = middle
                else:
                    low = middle + 1
            ranges, at = [], 0
            for end in self._reach(prefix, k - 1, most):
                at = int(np.searchsorted(prefix, prefix[at] + low, "right")) - 1
                last = min(int(np.searchsorted(prefix, end, "left")), len(self.size) - 1)
                open_ = at + np.flatnonzero(~self.single[at : last + 1])
                if len(open_):
                    ranges.append((open_[0], open_[-1]))
            if low >= most or not ranges:
                return most, [int(self.first[c]) if c < len(self.first) else 1 << KEY_BITS for c in cuts[1:-1]]
            merged: list[list[int]] = []
            for a, b in sorted(ranges):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            beyond = [*self.first[1:].tolist(), 1 << KEY_BITS]
            self._divide([(int(self.first[a]), beyond[b] - 1) for a, b in merged])


def shards(docs: DataFrame, k: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null: this law moves rows when k grows)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = shared.table(
        docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key")),
        "shard-rows",
    )
    atoms = Atoms(rows)
    cuts = atoms.settle(k)[1] if len(atoms.size) else []
    shard = sum(((F.col("key") >= c).cast("int") for c in cuts if c < 1 << KEY_BITS), F.lit(0))
    placed = rows.withColumn("shard", shard).repartitionByRange("shard", "doc_id").sortWithinPartitions(F.asc("shard"), F.asc_nulls_first("doc_id"))
    placed = shared.table(placed.withColumn("place", F.monotonically_increasing_id()), "shard-placed")
    placed = placed.withColumn("task", F.shiftright("place", 33))
    counts = placed.groupBy("task", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # a row for each task and shard that meet
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("task", "shard", (before - F.col("first")).alias("base"))
    return placed.join(base, ["task", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
