"""Removal of long repeated byte strings with suffix arrays.

1. ``anchors``: each window of ``length`` bytes has as its key the least hash of
   the ``GRAM``-byte strings in it; equal windows have equal keys.  Windows whose
   key is met at one place only can't repeat, and go no further.  This is exact.
2. ``segments``: adjoining windows with the same key make a segment of text.
   Equal segments of a task leave it twice at most, whatever their number.  In a
   long stretch of a period all windows repeat; its middle stays behind.
3. ``shard``: a task has all segments of its keys.  It builds suffix arrays over
   a few megabytes of them at a time by Larsson-Sadakane refinement (only what
   is not yet told apart is sorted again, by the ranks of twice the depth), and
   Kasai common prefixes; a window repeats if its suffix shares ``length`` bytes
   with a neighbour.  Keys with over ``HOT`` segments are dealt to blocks, and
   the suffix arrays of each two blocks are merged by binary search.  With over
   ``BLOCKS`` blocks the segments of a key are cut anew, once each, by the least
   hash of longer strings (``GRAMS``), which equal windows share, too; segments
   that stand twice are settled.  The last of these strings are the windows
   themselves, which are counted.  So no key's pairs of blocks grow with the input.
4. The repeated windows of a segment go back to the documents that have it, by
   its digest, and merge into spans.

Rows are told by (doc_id, hash of the text): rows alike in both have the same
result.  Texts are bytes in UTF-8, matches never cross documents, and strings
are judged on the input.  Edge cases: null text is empty; texts under ``length``
bytes are kept whole; a string that repeats only within one text counts too; an
empty table gives no rows; the removed text need not be valid UTF-8, so it is
returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import shared
from almanack.llm import textbytes as tb

LENGTH, GRAM, HOT, BLOCKS, CHUNK = 200, 96, 2048, 8, 2 << 20
#: Shares of what lies between GRAM and LENGTH that longer strings add, one after the other.
GRAMS = (0.4, 0.75, 0.95, 1.0)
#: Bytes of a text whose windows are keyed at once; starts that common prefixes are walked from at a time.
SPLIT, WALK = 8 << 20, 1024
_M = np.uint64(0x9E3779B97F4A7C15)


#: A random 64-bit value for each byte.
_OF_BYTE = tb.mix(np.arange(1, 257, dtype=np.uint64) * _M)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash of the ``gram`` bytes from each place, by doubling; places without so many have no meaning."""
    h, n, base, out, have = _OF_BYTE[data], 1, _M, None, 0
    with np.errstate(over="ignore"):
        while True:
            if gram & n:
                if out is None:
                    out, have = h.copy(), n
                else:
                    out[: max(0, len(out) - have)] *= base
                    out[: max(0, len(out) - have)] += h[have:]
                    have += n
            if 2 * n > gram:
                return tb.mix(out)
            later = h[n:].copy()
            h[: len(later)] *= base
            h[: len(later)] += later
            base, n = base * base, 2 * n


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of the ``width`` values from each place on."""
    n, f = len(values), np.minimum if least else np.maximum
    fill = np.full((-n) % width + width, ~np.uint64(0) if least else np.uint64(0), np.uint64)
    grid = np.concatenate([values, fill]).reshape(-1, width)
    ahead = f.accumulate(grid, 1).ravel()
    back = f.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return f(back[:n], ahead[width - 1 : n + width - 1])


def runs(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: text, first window (in the text), number of windows, key, and whether its key is met twice there."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    windows = np.maximum(size - length + 1, 0)
    if not windows.sum():
        return none, none, none, none.view(np.uint64), none.astype(bool)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    key = sliding(h, width, True)
    doc = np.repeat(np.arange(len(size)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(off[:-1], windows)
    k = key[at]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(k)))
    # places whose own hash is the key of a window around them
    of_window = np.zeros(len(data), np.uint64)
    of_window[at] = k
    most = sliding(of_window[::-1], width, False)[::-1]
    place = np.flatnonzero(h == most)
    owner = np.searchsorted(off, place, "right") - 1
    inside = place <= off[owner + 1] - gram
    met, times = np.unique(tb.mix(h[place[inside]] + tb.mix(owner[inside].astype(np.uint64))), return_counts=True)
    twice = np.isin(tb.mix(k[first] + tb.mix(doc[first].astype(np.uint64))), met[times > 1])
    return doc[first], at[first] - off[doc[first]], count, k[first], twice


def suffix_array(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of all suffixes; ``end`` has for each place the end of its string, and ends all differ.

    Larsson-Sadakane refinement: suffixes are sorted by seven bytes; then those
    that still share a rank are sorted by the rank of what follows, so the depth
    doubles each time, and ranks once alone are final. A rank is the first place
    of its group. Ends stand below all suffixes, in their own order.
    """
    n = len(data)
    at = np.arange(n, dtype=np.int32)  # a chunk is a few megabytes
    end = end.astype(np.int32)
    left = np.minimum(end - at, 8).astype(np.uint64)
    key = tb.words8(data)
    key &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1))))
    key = (key & ~np.uint64(0xFF)) | np.minimum(left, np.uint64(7))
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, np.int32(0)))
    open_, h = at, 7
    while True:
        single = new[open_] & np.append(new, True)[open_ + 1]
        open_ = open_[~single]
        if not len(open_):
            return order, rank
        suffix = order[open_]
        beyond = suffix + h
        inside = beyond < end[suffix]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + (n + 1), end[suffix])
        group = rank[suffix]
        both = group.astype(np.int64) * (2 * n + 2) + second
        again = np.argsort(both)
        suffix, both = suffix[again], both[again]
        split = np.ones(len(suffix), bool)
        split[1:] = both[1:] != both[:-1]
        order[open_] = suffix
        new[open_] = split
        rank[suffix] = open_[np.maximum.accumulate(np.where(split, np.arange(len(split), dtype=np.int32), np.int32(0)))]
        h *= 2


def kasai(data: np.ndarray, order: np.ndarray, rank: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = 1, most: int | None = None) -> np.ndarray:
    """Common prefix (up to ``most``) of each suffix of ``least`` bytes or more with the one before it in the order; 0 for shorter ones.

    From a place to the next the common prefix shrinks by one at most. Strings
    are walked side by side, in stretches of ``WALK`` places, so a long one takes
    no more rounds than others.
    """
    n, words = len(data), tb.words8(data)
    lcp = np.zeros(n, np.int64)
    places = np.maximum(end[begin] - begin - least + 1, 0)
    parts = -(-places // WALK)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, count = np.repeat(begin, parts) + nth * WALK, np.minimum(np.repeat(places, parts) - nth * WALK, WALK)
    have = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    for step in range(int(count.max(initial=0))):
        live = live[count[live] > step]
        p = start[live] + step
        r = rank[p]
        q = order[r - 1]
        h = np.maximum(have[live] - 1, 0)
        room = np.where(r > 0, np.minimum(end[p] - p, end[q] - q), 0)
        room = room if most is None else np.minimum(room, most)
        h = np.minimum(h, room)
        todo = np.flatnonzero(h < room)
        while len(todo):
            a, b = words[np.minimum(p[todo] + h[todo], n - 1)], words[np.minimum(q[todo] + h[todo], n - 1)]
            x = a ^ b
            same = np.where(x == 0, 8, 0)
            bad = np.flatnonzero(x)
            same[bad] = _first_difference(x[bad])
            h[todo] = np.minimum(h[todo] + same, room[todo])
            todo = todo[(same == 8) & (h[todo] < room[todo])]
        lcp[r] = h
        have[live] = h
    return lcp


def _first_difference(x: np.ndarray) -> np.ndarray:
    """The number of leading zero bytes of non-zero numbers."""
    out = np.zeros(len(x), np.int64)
    for step in (4, 2, 1):
        zero = (x << np.uint64(8) * out.astype(np.uint64)) >> np.uint64(64 - 8 * step) == 0
        out[zero] += step
    return out


class Chunk:
    """Distinct segments end to end, their suffix array, and which windows repeat among them."""

    def __init__(self, segments: list[bytes], length: int):
        size = np.array([len(s) for s in segments], np.int64)
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.data, self.length = np.frombuffer(b"".join(segments), np.uint8), length
        self.end = np.repeat(self.off[1:], size)
        self.order, self.rank = suffix_array(self.data, self.end)
        lcp = kasai(self.data, self.order, self.rank, self.off[:-1], self.end, length, length)
        long = lcp >= length
        hit = long | np.append(long[1:], False)
        self.repeated = np.zeros(len(self.data), bool)
        self.repeated[self.order[hit]] = True

    def windows(self) -> np.ndarray:
        """The places of all windows, in the order of their bytes."""
        return self.order[self.end[self.order] - self.order >= self.length]

    def merge(self, other: Chunk) -> None:
        """Mark the windows that the two have in common: each of the other's is sought in this order."""
        mine, theirs = self.windows(), other.windows()
        if not len(mine) or not len(theirs):
            return
        steps = [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])]
        a, b = tb.words8(self.data), tb.words8(other.data)

        def below(i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
            out, open_ = np.full(len(i), or_equal), np.arange(len(i))
            for s in steps:
                x, y = a[mine[i[open_]] + s], b[theirs[j[open_]] + s]
                out[open_[x < y]], out[open_[x > y]] = True, False
                open_ = open_[x == y]
                if not len(open_):
                    break
            return out

        j = np.arange(len(theirs))
        bounds = []
        for or_equal in (False, True):
            low, high = np.zeros(len(j), np.int64), np.full(len(j), len(mine))
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                up = below(middle, j[open_], or_equal)
                low[open_[up]], high[open_[~up]] = middle[up] + 1, middle[~up]
            bounds.append(low)
        found = bounds[0] < bounds[1]
        other.repeated[theirs[found]] = True
        cover = np.zeros(len(mine) + 1, np.int64)
        np.add.at(cover, bounds[0][found], 1)
        np.add.at(cover, bounds[1][found], -1)
        self.repeated[mine[np.cumsum(cover[:-1]) > 0]] = True

    def intervals(self, i: int) -> list[tuple[int, int]]:
        """First and one past the last repeated window of each run, in segment i."""
        return _intervals(self.repeated[self.off[i] : self.off[i + 1]])


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def digest(segment: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def keyed_runs(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of a block; a text of over ``SPLIT`` bytes in parts that share ``length`` - 1 bytes, so that each window is in one of them."""
    if (np.diff(off) <= SPLIT).all():
        return runs(data, off, length, gram)
    found = []
    for doc, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        for at in range(a, max(b - length + 1, a + 1), SPLIT):
            part = data[at : min(at + SPLIT + length - 1, b)]
            d, first, *rest = runs(part, np.array([0, len(part)]), length, gram)
            found.append((d + doc, first + (at - a), *rest))
    return tuple(np.concatenate(x) for x in zip(*found))


def periodic(s: bytes, windows: int, length: int, gram: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A long segment's windows to look at, and those that repeat in a stretch with a period: runs of (first, number).

    A stretch keeps two periods at its beginning and at its end, which hold all
    of its windows twice, for other segments to meet them.
    """
    if windows > 8 * length:
        for probe in range(1, 16):
            at = probe * windows // 16
            d = s.find(s[at : at + gram], at + 1, at + length + gram) - at
            if d <= 0:
                continue
            x = np.frombuffer(s, np.uint8)
            differ = np.flatnonzero(x[:-d] != x[d:])
            k = int(np.searchsorted(differ, at))
            low = int(differ[k - 1]) + 1 if k else 0
            high = (int(differ[k]) if k < len(differ) else len(s) - d) + d  # the stretch is s[low:high]
            n = high - low - length + 1
            if n > 4 * d + length:
                out, whole = [], [(low, n)]
                for first, last in ((0, low + 2 * d), (low + n - 2 * d, windows)):
                    more, again = periodic(s[first : last + length - 1], last - first, length, gram)
                    out += [(first + a, m) for a, m in more]
                    whole += [(first + a, m) for a, m in again]
                return out, whole
    return [(0, windows)], []


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text_hash, key, twice for each run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            doc, _, _, key, twice = keyed_runs(*tb.flat(block.column("text")), length, gram)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(at), block.column("text_hash").take(at), pa.array(key.view(np.int64)), pa.array(twice)], ["doc_id", "text_hash", "key", "twice"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, text_hash long, key long, twice boolean")


def candidates(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Texts with keys that are met more than once, and those keys; a table."""
    rows = shared.table(anchors(docs, length, gram), "substring-anchors")
    often = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice").select("key")
    kept = rows.select("doc_id", "text_hash", "key").join(often, "key", "left_semi")
    keys = kept.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))
    a, b = _keyed(docs).alias("a"), keys.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return shared.table(a.join(b, same).select("a.*", "keys"), "substring-candidates")


def segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each run of windows with a repeated key: key, digest, first window, and the bytes for the first two of equal ones in a task.

    Rows with ``whole`` are of that many windows that repeat in a period, and need no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for block in tb.blocks(batches):
            data, off = tb.flat(block.column("text"))
            doc, first, count, key, _ = keyed_runs(data, off, length, gram)
            wanted = block.column("keys")
            own = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy())])
            pairs = np.repeat(np.arange(block.num_rows), np.diff(own)).astype(np.uint64)
            wanted = wanted.flatten().to_numpy().view(np.uint64)
            keep = np.isin(tb.mix(key + tb.mix(doc.astype(np.uint64))), tb.mix(wanted + tb.mix(pairs)))
            doc, first, count, key = doc[keep], first[keep], count[keep], key[keep]
            rows = []
            for i, (d, at, n) in enumerate(zip(doc.tolist(), first.tolist(), count.tolist())):
                begin = int(off[d]) + at
                s = data[begin : begin + n + length - 1].tobytes()
                parts, whole = ([(0, n)], []) if n <= 8 * length else periodic(s, n, length, gram)
                for a, m in parts:
                    part = s if m == n else s[a : a + m + length - 1]
                    name = digest(part)
                    times = seen.get(name, 0)
                    rows.append((i, at + a, name, part if times < 2 else None, None))
                    seen[name] = times + 1
                rows += [(i, at + a, None, None, m) for a, m in whole]
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                i, at, name, part, whole = zip(*rows)
                of, i = pa.array(doc[list(i)]), list(i)
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(of), block.column("text_hash").take(of), pa.array(key[i].view(np.int64)), pa.array(name, pa.int64()), pa.array(at, pa.int64()), pa.array(part, pa.binary()), pa.array(whole, pa.int64())], ["doc_id", "text_hash", "key", "digest", "first", "bytes", "whole"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash long, key long, digest long, first long, bytes binary, whole long")


def cut_anew(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments (key, digest, bytes; once each) cut by the least hash of longer strings: parent_key, parent, key, digest, first, bytes; a task gives the bytes of equal ones twice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for block in tb.blocks(batches, "bytes"):
            data, off = tb.flat(block.column("bytes"))
            doc, first, count, key, _ = runs(data, off, length, gram)
            names, parts = [], []
            for a, n in zip((off[doc] + first).tolist(), count.tolist()):
                part = data[a : a + n + length - 1].tobytes()
                name = digest(part)
                times = seen.get(name, 0)
                names.append(name)
                parts.append(part if times < 2 else None)
                seen[name] = times + 1
            if len(seen) > 1_000_000:
                seen.clear()
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([block.column("key").take(at), block.column("digest").take(at), pa.array(tb.mix(key + np.uint64(gram)).view(np.int64)), pa.array(names, pa.int64()), pa.array(first), pa.array(parts, pa.binary())], ["parent_key", "parent", "key", "digest", "first", "bytes"])

    return rows.select("key", "digest", "bytes").mapInArrow(run, "parent_key long, parent long, key long, digest long, first long, bytes binary")


_SPANS = "array<struct<from:long,to:long>>"


def whole(segments: DataFrame, length: int) -> DataFrame:
    """key, digest, spans of segments (key, digest, bytes) all of whose windows repeat."""
    return segments.select("key", "digest", F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.octet_length("bytes") - length + 1).cast("long").alias("to"))).alias("spans"))


def shard(rows: DataFrame, length: int, gram: int, level: int = 0) -> DataFrame:
    """Repeated windows of each distinct segment: key, digest, runs of (from, to)."""
    with_bytes, tasks = rows.filter("bytes IS NOT NULL").select("key", "digest", "bytes"), shared.tasks(rows)
    hot = shared.table(with_bytes.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("blocks")), "substring-hot")
    if (hottest := hot.filter(F.col("blocks") > BLOCKS)).isEmpty():
        return _solved(with_bytes, hot, length, tasks)
    rest = _solved(with_bytes.join(hottest, "key", "left_anti"), hot.filter(F.col("blocks") <= BLOCKS), length, tasks)
    if level == len(GRAMS):
        return rest.unionByName(_counted(with_bytes.join(hottest, "key", "left_semi"), length))
    once = shared.table(with_bytes.join(hottest, "key", "left_semi").groupBy("key", "digest", "bytes").agg((F.count("*") > 1).alias("again")), "substring-once")
    parts = shared.table(cut_anew(once, length, gram + round(GRAMS[level] * (length - gram))), "substring-cut")
    found = shard(parts, length, gram, level + 1)
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("first")).alias("from"), (s["to"] + F.col("first")).alias("to")))
    of = once.filter("NOT again").select(F.col("key").alias("parent_key"), F.col("digest").alias("parent"))
    back = parts.select("parent_key", "parent", "key", "digest", "first").join(of, ["parent_key", "parent"], "left_semi").join(found, ["key", "digest"]).select(F.col("parent_key").alias("key"), F.col("parent").alias("digest"), moved.alias("spans"))
    return rest.unionByName(whole(once.filter("again"), length)).unionByName(back)


def _counted(segments: DataFrame, length: int) -> DataFrame:
    """``shard`` at the last level, where the windows of a segment are all alike: they repeat if their bytes are met twice, in one segment or more."""
    dealt = segments.groupBy("key", "digest", "bytes").agg(F.sum(F.octet_length("bytes") - length + 1).alias("n")).withColumn("head", F.substring("bytes", 1, length))
    often = dealt.groupBy("key", "head").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    return whole(dealt.join(often, ["key", "head"], "left_semi"), length)


def dealt(with_bytes: DataFrame, hot: DataFrame) -> DataFrame:
    """Segments by what is to be compared: (key, 0, 0), or the pairs of blocks of a hot key, of which a segment's block meets each."""
    placed = with_bytes.join(hot, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod("digest", F.col("blocks"))).cast("int"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", F.explode(pairs)).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "bytes")


def _solved(with_bytes: DataFrame, hot: DataFrame, length: int, tasks: int) -> DataFrame:
    """``shard`` of segments that have tasks of their own, or a few blocks."""
    placed = dealt(with_bytes, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def emit(key: int, d: int, spans: list[tuple[int, int]]) -> None:
            if spans:
                found.append((key, d, [{"from": a, "to": b} for a, b in spans]))

        def out() -> pa.RecordBatch:
            key, d, spans = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], ["key", "digest", "spans"])

        def solve(group: tuple, members: dict) -> Iterator[tuple]:
            """What stands twice repeats whole; if that is not true of all members, the group goes to a chunk."""
            key, i, j = group
            if i == j:
                whole = [times > 1 for _, times in members.values()]
                for ((_, s), (d, _)), settled in zip(members.items(), whole):
                    if settled:
                        emit(key, d, [(0, len(s) - length + 1)])
                if not all(whole):
                    yield from ((key, s, d) for (_, s), (d, _) in members.items())
                return
            sides = [[(s, d) for (b, s), (d, _) in members.items() if b == k] for k in (i, j)]
            if all(sides):
                a, b = (Chunk([s for s, _ in side], length) for side in sides)
                for c in (a, b):
                    c.repeated[:] = False  # what repeats within a block is found where the block meets itself
                a.merge(b)
                for c, side in ((a, sides[0]), (b, sides[1])):
                    for n, (_, d) in enumerate(side):
                        emit(key, d, c.intervals(n))

        def settle(chunk: list[tuple]) -> None:
            if chunk:
                c = Chunk([s for _, s, _ in chunk], length)
                for n, (key, _, d) in enumerate(chunk):
                    emit(key, d, c.intervals(n))

        def groups() -> Iterator[tuple[tuple, dict]]:
            group, members = None, {}
            for block in tb.blocks(batches, "bytes"):
                for key, i, j, b, d, s in zip(*(block.column(c).to_pylist() for c in ("key", "i", "j", "block", "digest", "bytes"))):
                    if (key, i, j) != group:
                        if members:
                            yield group, members
                        group, members = (key, i, j), {}
                    known = members.get((b, s))
                    members[b, s] = (d, 1 if known is None else known[1] + 1)
            if members:
                yield group, members

        chunk, size = [], 0
        for group, members in groups():
            for row in solve(group, members):
                chunk.append(row)
                size += len(row[1])
            if size >= CHUNK:
                settle(chunk)
                chunk, size = [], 0
            if len(found) >= 10_000:
                yield out()
        settle(chunk)
        if found:
            yield out()

    return placed.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, f"key long, digest long, spans {_SPANS}")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, text, kept (binary), n_removed, n_spans of the texts from which something goes."""
    texts = candidates(docs, length, gram)
    rows = shared.table(segments(texts, length, gram), "substring-segments")
    repeated = shared.table(shard(rows, length, gram), "substring-repeats")
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("first")).alias("from"), (s["to"] + F.col("first")).alias("to")))
    hits = rows.filter("whole IS NULL").select("doc_id", "text_hash", "key", "digest", "first").join(repeated, ["key", "digest"]).select("doc_id", "text_hash", moved.alias("spans"))
    hits = hits.unionByName(rows.filter("whole IS NOT NULL").select("doc_id", "text_hash", F.array(F.struct(F.col("first").alias("from"), (F.col("first") + F.col("whole")).alias("to"))).alias("spans")))
    found = hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    a, b = texts.select("doc_id", "text_hash", "text").alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))).select("a.*", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            data, off = tb.flat(block.column("text"))
            kept, removed, n = [], [], []
            for i, some in enumerate(block.column("spans").to_pylist()):
                cover = np.zeros(off[i + 1] - off[i] + 1, np.int64)
                np.add.at(cover, [s["from"] for s in some], 1)
                np.add.at(cover, [s["to"] + length - 1 for s in some], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept.append(data[off[i] : off[i + 1]][~gone].tobytes())
                removed.append(int(gone.sum()))
                n.append(len(_intervals(gone)))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "text_hash")), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "text_hash", "kept", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text_hash long, kept binary, n_removed long, n_spans long")


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all ``docs``."""
    changed = spans(docs, length, gram).select("doc_id", "text_hash", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "text_hash"]).alias("b")
    whole = _keyed(docs).select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")).alias("a")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return whole.join(changed, on, "left").select("a.doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
