"""How many rules of a table of any size a text has, and the heaviest of them, without a shuffle of the texts' parts.

Texts are dealt in blocks of about ``BLOCK`` bytes.  A block's runs of words that may be
rules are told by a broadcast sieve (each pair of adjoining words, and each whole
run of three words or more, is one of some rule's), and each distinct run leaves the
block once, as its characters, whatever texts have it how often.  Runs and rules meet
in buckets of hashes and are compared as strings; back to the block go a bit a run and
the weights of those found, in the order in which the block sent them, and the block
counts them by text.  What is written grows with the texts and the rules: no run is
sent for each text, and a common one is a row a block at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from almanack.sources import tables

#: Bytes of text of a block, and of those whose runs are counted at once; rules, and bytes of text, that are one bucket's; bits of a sieve at most, as a power of two.
BLOCK, CHUNK, RULES, TEXT, SIEVE = 12 << 20, 2 << 20, 400_000, 8 << 20, 28
_FLUSH, _SLICE, _BITS = 1 << 18, 16, 8
_ODD, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def spelled(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, with a blank between two: the words of ``phrases.words``."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.StringArray) -> np.ndarray:
    """A hash of each word, none of them empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD))
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    return _mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], starts) + sizes.astype(np.uint64))


class _Words:
    """Texts of words, none of them empty, as numbers of distinct words; the hash of each word, and where each one's text ends."""

    def __init__(self, texts: pa.StringArray) -> None:
        split = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(split.flatten())
        self.distinct, self.ids = coded.dictionary, coded.indices.to_numpy()
        offsets = split.offsets.to_numpy()
        self.starts, self.sizes = offsets[:-1].astype(np.int64) - offsets[0], np.diff(offsets)
        self.ends = np.repeat((self.starts + self.sizes).astype(np.int32), self.sizes)
        self.hashes = _word_hashes(self.distinct)[self.ids]

    def gram(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each place."""
        h = self.hashes[at]
        for j in range(1, n):
            h = _mix(h * _NEXT + self.hashes[at + j])
        return h

    def pairs(self) -> np.ndarray:
        """The hash of each word and the next, whatever text that is in."""
        return _mix(self.hashes[:-1] * _NEXT + self.hashes[1:])

    def same(self, at: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the ``n`` words from each place that are equal where all the words are."""
        same = self.ids[at].astype(np.int64)
        for j in range(1, n):
            if j > 1:
                same = np.unique(same, return_inverse=True)[1]
            same = (same << 32) | self.ids[at + j]
        return same

    def spell(self, at: np.ndarray, n: int) -> pa.StringArray:
        parts = [self.distinct.take(pa.array(self.ids[at + j])) for j in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]

    def whole(self) -> np.ndarray:
        """The hash of each whole text."""
        h = self.hashes[self.starts]
        for j in range(1, int(self.sizes.max(initial=0))):
            longer = np.flatnonzero(self.sizes > j)
            h[longer] = _mix(h[longer] * _NEXT + self.hashes[self.starts[longer] + j])
        return h


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


class _Runs:
    """The distinct runs of a block that pass the sieves, in an order that only they decide; ``texts`` and ``runs``: which text has which."""

    def __init__(self, texts: pa.StringArray, sieves: list[np.ndarray], sizes: list[int]) -> None:
        self.words = w = _Words(texts)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), w.sizes)
        inner = np.zeros(len(w.ids), bool)
        if max(sizes) > 1:
            inner[:-1] = _set(sieves[0], w.pairs())
        hashes, first, length, texts_, runs, n_runs = [], [], [], [], [], 0
        for n in sizes:
            at = np.flatnonzero(_set(sieves[0], w.hashes)) if n == 1 else np.flatnonzero(inner)
            if n > 1:
                at = at[at + n <= w.ends[at]]
                for j in range(1, n - 1):
                    at = at[inner[at + j]]
            h = w.gram(at, n)
            if n > 2:
                passed = _set(sieves[1], h)
                at, h = at[passed], h[passed]
            _, one, which = np.unique(w.same(at, n), return_index=True, return_inverse=True)
            hashes.append(h[one])
            first.append(at[one])
            length.append(np.full(len(one), n))
            texts_.append(doc[at])
            runs.append(which + n_runs)
            n_runs += len(one)
        hashes, self.first, self.length = map(np.concatenate, (hashes, first, length))
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        alike = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        for group in np.split(alike, np.flatnonzero(np.diff(alike) > 1) + 1) if len(alike) else ():  # runs of one hash, hardly ever: by their characters
            own = order[group[0] : group[-1] + 2]
            order[group[0] : group[-1] + 2] = own[np.argsort(np.array(self._spell(own).to_pylist(), object))]
        self.first, self.length = self.first[order], self.length[order]
        rank = np.empty(n_runs, np.int64)
        rank[order] = np.arange(n_runs)
        self.texts, self.runs = np.concatenate(texts_), rank[np.concatenate(runs)]

    def _spell(self, which: np.ndarray) -> pa.StringArray:
        out, order = [], []
        for n in np.unique(self.length[which]):
            own = np.flatnonzero(self.length[which] == n)
            out.append(self.words.spell(self.first[which[own]], int(n)))
            order.append(own)
        place = np.empty(len(which), np.int64)
        place[np.concatenate(order)] = np.arange(len(which))
        return pa.concat_arrays(out).take(pa.array(place))

    def spell(self, low: int, high: int) -> pa.StringArray:
        return self._spell(np.arange(low, high))

    def cuts(self, bits: int) -> np.ndarray:
        """Where each bucket's runs begin, and the last one's end."""
        return np.searchsorted(self.hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), "zstd", asbytes=True)


def _pack_names(names: pa.StringArray) -> bytes:
    values = pa.LargeListArray.from_arrays(pa.array([0, len(names)], pa.int64()), names)
    return _pack(pc.binary_join(values, "\n")[0].as_py().encode())


def _unpack_names(blob: bytes) -> pa.StringArray:
    return pc.split_pattern(pa.array([_unpack(blob).decode()]), "\n").flatten()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``_FLUSH`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= _FLUSH:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if any(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their keys by block, compressed for the shuffle."""
    for batch in batches:
        block = batch["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        rows = pa.table([batch["key"], batch["text"]], ["key", "text"]).take(pa.array(order))
        blocks, first = np.unique(block[order], return_index=True)
        out = []
        for a, b in zip(first, [*first[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(rows.slice(a, b - a).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(out, pa.binary())], ["block", "rows"])


def _unfolded(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in table["rows"]).combine_chunks()


def _only(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _sieves(rules: DataFrame, counts: dict[int, int]) -> list[np.ndarray]:
    """Bits of the single words and pairs that rules have, and of whole rules of three words or more; 2^``SIEVE`` of each at most."""
    long = sum(c for n, c in counts.items() if n > 2)
    bits = [min(SIEVE, max(_SLICE, (_BITS * n - 1).bit_length())) for n in (2 * max(sum(counts.values()) - long, long // 4), long)]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            w = _Words(_only(table["name"]))
            pairs = w.pairs()[np.arange(1, len(w.ids)) < w.ends[:-1]]
            for k, h in enumerate((np.concatenate([w.hashes[w.starts[w.sizes == 1]], pairs]), w.whole()[w.sizes > 2])):
                at = np.unique(h & np.uint64((1 << bits[k]) - 1))
                slices, first = np.unique(at >> np.uint64(_SLICE), return_index=True)
                low = (at & np.uint64((1 << _SLICE) - 1)).astype("<u2")
                blobs = [x.tobytes() for x in np.split(low, first[1:])] if len(slices) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slices), k, np.int32)), pa.array(slices.astype(np.int32)), pa.array(blobs, pa.binary())], ["sieve", "slice", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        block = np.zeros(1 << _SLICE, bool)
        for blob in table["bits"]:
            block[np.frombuffer(blob.as_py(), "<u2")] = True
        return pa.table([table["sieve"][:1], table["slice"][:1], pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())], ["sieve", "slice", "bits"])

    row = "sieve int, slice int, bits binary"
    out = [np.zeros(1 << (b - 3), np.uint8) for b in bits]
    found = rules.select("name").mapInArrow(places, row).groupBy("sieve", "slice").applyInArrow(joined, row).toArrow()  # 64 MB at most, whatever the rules
    for k, at, blob in zip(found["sieve"].to_pylist(), found["slice"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[k][at << (_SLICE - 3) : (at + 1) << (_SLICE - 3)] = np.frombuffer(blob, np.uint8)
    return out


def _buckets(hashes: np.ndarray, names: pa.StringArray, weights: np.ndarray, bits: int) -> pa.RecordBatch:
    """Names and weights by bucket, packed."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, weights = names.take(pa.array(order)), weights[order].astype("<i8")
    buckets, first = np.unique(bucket[order], return_index=True)
    cuts = list(zip(first, [*first[1:], len(order)], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array([_pack_names(names[a:b]) for a, b in cuts], pa.binary()), pa.array([_pack(weights[a:b].tobytes()) for a, b in cuts], pa.binary())], ["bucket", "names", "weights"])


def _weighed(table: pa.Table) -> tuple[pa.StringArray, np.ndarray]:
    """The names and weights of a bucket."""
    return pa.concat_arrays([_unpack_names(x.as_py()) for x in table["names"]]), np.concatenate([np.frombuffer(_unpack(x.as_py()), "<i8") for x in table["weights"]])


def _dealt(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rules by bucket."""
        for table in _gathered(batches):
            names = _only(table["name"])
            yield _buckets(_Words(names).whole(), names, table["weight"].to_numpy(), bits)

    return run


def _said(bits: int, sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of texts and how often there are, by bucket."""
        for batch in batches:
            texts = batch["text"]
            cuts = np.searchsorted(np.cumsum(pc.binary_length(texts).to_numpy()), np.arange(1, texts.nbytes // CHUNK + 1) * CHUNK)
            for low, high in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                if low == high:
                    continue
                w = _Words(texts[low:high])
                for n in sizes:
                    at = np.flatnonzero(np.arange(n, len(w.ids) + n) <= w.ends)
                    _, one, often = np.unique(w.same(at, n), return_index=True, return_counts=True)
                    at = at[one]
                    if len(at):
                        yield _buckets(w.gram(at, n), w.spell(at, n), often, bits)

    return run


def _summed(table: pa.Table) -> pa.Table:
    names, weights = _weighed(table)
    sums = pa.table([names, pa.array(weights)], ["phrase", "weight"]).group_by("phrase").aggregate([("weight", "sum")])
    return pa.table([sums["phrase"], sums["weight_sum"]], ["phrase", "weight"])


def said(df: DataFrame, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """(phrase, weight): each run of so many words that the texts have, and how often."""
    tables.ship(df.sparkSession)
    with tables.passing(df.sparkSession):
        total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(1, (total * len(sizes) // (6 * RULES)).bit_length())
    rows = df.select(spelled(F.col(text)).alias("text")).filter("text <> ''")
    return rows.mapInArrow(_said(bits, sizes), "bucket int, names binary, weights binary").groupBy("bucket").applyInArrow(_summed, "phrase string, weight long")


def _met(rules: pa.Table, runs: pa.Table) -> pa.Table:
    """For each block's runs of a bucket that has some rule: which are rules, and the weights of those."""
    out: list[tuple[int, int, bytes]] = []
    if len(rules) and len(runs):
        names, weights = _weighed(rules)
        own = [_unpack_names(x.as_py()) for x in runs["names"]]
        at = pc.index_in(pa.concat_arrays(own), value_set=names)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        for block, bucket, x in zip(runs["block"].to_pylist(), runs["bucket"].to_pylist(), np.split(at, np.cumsum([len(x) for x in own])[:-1]), strict=True):
            if (hit := x >= 0).any():
                out.append((block, bucket, _pack(np.packbits(hit).tobytes() + weights[x[hit]].tobytes())))
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["block", "bucket", "found"])


def _counted(keys: pa.Array, texts: pa.StringArray, found: pa.Table, sieves: list[np.ndarray], sizes: list[int], bits: int) -> tuple[pa.Array, ...]:
    """Key, number of rules, largest weight and the first rule of that weight, for the keys of a block that have any."""
    runs = _Runs(texts, sieves, sizes)
    cuts = runs.cuts(bits)
    hit, weight = np.zeros(len(runs.hashes), bool), np.zeros(len(runs.hashes), np.int64)
    for bucket, blob in zip(found["bucket"].to_pylist(), found["found"].to_pylist(), strict=True):
        low, high = cuts[bucket], cuts[bucket + 1]
        raw, flags = _unpack(blob), -(-(high - low) // 8)
        hit[low:high] = np.unpackbits(np.frombuffer(raw[:flags], np.uint8), count=high - low).astype(bool)
        weight[low:high][hit[low:high]] = np.frombuffer(raw[flags:], "<i8")
    coded = pc.dictionary_encode(keys, null_encoding="encode")
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = hit[runs.runs]
    pairs = np.unique(key[runs.texts[own]] * len(hit) + runs.runs[own])
    doc, run = pairs // max(1, len(hit)), pairs % max(1, len(hit))
    docs, first = np.unique(doc, return_index=True)
    if not len(docs):
        return tuple(pa.array([], t) for t in (keys.type, pa.int64(), pa.int64(), pa.string()))
    n = np.diff([*first, len(doc)])
    most = np.maximum.reduceat(weight[run], first)
    best = np.flatnonzero(weight[run] == np.repeat(most, n))
    tied, which = np.unique(run[best], return_inverse=True)
    names = runs._spell(tied)
    order = pc.sort_indices(names.cast(pa.binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, begins = np.unique(doc[best], return_index=True)
    least = np.minimum.reduceat(rank[which], begins)
    return coded.dictionary.take(pa.array(docs)), pa.array(n.astype(np.int64)), pa.array(most), names.take(pa.array(order[least]))


def _sent(sieves: Broadcast, sizes: list[int], bits: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's runs by bucket."""
        own = _Runs(_only(_unfolded(table)["text"]), sieves.value, sizes)
        cuts = own.cuts(bits)
        some = np.flatnonzero(np.diff(cuts))
        blobs = [_pack_names(own.spell(cuts[b], cuts[b + 1])) for b in some]
        return pa.table([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), table["block"][0].as_py(), np.int32)), pa.array(blobs, pa.binary())], ["bucket", "block", "names"])

    return run


def _result(sieves: Broadcast, sizes: list[int], bits: int, schema: pa.Schema):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table) or not len(found):
            return schema.empty_table()
        rows = _unfolded(table)
        return pa.table(list(_counted(_only(rows["key"]), _only(rows["text"]), found, sieves.value, sizes, bits)), schema.names)

    return run


def counted(df: DataFrame, key: str, text: str, rules: DataFrame, phrase: str, weight: str, clean: bool = False) -> DataFrame:
    """(key, n_rules, weight, phrase) for each key whose texts have any of the rules: how many, and the heaviest, of equals the first by its bytes.

    ``rules`` has each phrase once, as ``spelled`` spells it; others, and rules without
    words, are never found.  A rule has a weight.  Work grows with the number of different
    numbers of words.
    """
    spark = df.sparkSession
    tables.ship(spark)
    with tables.passing(spark):
        named = rules.select(F.col(phrase).alias("name"), F.col(weight).cast("long").alias("weight"))
        own = named if clean else named.filter((F.col("name") != "") & (F.col("name") == spelled(F.col("name"))))
        kept = tables.settle(own, "rules", compression="zstd")
        words = F.length("name") - F.length(F.translate("name", " ", "")) + 1
        counts = {r["size"]: r["count"] for r in kept.groupBy(words.alias("size")).count().collect()}
        total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        row = StructType([StructField(key, df.schema[key].dataType), StructField("n_rules", LongType()), StructField("weight", LongType()), StructField(phrase, StringType())])
        if not counts:
            return spark.createDataFrame([], row)
        blocks, sizes = -(-total // BLOCK) + 1, sorted(counts)
        bits = max(1, (max(-(-sum(counts.values()) // RULES), -(-total // TEXT)) - 1).bit_length())
        sieves = spark.sparkContext.broadcast(_sieves(kept, counts))
        dealt = kept.mapInArrow(_dealt(bits), "bucket int, names binary, weights binary")
        read = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), spelled(F.col(text)).alias("text")).filter("text <> ''")
        texts = read.mapInArrow(_folded, "block int, rows binary").groupBy("block")
        runs = texts.applyInArrow(_sent(sieves, sizes, bits), "bucket int, block int, names binary")
        met = dealt.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_met, "block int, bucket int, found binary")
        found = tables.settle(met, "found")
        tables.discard(kept)
    return texts.cogroup(found.groupBy("block")).applyInArrow(_result(sieves, sizes, bits, to_arrow_schema(row)), row)
