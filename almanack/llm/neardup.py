"""Near-duplicate classes by DartMinHash, banding, exact checks and components.

Signatures: every element of a document owns a region as wide as its weight;
darts fall on it in the order of their rank (a Poisson process whose places come
from hashes of the element alone, so they are the same in all documents), each
dart aims at one of ``K`` coordinates, and a coordinate keeps the dart of the
lowest rank.  Only ranks up to t / weight are thrown, about t darts a document
whatever its length; where a coordinate is still empty the bound is doubled.
Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.  Elements are runs of five words.  One weight decides the
regions and the links: 1 for each distinct run, so both go by the similarity of
sets, however long the words are; or, with ``counted``, the times that a run
occurs (one line that is repeated often then makes texts alike).

Joining: equal texts are one node.  Nodes that agree in all ``ROWS`` coordinates
of one of ``BANDS`` bands share a bucket.  Each bucket compares all its nodes
with its least node, by the exact similarity of their texts, and components are
taken of the links.  Then, in buckets that have nodes of more components than
one, the nodes outside the bucket's largest component meet its nodes of other
components: those of about their size, as sizes of similar texts differ by a
quarter at most, in blocks of ``BLOCK`` by ``BLOCK`` over an inverted index; a
block gives back only links that join components.  So no pair of a bucket is
left out, and no list of pairs is made.  A pair of similarity 0.8 misses all
buckets with probability (1 - 0.8^5)^28, 0.00002.

Edge cases: null text counts as empty; texts without words are alike only if
equal; a text of under five words is one run; a null doc_id belongs to its
text's class; a class without any doc_id, and all but one of the classes whose
least doc_id is the same repeated id, have a class_id of their own, a negative
hash (for ids that are strings, the hash of a text), so that no two classes share
one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import shared
from almanack.llm import textbytes as tb
from almanack.operators import graph

WORDS, SIMILAR, ROWS, BANDS, BLOCK = 5, 0.8, 5, 28, 500
K = ROWS * BANDS
_TO_UNIT = 2.0**-53


def _unit(h: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * _TO_UNIT


def dart_signatures(element: np.ndarray, weight: np.ndarray, offs: np.ndarray, k: int = K) -> np.ndarray:
    """A row of ``k`` dart ids for each document; its elements are distinct hashes, with positive weights. Documents without elements get zeros."""
    n = len(offs) - 1
    out = np.zeros((n, k), np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    total = np.bincount(doc, weight, n)
    cells = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed, over, doc = tb.mix(element[at] + cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), weight[at] - cell, doc[at]
    reach = k * (log(k) + 3) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[doc])
        s, d, w, bound = seed[live], doc[live], over[live], reach[doc[live]]
        rank, best = np.zeros(len(live)), np.full(n * k, np.inf)
        darts = []
        nth = 0
        while len(s):
            nth += 1
            h = tb.mix(s + np.array([nth], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_unit(h))
            on = rank <= bound
            s, d, w, bound, rank, h = s[on], d[on], w[on], bound[on], rank[on], h[on]
            aim = tb.mix(h + np.uint64(0xA24BAED4963EE407))
            inside = _unit(tb.mix(aim)) <= w  # the dart's place across the cell
            slot = d[inside] * k + (aim[inside] % np.uint64(k)).astype(np.int64)
            darts.append((slot, rank[inside], h[inside]))
            np.minimum.at(best, slot, rank[inside])
        flat = out.reshape(-1)
        for slot, r, h in darts:
            first = r == best[slot]
            flat[slot[first]] = h[first]
        todo &= np.isinf(best.reshape(n, k)).any(1)
        reach[todo] *= 2
    return out


def elements(column: pa.Array, counted: bool = False, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``n`` words, their weights, and the offsets of the texts in them."""
    words = tb.Words(column)
    h, offs = tb.shingles(words.hashes(), words.of, n)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    offsets = np.searchsorted(doc[first], np.arange(len(offs)))
    weight = np.diff(np.append(first, len(h))).astype(float) if counted else np.ones(len(first))
    return h[first], weight, offsets


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, k = signature.shape
    grid = signature.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), (n, k // rows))
    for j in range(rows):
        key = tb.mix(key * np.uint64(3) + grid[:, :, j])
    return key


def node(text: str = "text"):
    """What equal texts have in common: 128 bits."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")))


def buckets(texts: DataFrame, counted: bool) -> DataFrame:
    """(key, node, size, hub, hub_size) once each, of keys that more than one node has; hub is the least of them, size the weight of a node's runs. A table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for block in tb.blocks(batches):
            names = block.column("node").to_pylist()
            fresh = []
            for i, name in enumerate(names):
                if name not in seen:  # the copies of a task need one signature
                    seen.add(name)
                    fresh.append(i)
            if len(seen) > 500_000:
                seen.clear()
            e, w, offs = elements(block.column("text").take(pa.array(fresh, pa.int64())), counted)
            some = np.flatnonzero(np.diff(offs))
            keys = band_keys(dart_signatures(e, w, offs))[some]
            size = np.bincount(np.repeat(np.arange(len(fresh)), np.diff(offs)), w, len(fresh))[some]
            owner = pa.array(np.repeat(np.array(fresh, np.int64)[some], keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), block.column("node").take(owner), pa.array(np.repeat(size, keys.shape[1]), pa.float32())], ["key", "node", "size"])

    rows = shared.table(texts.mapInArrow(run, "key long, node binary, size float"), "neardup-bands")
    several = rows.groupBy("key").agg(F.min(F.struct("node", "size")).alias("hub"), F.max("node").alias("top")).filter("hub.node <> top").select("key", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))
    return shared.table(rows.join(several, "key").distinct(), "neardup-buckets")


def verified(pairs: DataFrame, texts: DataFrame, counted: bool, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts (one row for each node) have at least the similarity; a table."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in tb.blocks(batches, "text_a"):
            for block in tb.slices(big, "text_b"):
                x, y = elements(block.column("text_a"), counted), elements(block.column("text_b"), counted)
                keep = []
                for i in range(block.num_rows):
                    p, q = slice(x[2][i], x[2][i + 1]), slice(y[2][i], y[2][i + 1])
                    _, at, to = np.intersect1d(x[0][p], y[0][q], True, True)
                    common = np.minimum(x[1][p][at], y[1][q][to]).sum()
                    whole = x[1][p].sum() + y[1][q].sum() - common
                    keep.append(bool(whole) and common >= similar * whole - 1e-9)
                yield block.select(["a", "b"]).filter(pa.array(keep))

    return shared.table(both.mapInArrow(run, "a binary, b binary"), "neardup-links")


def meet(mixed: DataFrame, texts: DataFrame, counted: bool, similar: float) -> DataFrame:
    """Links between components, from all pairs of a bucket that could be similar and of which at least one node is outside the bucket's main component.

    Nodes of a bucket of over ``BLOCK`` go to cells by the logarithm of their size, each to its own cell and the one
    below: similar texts are at most one step apart.  ``mixed``: key, node, size, root, main. A table.
    """
    is_rest = F.col("root") != F.col("main")
    large = mixed.groupBy("key").agg((F.count("*") > BLOCK).alias("large"))
    step = F.floor(F.log(F.col("size")) / F.lit(1.000001 * log(1 / similar))).cast("int")
    placed = mixed.join(large, "key").withColumn("cell", F.explode(F.when(F.col("large"), F.array(step, step - 1)).otherwise(F.array(F.lit(0))))).drop("large", "size")
    many = placed.groupBy("key", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum(is_rest.cast("int")) / BLOCK).cast("int").alias("chunks")).filter("chunks > 0")
    rows = placed.join(many, ["key", "cell"]).join(texts, "node").withColumn("h", F.xxhash64("node"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = rows.filter(is_rest).select("key", "cell", F.pmod("h", F.col("chunks")).cast("int").alias("i"), F.explode(upto("blocks")).alias("j"), F.lit(True).alias("rest"), "node", "root", "text")
    right = rows.select("key", "cell", F.explode(upto("chunks")).alias("i"), F.pmod("h", F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("rest"), "node", "root", "text")

    def cell(table: pa.Table) -> pa.Table:
        n = table.num_rows
        parts = [elements(b.column("text"), counted) for batch in table.combine_chunks().to_batches() for b in tb.slices(batch)]
        h, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        size = np.concatenate([np.diff(p[2]) for p in parts])
        offs = np.concatenate([[0], np.cumsum(size)])
        total = np.bincount(np.repeat(np.arange(n), size), w, n)
        rest = table.column("rest").to_numpy()
        name, root = table.column("node").to_pylist(), table.column("root").to_pylist()
        parent = {r: r for r in root}

        def find(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        owner = np.repeat(np.arange(n), size)
        member = ~rest[owner]
        order = np.argsort(h[member], kind="stable")
        keys, own, weight = h[member][order], owner[member][order], w[member][order]
        found = []
        for x in np.flatnonzero(rest):
            mine, mw = h[offs[x] : offs[x + 1]], w[offs[x] : offs[x + 1]]
            low = np.searchsorted(keys, mine)
            k = np.searchsorted(keys, mine, "right") - low
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low, k)
            common = np.bincount(own[at], np.minimum(weight[at], np.repeat(mw, k)), n)
            whole = total[x] + total - common
            for y in np.flatnonzero((common > 0) & (common >= similar * whole - 1e-9)):
                p, q = find(root[x]), find(root[y])
                if p != q:
                    parent[p] = q
                    found.append((name[x], name[y]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return shared.table(left.unionByName(right).groupBy("key", "cell", "i", "j").applyInArrow(cell, "a binary, b binary"), "neardup-met")


def rooted(docs: DataFrame, counted: bool = False, similar: float = SIMILAR) -> DataFrame:
    """doc_id, node (of its text), root (of its class, which it alone identifies), n_links (verified links of its text); a table."""
    texts = docs.select(node().alias("node"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bands = buckets(texts, counted)
    some = shared.table(texts.join(bands.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "neardup-texts")
    can_be = F.least("size", "hub_size") >= similar * F.greatest("size", "hub_size") * (1 - 1e-6)  # else the sizes alone rule it out
    pairs = bands.filter("node > hub").filter(can_be).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(pairs, some, counted, similar)
    of = shared.table(bands.select("key", "node", "size").join(graph.components(links), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "neardup-roots")
    sizes = of.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", F.col("main.root").alias("main"))
    links = links.union(meet(of.join(main, "key"), some, counted, similar)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = graph.components(links).join(degree, "node")
    named = docs.select("doc_id", node().alias("node")).join(found, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return shared.table(named, "neardup-named")


def classes(docs: DataFrame, counted: bool = False, similar: float = SIMILAR) -> DataFrame:
    """doc_id, node (of its text), class_id (the least doc_id of its class, or its own name where that does not tell it apart), class_size, n_links.

    n_links counts the links of a row's text that were verified: those to the least text of a bucket, and those that
    join components; not all pairs of a class are compared.
    """
    named = rooted(docs, counted, similar)
    whole = named.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    whole = shared.table(whole, "neardup-least")
    again = whole.filter("least IS NOT NULL").groupBy("least").agg(F.min("root").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    own = F.concat(F.lit("class-"), F.lower(F.hex("root"))) if whole.schema["least"].dataType.simpleString() == "string" else F.xxhash64("root").bitwiseOR(F.lit(-(1 << 63)))
    is_own = F.col("least").isNull() | (F.col("root") != F.col("holder"))
    whole = shared.table(whole.join(again, "least", "left").select("root", F.when(is_own, own).otherwise(F.col("least")).alias("class_id"), "class_size"), "neardup-classes")  # so that the join below can split a large class
    return named.join(whole, "root").select("doc_id", "node", "class_id", "class_size", "n_links")


def keep(docs: DataFrame, counted: bool = False, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of a smaller doc_id; of each class one row stays, also where ids are null or repeated."""
    found = rooted(docs.select("doc_id", "text"), counted, similar)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("x")).select("x.doc_id", "x.node")
    a, b = docs.withColumn("__node", node()).alias("a"), first.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__node") == F.col("b.node"))).dropDuplicates(["doc_id", "__node"]).select(*(F.col(f"a.{c}") for c in docs.columns))
