"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features of a text: its words, pairs of adjoining words and pairs with one word
between them, each present or not, hashed to 2^``BITS`` places.  Each place has
its own learning rate, and the L1 term leaves most weights at zero, so what is
broadcast is a short list.

Training sample: of each label at most ``PER_LABEL`` labelled texts, those with
the smallest hash of doc_id.  Their texts become places where they are read; what
is shuffled are these.  Three models are fitted side by side, each in a task: one
of all rows, and one of either half, which the other half's scores are taken from.

Edge cases: null or empty text has the score of the bias alone; labels that are
null, or that name no document, are not learnt from; of rows that repeat a
doc_id one is learnt from, with the larger of its labels; equal texts have equal
scores; an empty table gives no rows; without labels all scores are just
below 0.5, so nothing is called toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm import shared as shared_rows
from almanack.llm import textbytes as tb

BITS, PER_LABEL = 20, 6000
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 3.0, 0.0, 8


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features and the text of each; repeats are still in."""
    words = tb.Words(column)
    h = words.hashes()
    doc = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
    keys, docs = [tb.mix(h + np.uint64(1))], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            keys.append(tb.mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] + np.uint64(gap * 7919)))
            docs.append(doc[:-gap][same])
    return (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(docs)


def distinct(place: np.ndarray, doc: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc << bits | place)
    return key & ((1 << bits) - 1), key >> bits


class FTRL:
    """Follow the regularised leader, proximal, for logistic loss; the last place is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0  # of the bias
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, label: int) -> float:
        at = np.append(places, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> FTRL:
    """A model of ``rows`` (places, label), in an order drawn anew for each epoch."""
    model = FTRL(bits)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*rows[i])
    return model


def shift(margin: np.ndarray, label: np.ndarray) -> float:
    """By how much the bias moves, as rare labels leave scores low: 0.5 goes where it separates ``margin`` best (F1; the middle of the best range)."""
    if not 0 < label.sum() < len(label):
        return 0.0
    order = np.argsort(-margin, kind="stable")
    x, hits = margin[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(label) + 1) + label.sum())
    best = int(f1.argmax())
    return -float(x[best] + x[min(best + 1, len(x) - 1)]) / 2


def bucket(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, text, toxic of the bounded training sample."""
    marked = labels.filter(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = shared_rows.least_by_hash(marked, "toxic", "doc_id", per_label)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 x per_label rows at most


def places(rows: DataFrame) -> DataFrame:
    """doc_id, toxic and places of the sampled texts, one row for each doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            place, doc = distinct(*features(block.column("text")))
            cuts = np.searchsorted(doc, np.arange(block.num_rows + 1))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("toxic"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place, pa.int32()))], ["doc_id", "toxic", "places"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind('doc_id')}, toxic {kind('toxic')}, places array<int>").groupBy("doc_id", "toxic").agg(F.min("places").alias("places"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't zero; the last is the bias."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        listed = table.column("places").chunk(0)
        values, offs = listed.values.to_numpy(), listed.offsets.to_numpy()
        rows = [(values[a:b], y) for a, b, y in zip(offs[:-1], offs[1:], table.column("toxic").to_pylist())]
        part = table.column("part")[0].as_py()
        w = fit(rows if part == 2 else rows[part::2], epochs=epochs).weights()
        if part == 2:
            at = np.flatnonzero(w)
            at = at if len(at) and at[-1] == len(w) - 1 else np.append(at, len(w) - 1)
            return pa.table({"place": pa.array(at), "value": pa.array(w[at]), "toxic": pa.nulls(len(at), pa.int32())})
        others = rows[1 - part :: 2]
        return pa.table({"place": pa.nulls(len(others), pa.int64()), "value": pa.array([float(w[p].sum() + w[-1]) for p, _ in others], pa.float64()), "toxic": pa.array([y for _, y in others], pa.int32())})

    rows = places(sample(docs, labels, learn, per_label)).select("doc_id", F.xxhash64("doc_id").alias("h"), F.col("toxic").cast("int").alias("toxic"), "places")
    each = rows.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).repartitionByRange(3, "part")
    found = each.groupBy("part").applyInArrow(run, "place long, value double, toxic int").toPandas()  # 2^BITS + 1 weights, most of them zero and left out, and a margin for each sampled row
    weight, margin = found[found["place"].notna()].sort_values("place"), found[found["place"].isna()].sort_values(["value", "toxic"])
    if not len(weight):
        return np.array([1 << BITS]), np.zeros(1)
    at, value = weight["place"].to_numpy().astype(np.int64), weight["value"].to_numpy().copy()
    value[-1] += shift(margin["value"].to_numpy(), margin["toxic"].to_numpy().astype(np.int64))
    return at, value


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) and score, the probability of label 1."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    docs = docs.select(*dict.fromkeys([*carry, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int64), weights[1].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = shared.value
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[at] = value
        bias = float(w[-1]) or -1e-3
        for block in tb.blocks(batches):
            place, doc = features(block.column("text"))
            some = w[place] != 0
            place, doc = distinct(place[some], doc[some])
            x = bias + np.bincount(doc, w[place], block.num_rows)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carry), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], [*carry, "score"])

    return docs.mapInArrow(run, docs.select(*carry).schema.add("score", "double"))
