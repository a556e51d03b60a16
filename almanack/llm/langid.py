"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time.  It reads
whole texts byte by byte, spaces, digits and marks too, from both ends, and gives
every byte a probability for each language; a document's probabilities are the
mean over all its bytes.  A text is read in windows of ``WINDOW`` bytes side by
side; each takes up its states ``CONTEXT`` bytes before its own, on both sides,
so what a byte is labelled by reaches over the window's ends.

Training sample: of every language at most ``PER_LANGUAGE`` documents, those with
the smallest hash of doc_id; with over ``LANGUAGES`` languages fewer of each, one
at least.  Of each document ``PIECES`` pieces of ``PIECE`` bytes are taken, evenly
from its beginning to its end, so the sample is bounded in bytes.  One task fits
the network to them.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows
without a language are not learnt from; of rows that repeat an id and language
one is learnt from; equal texts get equal rows; of equal probabilities the first
language by name counts; an empty table gives no rows; without any labelled row
all documents are ``und``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm import shared as shared_rows
from almanack.llm import textbytes as tb

PER_LANGUAGE, LANGUAGES, PIECES, PIECE = 400, 64, 12, 64
WINDOW, CONTEXT, LANES = 256, 16, 1024
HIDDEN, STEPS, BATCH, RATE = 8, 160, 288, 0.03
UNKNOWN = "und"
#: A filter rejects documents below this score, or below ``STANDS_OUT`` times chance where there are many languages.
LEAST, STANDS_OUT = 0.3, 1.2
_c = np.arange(256)
PLAIN = (_c >= 0x61) & (_c <= 0x7A)


class BiGRU:
    """Parameters by name; names end in the direction, f or b."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng, self.hidden, self.classes = np.random.default_rng(seed), hidden, classes
        self.p = {"c": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {"x" + d: rng.normal(0, 0.3, (256, 3 * hidden)), "u" + d: rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "q" + d: np.zeros(3 * hidden), "v" + d: rng.normal(0, hidden**-0.5, (hidden, classes))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, d: str, data: np.ndarray, size: np.ndarray, saved: list | None = None) -> np.ndarray:
        """(step, lane, unit): the states as each lane is read from its first byte on. ``data`` is (step, lane), lanes from the longest to the shortest."""
        steps, lanes = data.shape
        n, kind = self.hidden, self.p["c"].dtype
        x, u, q = self.p["x" + d], self.p["u" + d], self.p["q" + d]
        x_gates, u_gates, x_new, u_new = (np.ascontiguousarray(part) for part in (x[:, : 2 * n] + q[: 2 * n], u[:, : 2 * n], x[:, 2 * n :], u[:, 2 * n :]))
        h, out = np.zeros((lanes, n), kind), np.zeros((steps, lanes, n), kind)
        for i, on in enumerate(np.searchsorted(-size, -np.arange(steps), "left")):  # so many lanes have an i-th byte
            byte, was = data[i, :on], h[:on]
            gates = was @ u_gates
            gates += x_gates[byte]
            np.negative(gates, gates)
            np.exp(gates, gates)
            gates += 1
            np.reciprocal(gates, gates)
            z, r = gates[:, :n], gates[:, n:]
            inner = was @ u_new
            inner += q[2 * n :]
            new = r * inner
            new += x_new[byte]
            np.tanh(new, new)
            h = was - new
            h *= z
            h += new
            out[i, :on] = h
            if saved is not None:
                saved.append((was, z, r, new, inner))
        return out

    def _reversed(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each lane from its last byte to its first; its own inverse, for any array over (step, lane)."""
        at = np.maximum(size - 1 - np.arange(len(data))[:, None], 0)
        return np.take_along_axis(data, at if data.ndim == 2 else at[..., None], 0)

    def probabilities(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(position, lane, class); positions past a lane's end have no meaning."""
        ahead = self._states("f", data, size) @ self.p["vf"]
        back = self._states("b", self._reversed(data, size), size) @ self.p["vb"]
        logits = ahead + self._reversed(back, size) + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, logits)
        logits /= logits.sum(2, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradient through time."""
        steps, lanes = data.shape
        sides = {"f": data, "b": self._reversed(data, size)}
        saved: dict[str, list] = {"f": [], "b": []}
        states = {d: self._states(d, sides[d], size, saved[d]) for d in "fb"}
        logits = states["f"] @ self.p["vf"] + self._reversed(states["b"] @ self.p["vb"], size) + self.p["c"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        on, total, every = (np.arange(steps)[:, None] < size)[..., None], size.sum(), np.arange(lanes)
        loss = -(np.log(p[:, every, label] + 1e-9) * on[..., 0]).sum() / total
        p[:, every, label] -= 1
        dl = np.where(on, p / total, 0).astype(p.dtype)
        g = {"c": dl.sum((0, 1))}
        n = self.hidden
        for d in "fb":
            mine = dl if d == "f" else np.where(on, self._reversed(dl, size), 0)
            g["v" + d] = np.einsum("tbn,tbk->nk", states[d], mine)
            into = mine @ self.p["v" + d].T
            dh, dxs, dus, hs, bytes_ = np.zeros((lanes, n), p.dtype), [], [], [], []
            for i in range(steps - 1, -1, -1):
                h, z, r, new, un = saved[d][i]
                live = len(h)
                dy = dh[:live] + into[i, :live]
                dnew = dy * (1 - z) * (1 - new * new)
                dz = dy * (h - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                dxs.append(np.concatenate([dz, dr, dnew], 1))
                dus.append(np.concatenate([dz, dr, dnew * r], 1))
                hs.append(h)
                bytes_.append(sides[d][i, :live])
                dh[:live] = dy * z + dus[-1] @ self.p["u" + d].T
            dx, du, byte = np.concatenate(dxs), np.concatenate(dus), np.concatenate(bytes_)
            g["x" + d] = np.stack([np.bincount(byte, dx[:, j], 256) for j in range(3 * n)], 1).astype(p.dtype)
            g["u" + d], g["q" + d] = np.concatenate(hs).T @ du, du.sum(0)
        return float(loss), g


def lanes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(step, lane): the bytes from each place on."""
    return data[np.minimum(begin + np.arange(int(size.max(initial=1)))[:, None], len(data) - 1)]


def pieces(column: pa.Array, most: int = PIECES, piece: int = PIECE) -> list[list[bytes]]:
    """For each text up to ``most`` pieces of ``piece`` bytes, evenly from its beginning to its end."""
    data, off = tb.flat(column)
    out = []
    for a, n in zip(off[:-1].tolist(), np.diff(off).tolist()):
        k = min(most, -(-n // piece))
        at = [a + j * max(0, n - piece) // max(1, k - 1) for j in range(k)]
        out.append([tb.LOWER[data[x : min(x + piece, a + n)]].tobytes() for x in at])
    return out


def fit(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 0) -> tuple[list[str], BiGRU]:
    """Train on pieces of text; languages have equal shares of each step."""
    names = sorted({g for g, _ in samples})
    rng, model = np.random.default_rng(seed), BiGRU(max(1, len(names)), seed=seed)
    pools = {k: [b for g, b in samples if g == name and b] for k, name in enumerate(names)}
    pools = {k: v for k, v in pools.items() if v}
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1 if len(pools) > 1 else 1):
        each = max(1, BATCH // len(pools))
        some = sorted(((pool[i], k) for k, pool in pools.items() for i in rng.integers(0, len(pool), each)), key=lambda x: -len(x[0]))
        size, label = np.array([len(b) for b, _ in some]), np.array([k for _, k in some])
        data = np.frombuffer(b"".join(b for b, _ in some), np.uint8)
        _, g = model.gradients(lanes_of(data, np.cumsum(size) - size, size), size, label)
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for k, v in g.items():
            v = np.clip(v, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.99 * s[k] + 0.01 * v * v
            model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return names, model


def bucket(key: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """The bounded training sample: a row of lang and pieces (binary) for each chosen document."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    n = known.select("lang").distinct().count()
    each = per_language if n <= languages else max(1, per_language * languages // n)
    chosen = shared_rows.least_by_hash(known.select("doc_id", "lang"), "lang", "doc_id", each).distinct()
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # per_language x languages ids, or one of each language, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("lang"), pa.array(pieces(block.column("text")), pa.list_(pa.binary()))], ["doc_id", "lang", "pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, pieces array<binary>").groupBy("doc_id", "lang").agg(F.min("pieces").alias("pieces"))


def train(docs: DataFrame, learn: Column, **bounds) -> tuple[list[str], BiGRU]:
    """The languages' names and the network, fitted in one task to the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [(lang, piece) for batch in batches for lang, some in zip(batch.column("lang").to_pylist(), batch.column("pieces").to_pylist()) for piece in some]
        names, model = fit(samples)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((names, model.p))], pa.binary())], ["model"])

    rows = sample(docs, learn, **bounds).select("lang", "pieces").repartition(1).sortWithinPartitions("lang", "pieces")
    found = rows.mapInArrow(run, "model binary").first()
    names, parameters = pickle.loads(found.model) if found is not None else ([], None)
    model = BiGRU(max(1, len(names)))
    model.p = parameters or model.p
    return names, model


def pooled(model: BiGRU, low: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(text, class): the mean of the probabilities of all bytes of each text; texts laid end to end, in lower case."""
    whole = np.diff(off)
    n = -(-whole // WINDOW)
    doc = np.repeat(np.arange(len(whole)), n)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    last = np.minimum(first + WINDOW, whole[doc])
    begin = np.maximum(first - CONTEXT, 0)
    size = np.minimum(last + CONTEXT, whole[doc]) - begin
    out = np.zeros((len(whole), model.classes))
    order, lanes = np.argsort(-size, kind="stable"), LANES if model.classes <= 32 else max(16, 32 * LANES // model.classes)
    for at in range(0, len(order), lanes):
        some = order[at : at + lanes]
        p = model.probabilities(lanes_of(low, off[doc[some]] + begin[some], size[some]), size[some])
        place = np.arange(len(p))[:, None] + begin[some]
        own = (place >= first[some]) & (place < last[some])
        np.add.at(out, doc[some], np.einsum("tbk,tb->bk", p, own.astype(p.dtype)))
    return out / np.maximum(whole, 1)[:, None]


def _predict(block: pa.RecordBatch, names: list[str], model: BiGRU) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of a block."""
    column = block.column("text")
    data, off = tb.flat(column)
    low = tb.LOWER[data]
    has = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) > 0
    plain, more = has(PLAIN[low]), has(low >= 0x80)
    known = np.array([bool(names) and bool(a or (b and any(map(str.isalpha, column[i].as_py())))) for i, (a, b) in enumerate(zip(plain, more))], bool)
    p = pooled(model, low, off)
    return [names[b] if ok else UNKNOWN for b, ok in zip(p.argmax(1), known)], np.where(known, np.clip(p.max(1), 0, 1), 0.0)


def label(docs: DataFrame, names: list[str], model: BiGRU, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None) and lang_pred and score, the largest of the document's probabilities; they replace columns of those names."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    docs = docs.select(*dict.fromkeys([*carry, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast((names, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            out, score = _predict(block, *shared.value)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carry), pa.array(out, pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    kinds = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, kinds)


def keep(docs: DataFrame, names: list[str], model: BiGRU, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` with a language of at least that score, whatever its columns; by default one in which a language stands out."""
    least = min(LEAST, STANDS_OUT / max(1, len(names))) if least is None else least
    shared = docs.sparkSession.sparkContext.broadcast((names, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            out, score = _predict(block, *shared.value)
            yield block.filter(pa.array((np.array(out) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
