"""Token ids of whole texts with public tokenizers, each distinct piece encoded once.

A pre-tokenizer never joins what stands on the two sides of a cut made here, so
the ids of a text are those of its pieces, one after the other.  Texts repeat
their pieces, so few of them reach the encoder.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from almanack.llm import textbytes as tb

#: Distinct pieces, and bytes of them, that a worker remembers before it starts anew.
CACHE_PIECES, CACHE_BYTES = 1_500_000, 64 << 20
_SPACES = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
_c = np.arange(256)
#: First bytes of characters that are no white space: printable ASCII, and lead bytes without any (C2, E1, E2 and E3 have some).
_SOLID = ((_c >= 0x21) & (_c <= 0x7E)) | ((_c >= 0xC3) & ~np.isin(_c, [0xE1, 0xE2, 0xE3]))


class Encoder:
    """``keep_space``: a space belongs to the word after it (byte-level BPE); else white space is dropped by the tokenizer."""

    def __init__(self, path: str, keep_space: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token of a byte-level vocabulary, in which a character stands for a byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._reset()

    def _reset(self) -> None:
        #: Sorted runs of (hash, entry); entry i has ids[offs[i]:offs[i + 1]] and is the piece text[at[i]:at[i + 1]].
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids, self.offs, self.n = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 0
        self.text, self.at = np.zeros(1 << 20, np.uint8), np.zeros(1 << 18, np.int64)

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not len(data):
            return off[:1]
        if self.keep_space:
            cut = np.zeros(len(data), bool)
            cut[:-1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
        else:
            cut = _SPACES[data]
        cut[off[:-1][off[:-1] < len(data)]] = True
        return np.append(np.flatnonzero(cut), len(data))

    def _find(self, h: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 if it isn't known; pieces of one hash are told apart by their bytes."""
        entry = np.full(len(h), -1, np.int64)
        for hs, es in self.runs:
            at = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
            hit = hs[at] == h
            entry[hit] = es[at[hit]]
        some = np.flatnonzero(entry >= 0)
        own, size = self.at[entry[some]], np.diff(off)[some]
        same = self.at[entry[some] + 1] - own == size
        some, own, size = some[same], own[same], size[same]
        entry[np.setdiff1d(np.flatnonzero(entry >= 0), some, assume_unique=True)] = -1
        ends = np.cumsum(size)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        differs = data[step + np.repeat(off[some], size)] != self.text[step + np.repeat(own, size)]
        entry[some[np.unique(np.searchsorted(ends, np.flatnonzero(differs), "right"))]] = -1
        return entry

    def _remember(self, h: np.ndarray, entry: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        run = (h[order], entry[order])
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):
            both = [np.concatenate(x) for x in zip(self.runs.pop(), run)]
            order = np.argsort(both[0], kind="stable")
            run = tuple(x[order] for x in both)
        self.runs.append(run)

    def _joinable(self, pieces: pa.Array) -> np.ndarray:
        """Pieces that may stand one after the other: each begins with a space and a solid character, where nothing is joined."""
        data, off = tb.flat(pieces)
        out = np.zeros(len(pieces), bool)
        if self.keep_space:
            two = np.flatnonzero(np.diff(off) >= 2)
            out[two] = (data[off[two]] == 0x20) & _SOLID[data[off[two] + 1]]
        return out

    def _store(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        data, off = tb.flat(pieces)
        filled, written = self.offs[self.n], self.at[self.n]
        while filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while written + len(data) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.ids[filled : filled + len(ids)] = ids
        self.text[written : written + len(data)] = data
        self.offs[self.n + 1 : self.n + 1 + len(sizes)] = filled + np.cumsum(sizes)
        self.at[self.n + 1 : self.n + 1 + len(sizes)] = written + off[1:]
        self.n += len(sizes)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _add(self, pieces: pa.Array) -> None:
        self._store(pieces, *self._encoded(pieces.cast(pa.large_string()).to_pylist()))

    def _add_joined(self, pieces: pa.Array) -> None:
        """Encode runs of 128 pieces as one text each; the byte lengths of the tokens tell where each piece ends."""
        data, off = tb.flat(pieces)
        cuts = [*off[:-1:128].tolist(), int(off[-1])]
        raw = data.tobytes()
        ids, _ = self._encoded([raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), off[1:]) + 1
        self._store(pieces, ids, np.diff(np.concatenate([[0], ends])))

    def _lookup(self, distinct: pa.Array) -> np.ndarray:
        """The entry of each piece; unknown pieces are encoded. A piece is known by its hash and its bytes."""
        data, off = tb.flat(distinct)
        if self.n + len(distinct) > CACHE_PIECES or self.at[self.n] + len(data) > CACHE_BYTES:
            self._reset()
        h = tb.hash_strings(distinct)
        entry = self._find(h, data, off)
        new = np.flatnonzero(entry < 0)
        if not len(new):
            return entry
        first = self.n
        while self.n + len(new) + 1 > len(self.offs):
            self.offs, self.at = np.concatenate([self.offs, np.zeros_like(self.offs)]), np.concatenate([self.at, np.zeros_like(self.at)])
        joined = self._joinable(distinct)[new]
        new = np.concatenate([new[joined], new[~joined]])
        for some, add in ((new[: joined.sum()], self._add_joined), (new[joined.sum() :], self._add)):
            for at in range(0, len(some), 1 << 14):
                add(distinct.take(pa.array(some[at : at + (1 << 14)])))
        entry[new] = np.arange(first, self.n)
        self._remember(h[new], entry[new])
        return entry

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` after it, and the n + 1 offsets of the texts in them."""
        data, off = tb.flat(column)
        cuts = self._cuts(data, off)
        coded = tb.strings(data, cuts).dictionary_encode()
        entry = self._lookup(coded.dictionary)[coded.indices.to_numpy()] if len(cuts) > 1 else np.zeros(0, np.int64)
        begin, size = self.offs[entry], self.offs[entry + 1] - self.offs[entry]
        flow = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(flow[-1]) + np.repeat(begin - flow[:-1], size)]
        offs = flow[np.searchsorted(cuts[:-1], off)] if len(cuts) > 1 else np.zeros(len(off), np.int64)
        if end_id is None:
            return ids, offs
        return np.insert(ids, offs[1:], np.uint32(end_id)), offs + np.arange(len(offs))


@lru_cache(maxsize=2)
def encoder(path: str, keep_space: bool) -> Encoder:
    """One encoder a Python worker; what it has encoded serves its later tasks."""
    return Encoder(path, keep_space)
