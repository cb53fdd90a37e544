"""Token counts by rank-synchronous merging of pre-tokens held in ragged arrays.

A batch of pre-tokens is one array of symbols with the number of its sequence beside each. In every round each
sequence applies its pair of lowest rank at all its places at once (of overlapping places every second, from the left),
and sequences without a mergeable pair leave the arrays. What remains of a sequence are its tokens. Counts of
pre-tokens seen before are looked up, in a table of at most two generations of ``REMEMBERED``.

Null texts count as empty: no bytes, no tokens. Texts of any length are counted whole. Repeated rows give repeated
results, an empty table none; other columns take no part.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Splitter
from .common import Memory, per_text

LIMIT = 1024
REMEMBERED = 500_000
_NONE = np.iinfo(np.int64).max


def _byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(spare)) for byte in range(256)]


class PairMerges:
    def __init__(self, path: str | None = None):
        self.splitter = Splitter(path)
        model = self.splitter.model["model"]
        vocabulary = model["vocab"]
        self.size = len(vocabulary) + len(self.splitter.special) + 1
        self.byte_ids = np.array([vocabulary[name] for name in _byte_names()], np.int64)
        merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.memory = Memory(REMEMBERED)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each non-empty word."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        while len(symbols) > 1:
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            pair = symbols[:-1] * self.size + symbols[1:]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            fits = (self.keys[found] == pair) & (owner[1:] == owner[:-1])
            rank = np.full(len(symbols), _NONE)
            rank[:-1][fits] = self.ranks[found[fits]]
            lowest = np.minimum.reduceat(rank, begins)
            spans = np.diff(np.r_[begins, len(symbols)])
            lowest = np.repeat(lowest, spans)
            alive = lowest != _NONE
            if not alive.any():
                break
            chosen = alive & (rank == lowest)
            place = np.arange(len(symbols))
            first = chosen & ~np.r_[False, chosen[:-1]]
            run = np.maximum.accumulate(np.where(first, place, 0))
            chosen &= (place - run) % 2 == 0
            at = np.flatnonzero(chosen)
            symbols[at] = self.made[found[at]]
            np.subtract.at(counts, owner[at], 1)
            alive[at + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        split = [self.splitter.split(text) for text in texts]
        known = self.memory.results(set().union(*(words for words, _ in split)), lambda words: self.surviving([word.encode() for word in words]).tolist()).__getitem__
        return [sum(map(known, words)) + special for words, special in split]


@functools.cache
def load(path: str | None = None) -> PairMerges:
    """The merges of a vocabulary file; a Python worker loads them once."""
    return PairMerges(path)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    def make():
        merges = load(path)
        return lambda texts: [(len(text.encode()), n, n > limit) for text, n in zip(texts, merges.count(texts))]

    fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_text(make, fields), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
