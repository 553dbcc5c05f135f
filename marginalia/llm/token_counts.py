"""Token counts by rank-synchronous array merging.

A batch of distinct pre-tokens is one ragged array of symbols. In each step every sequence applies its own
lowest-rank pair wherever it occurs, all sequences at once; sequences without a pair are done and their surviving
symbols are counted.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary, vocabulary
from .common import CACHE_WORDS, keeps, text_pieces, task

NONE = np.int32(2**31 - 1)


class PairRanks:
    """(left, right) -> rank and merged symbol, in hash tables of which each holds what collided in the one before."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        left, right, merged = (np.array(x, np.uint64) for x in zip(*merges))
        keys, ranks = left << np.uint64(32) | right, np.arange(len(merges), dtype=np.int32)
        self.merged = merged.astype(np.int32)
        self.tables = []
        bits = 20
        while len(keys):
            slot = self._slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((bits, held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], 14
        # without a repeat of the same collisions
        assert len(self.tables) < 30

    @staticmethod
    def _slot(keys, bits):
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        for bits, held, rank in self.tables:
            slot = self._slot(keys, bits)
            hit = held[slot] == keys
            out[hit] = rank[slot[hit]]
        return out


def merge_counts(words: list[bytes], symbol_of_byte: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """The number of symbols that survive in each word."""
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return counts
    symbols = symbol_of_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), counts)
    ranks = pairs.of(symbols[:-1], symbols[1:])
    ranks = np.append(ranks, NONE)
    while True:
        ranks[:-1][owner[1:] != owner[:-1]] = NONE
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(owner)))
        least = np.minimum.reduceat(ranks, first)
        done = least == NONE
        if done.any():
            counts[owner[first[done]]] = size[done]
            if done.all():
                return counts
            going = np.repeat(~done, size)
            symbols, owner, ranks = symbols[going], owner[going], ranks[going]
            least, size = least[~done], size[~done]
        at = np.flatnonzero(ranks == np.repeat(least, size))
        if len(at) > 1 and (np.diff(at) == 1).any():  # of pairs that overlap (aaa) every second one stands
            start = np.concatenate([[True], np.diff(at) != 1])
            run = np.flatnonzero(start)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        symbols[at] = pairs.merged[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))  # where the merged symbols are afterwards
        symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
        ranks[new] = NONE
        inner = new[new + 1 < len(symbols)]
        ranks[inner] = pairs.of(symbols[inner], symbols[inner + 1])
        before = new[new > 0] - 1
        ranks[before] = pairs.of(symbols[before], symbols[before + 1])


class Counter:
    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.pairs = PairRanks(self.v.merges)
        self.known: dict[str, int] = keeps("tokens", {})

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.v.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        if new:
            encoded = [w.encode("utf-8", "surrogatepass") for w in new]
            self.known.update(zip(new, merge_counts(encoded, self.v.bytes, self.pairs).tolist()))
            self.known.update(dict.fromkeys(self.v.special, 1))
        n = self.known.__getitem__
        return [sum(map(n, words)) for words in split]


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null text counts as empty: no bytes, no tokens. Repeated or null ids come back as they are, one row each;
    other columns are ignored. Whole texts are counted, whatever their length.
    """
    path = path or default_vocabulary()

    @task("tokens")
    def run(batches):
        c = counter(path)
        for batch in batches:
            for piece, texts in text_pieces(batch):
                n = pa.array(c.counts(texts), pa.int64())
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), size, n, pa.array([x > limit for x in n.to_pylist()])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
