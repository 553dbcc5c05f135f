"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. At first one state loops on every byte. Each merge (u, v) in order of rank then splits
the state that u leads to: u now leads to a copy without v, and every state that reads u also reads the new token
uv, which leads where v leads. What is left accepts exactly the token sequences that applying the merges gives.
All arcs of a token lead to one state, so a state is kept as its gadget: the state it copies, the token it lost and
the merge that made it. An arc is looked up along these records.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, keeps, text_pieces, task

#: The pre-tokenizer's pattern, with its white space spelt out (fixed values of the byte-level vocabulary).
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next free from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Labels and merges of a byte-level BPE file, and how it splits a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in letters for c in token)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        self.merges = []
        for pair in file["model"]["merges"]:
            u, v = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.append((self.ids[u], self.ids[v], self.ids[u + v]))
        self.labels = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for label, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.labels[i] = label
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token's string is one of them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for k, part in enumerate(self.cut(text)) for w in ([part] if k % 2 else self.words(part))]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_ONE = (1,)
SHORT = 24  # bytes of a word up to which every end of a label is tried


class Automaton:
    """The tokenization automaton of a vocabulary. State 0 is the first; arcs are (state, token) -> state or None."""

    def __init__(self, v: Vocabulary):
        self.v = v
        never = 1 << 30
        size = len(v.labels)
        self.to = array("i", [-1] * size)  # the state that a token leads to
        self.born = array("i", [never] * size)  # the merge that makes a token; bytes come before all
        self.left = array("i", [-1] * size)  # the u of its merge
        self.parent, self.lost, self.made = array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.known: dict[int, bool] = keeps("bpe", {})
        for b in v.bytes.tolist():
            self.to[b], self.born[b] = 0, -1
        for rank, (a, b, ab) in enumerate(v.merges):
            self._merge(rank, a, b, ab)
        self.known.clear()
        self.arcs = {label: i for label, i in v.ids.items() if self.to[i] >= 0}
        #: First two bytes -> the lengths of the labels that begin so, longest first.
        by_head: dict[bytes, set[int]] = {}
        for label in self.arcs:
            if len(label) > 1:
                by_head.setdefault(label[:2], {1}).add(len(label))
        self.lengths = {head: tuple(sorted(n, reverse=True)) for head, n in by_head.items()}

    def _merge(self, rank: int, u: int, w: int, uw: int) -> None:
        before, target = self.to[u], self.to[w]
        if before < 0 or target < 0 or not self.reads(before, w):
            return
        self.parent.append(before)
        self.lost.append(w)
        self.made.append(rank)
        self.to[u] = len(self.parent) - 1
        self.to[uw], self.born[uw], self.left[uw] = target, rank, u

    def reads(self, state: int, token: int) -> bool:
        """Whether a state has an arc for a token that is already made."""
        key = state << 20 | token
        found = self.known.get(key)
        if found is not None:
            return found
        s, t = state, token
        while True:
            if self.born[t] >= self.made[s]:  # the token came after the state: it reads uw if it reads u
                if self.left[t] < 0:
                    found = self.to[t] >= 0
                    break
                t = self.left[t]
            elif t == self.lost[s]:
                found = False
                break
            else:
                s = self.parent[s]
        if len(self.known) > 600_000:
            self.known.clear()
        self.known[key] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """The only token sequence of these bytes that the automaton accepts: the longest arc first, and back where none leads on."""
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        """By all ends of a label, from the end of the word down: few, where the word is short."""
        arcs, known, reads, to, n = self.arcs.get, self.known.get, self.reads, self.to, len(word)
        path: list[int] = []
        begins: list[int] = []
        dead = None  # tokens that no path goes on from, by where they end
        at = state = 0
        end = n
        while at < n:
            while end > at:
                token = arcs(word[at:end])
                if token is not None and (dead is None or (end, token) not in dead):
                    allowed = known(state << 20 | token)
                    if allowed or allowed is None and reads(state, token):
                        break
                end -= 1
            if end > at:
                path.append(token)
                begins.append(at)
                at, state, end = end, to[token], n
            else:
                if dead is None:
                    dead = set()
                token = path.pop()
                dead.add((at, token))
                end = at - 1
                at = begins.pop()
                state = to[path[-1]] if path else 0
        return path

    def _long(self, word: bytes) -> list[int]:
        """The same by the lengths of the labels that begin with the next two bytes: a run of a million spaces has a few of them at each place."""
        arcs, known, reads, to, n, lengths = self.arcs.get, self.known.get, self.reads, self.to, len(word), self.lengths.get
        path: list[int] = []
        tried: list[tuple[int, tuple[int, ...], int]] = []  # where each token of the path begins, the lengths there and which it has
        dead = None
        at = state = k = 0
        some = lengths(word[:2], _ONE)
        while at < n:
            while k < len(some):
                end = at + some[k]
                if end <= n and (token := arcs(word[at:end])) is not None and (dead is None or (end, token) not in dead):
                    allowed = known(state << 20 | token)
                    if allowed or allowed is None and reads(state, token):
                        break
                k += 1
            if k < len(some):
                path.append(token)
                tried.append((at, some, k))
                at, state = end, to[token]
                some, k = lengths(word[at : at + 2], _ONE), 0
            else:
                if dead is None:
                    dead = set()
                dead.add((at, path.pop()))
                at, some, k = tried.pop()
                k += 1
                state = to[path[-1]] if path else 0
        return path


@lru_cache(4)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


class _Words(dict):
    """word -> its ids as little-endian 32-bit words, made when first met."""

    def __init__(self, v: Vocabulary, a: Automaton):
        super().__init__()
        self.special, self.make = v.special.get, a.encode

    def __missing__(self, w: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        special = self.special(w)
        ids = self.make(w.encode("utf-8", "surrogatepass")) if special is None else [special]
        out = self[w] = array("I", ids).tobytes()
        return out


class Encoder:
    """Texts to ids through the automaton; the ids of recent pre-tokens are kept."""

    def __init__(self, path: str):
        self.v, self.a = vocabulary(path), automaton(path)
        self.words: dict[str, bytes] = keeps("bpe", _Words(self.v, self.a))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.v.split(text))), "<u4")

    def decode(self, ids) -> str:
        """The labels of the ids' arcs, one after another; bytes that aren't UTF-8 come out as U+FFFD."""
        return b"".join(map(self.v.labels.__getitem__, ids)).decode("utf-8", "replace")

    def known_ids(self, ids) -> list[int]:
        """Without null ids and those of no token."""
        n = len(self.v.labels)
        return [i for i in ids if i is not None and 0 <= i < n]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null text has no ids. Ids, repeated or null, come back as they are."""
    path = path or default_vocabulary()

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for piece, texts in text_pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([e.encode(t or "").astype(np.int32) for t in texts], pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, path: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text, null elements and ids of no token nothing. Repeated and null keys come back as they are."""
    path = path or default_vocabulary()

    def run(batches):
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else e.decode(e.known_ids(x)) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, then decoded from its ids.

    Null and empty texts have no tokens; their digests are those of the empty string. Repeated and null ids and
    other columns make no difference: one row comes back for each.
    """
    path = path or default_vocabulary()

    @task("bpe")
    def run(batches):
        e = encoder(path)
        names = list(map(str, range(len(e.v.labels)))).__getitem__
        for batch in batches:
            for piece, texts in text_pieces(batch):
                n, a, b = [], [], []
                for text in texts:
                    ids = e.encode(text or "").tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
