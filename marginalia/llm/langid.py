"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, rotated by
their place; a text is the sum of its trigrams, each by the logarithm of one more than its count, so that a phrase
repeated over and over doesn't drown the rest; a language is the sum of its texts' unit vectors. A text gets the
language whose profile is nearest by cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_ROWS, cut, drop, keeps, text_pieces, task

DIMENSIONS, N = 1024, 3
SEED = 20_240_501
UNKNOWN = "und"
FIXED = 2.0**32  # profiles are summed in fixed point, so that the order of the texts doesn't matter
ODD_TEXTS = 1000  # one text in so many may be below what the limits of rejection take for the least
GRAMS_KEPT = 40_000  # trigram vectors that a worker keeps, 40 MB
GRAMS_AT_ONCE = 8_192


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, three code points in 21 bits each, and their counts. All that isn't a letter is one gap, 0."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:], return_counts=True)


class Grams:
    """Trigram vectors, made when first met."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {0: letter_vector(0)}
        self.clear()

    def clear(self):
        self.keys, self.rows, self.vectors = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def made(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << 21) - 1)
        codes, at = np.unique(np.concatenate([keys & mask, keys >> np.uint64(21) & mask, keys >> np.uint64(42)]), return_inverse=True)
        letters = np.array([self.letter(c) for c in codes.tolist()])
        last, middle, first = at.reshape(3, -1)
        out = letters[last]
        out *= np.roll(letters, 1, axis=1)[middle]
        out *= np.roll(letters, 2, axis=1)[first]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct trigrams, GRAMS_AT_ONCE at most."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = keys[self.keys[at] != keys] if len(self.keys) else keys
        if len(new):
            if len(self.keys) + len(new) > GRAMS_KEPT:
                self.keys, self.rows, new = self.keys[:0], self.rows[:0], keys
            if not len(self.vectors):
                self.vectors = np.empty((GRAMS_KEPT, DIMENSIONS), np.int8)  # touched as it fills
            held = len(self.keys)
            self.vectors[held : held + len(new)] = self.made(new)
            place = np.searchsorted(self.keys, new)
            self.keys, self.rows = np.insert(self.keys, place, new), np.insert(self.rows, place, np.arange(held, held + len(new)))
            at = np.searchsorted(self.keys, keys)
        return self.vectors[self.rows[at]]


@lru_cache(1)
def grams() -> Grams:
    return keeps("language", Grams())


def bundles(texts: list[str | None]) -> np.ndarray:
    """The unit vector of each text; zero for a text without letters."""
    return _bundles([trigrams(t) for t in texts])


def _bundles(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(found), DIMENSIONS), np.float32)
    for start in range(0, len(found), 64):
        some = found[start : start + 64]
        keys = np.unique(np.concatenate([k for k, _ in some]))
        if not len(keys):
            continue
        for low in range(0, len(keys), GRAMS_AT_ONCE):
            part = keys[low : low + GRAMS_AT_ONCE]
            counts = np.zeros((len(some), len(part)), np.float32)
            for i, (k, n) in enumerate(some):
                mine = slice(np.searchsorted(k, part[0]), np.searchsorted(k, part[-1], side="right"))
                counts[i, np.searchsorted(part, k[mine])] = np.log1p(n[mine])
            out[start : start + 64] += counts @ grams().of(part).astype(np.float32)
    norms = np.linalg.norm(out.astype(np.float64), axis=1)
    return out / np.where(norms == 0, 1, norms).astype(np.float32)[:, None]


@task("language")
def _sums(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for k, (_, texts) in enumerate(text_pieces(batch)):
            for lang, v in zip(langs[k * PIECE_ROWS : k * PIECE_ROWS + len(texts)], bundles(texts)):
                sums[lang] = sums.get(lang, 0) + np.rint(v * FIXED).astype(np.int64)
    yield from _sent(sums)


def _added(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, v in zip(batch.column("lang").to_pylist(), batch.column("sum").to_pylist()):
            sums[lang] = sums.get(lang, 0) + np.frombuffer(v, np.int64)
    yield from _sent(sums)


def _sent(sums: dict[str, np.ndarray]):
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()])], ["lang", "sum"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit profiles by language, from all rows (text, lang) with a text and a language; other columns are ignored."""
    form = "lang string, sum binary"
    parts = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_sums, form)  # 8 kB for each task and language
    sums = {r["lang"]: np.frombuffer(r["sum"], np.int64) / FIXED for r in parts.repartition("lang").mapInArrow(_added, form).collect()}
    return {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if np.linalg.norm(v)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row.

    score is the cosine with the nearest profile, at least 0; ties go to the first language by name. A text that is
    null or has no letter is `und` with score 0, as is every text where there are no profiles. A text of any length
    is read whole, its trigrams are counted in arrays of eight bytes a letter. Repeated and null ids come back as
    they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(matrix(profiles))

    @task("language")
    def run(batches):
        for batch in batches:
            for piece, texts in text_pieces(batch):
                langs, score = nearest(texts, shared.value)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def scrambled(text: str) -> str:
    """The text with its letters in another order, the same each time: no language, but its letters and word lengths."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at = np.flatnonzero(_letters()[codes])
    letters = codes[at]
    np.random.default_rng((SEED, len(letters))).shuffle(letters)
    codes[at] = letters
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


#: A place holds whether a text is as it was (bit 40), the bit length of its number of distinct trigrams (from bit 32), and its cosine as the bits of a float, which sort as the cosines do.
PLAIN, LENGTH, LOW = 1 << 40, 32, 15


def _places(shared):
    @task("language")
    def run(batches):
        for batch in batches:
            for _, texts in text_pieces(batch):
                for kind, some in ((PLAIN, texts), (0, [scrambled(t) for t in texts])):
                    found = [trigrams(t) for t in some]
                    cos = (_nearest(found, shared.value)[1] + 0.0).astype(np.float32).view(np.uint32).astype(np.int64)
                    bits = np.array([len(k).bit_length() for k, _ in found], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(kind + (bits << LENGTH) + cos)], ["place"])

    return run


def _counted(places: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in order, and how many rows there are up to each."""
    rows = np.array(sorted(map(tuple, places.groupBy("place").count().collect())), np.int64).reshape(-1, 2)
    return rows[:, 0], np.cumsum(rows[:, 1])


def at_ranks(places: DataFrame, ranks) -> dict[int, tuple[int, list[float]]]:
    """Of each group of places (all but the cosine), its size and its cosines at the ranks, from 0, that ranks(group, size) names.

    Exact: rows are counted by the upper half of the cosine's bits, and then by all bits where a rank falls. The
    driver gets at most 32,768 counts a group and half, whatever the number of rows.
    """
    high, upto = _counted(places.select(F.shiftright("place", LOW).alias("place")))
    groups, first = np.unique(high >> (LENGTH - LOW), return_index=True)
    start = np.append(0, upto)[first]
    sizes = np.diff(np.append(start, upto[-1:]))
    wanted = {g: (n, [a + r for r in ranks(g, n)]) for g, a, n in zip(groups.tolist(), start.tolist(), sizes.tolist())}
    half = {r: int(np.searchsorted(upto, r, side="right")) for _, rs in wanted.values() for r in rs}
    low, low_upto = _counted(places.where(F.shiftright("place", LOW).isin(sorted({int(high[k]) for k in half.values()}))))
    value = {}
    for r, k in half.items():
        begin = int(np.searchsorted(low, high[k] << LOW))
        before = low_upto[begin - 1] if begin else 0
        skipped = upto[k - 1] if k else 0
        place = low[np.searchsorted(low_upto, before + r - skipped, side="right")]
        value[r] = float(np.uint32(place & ((1 << LENGTH) - 1)).view(np.float32))
    return {g: (n, [value[r] for r in rs]) for g, (n, rs) in wanted.items()}


def limits(docs: DataFrame, profiles: dict[str, np.ndarray], least: int = 20) -> np.ndarray:
    """The cosine under which a text of so many distinct trigrams (by bit length) is rejected, from all texts that a language is known of.

    A third of the way from the median of the same texts with their letters scrambled to the least of the texts as
    they are; 0 where those meet or fewer than `least` texts of either kind tell, so that texts too short to judge stay.
    The least is taken after one text in ODD_TEXTS, so that a few texts of no language that have one named don't
    take the limit from a large corpus.
    """
    out = np.zeros(33)
    if not profiles:
        return out
    shared = docs.sparkSession.sparkContext.broadcast(matrix(profiles))
    places = cut(docs.where("lang is not null and text is not null").select("text").mapInArrow(_places(shared), "place long"))  # two of 8 bytes a text
    found = at_ranks(places, lambda group, n: [n // ODD_TEXTS] if group & PLAIN >> LENGTH else [(n - 1) // 2, n // 2])
    drop(places)
    held = 0.0
    for bits in range(len(out)):
        (real, low), (mixed, middle) = (found.get(kind + bits, (0, [])) for kind in (PLAIN >> LENGTH, 0))
        if min(real, mixed) >= max(1, least):
            noise = sum(middle) / 2
            held = max(held, noise + (low[0] - noise) / 3) if low[0] > noise else held
        out[bits] = held
    return out


def accepted(texts: list[str | None], profiles: tuple[list[str], np.ndarray], least: np.ndarray) -> list[bool]:
    """Whether each text is in a language of the profiles: it has letters, and its cosine reaches the limit for its number of distinct trigrams."""
    found = [trigrams(t) for t in texts]
    names, cos = _nearest(found, profiles)
    bits = [min(len(least) - 1, len(k).bit_length()) for k, _ in found]
    return [name != UNKNOWN and c >= least[b] for name, c, b in zip(names, cos, bits)]


def matrix(profiles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    return list(profiles), np.array(list(profiles.values()), np.float32).reshape(len(profiles), DIMENSIONS)


def nearest(texts: list[str | None], profiles: tuple[list[str], np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The nearest language of each text and the cosine with it, at least 0; und and 0 where there is none."""
    return _nearest([trigrams(t) for t in texts], profiles)


def _nearest(found: list[tuple[np.ndarray, np.ndarray]], profiles: tuple[list[str], np.ndarray]) -> tuple[list[str], np.ndarray]:
    names, p = profiles
    b = _bundles(found)
    cos = b @ p.T if names else np.zeros((len(found), 1), np.float32)
    best, known = cos.argmax(axis=1), b.any(axis=1) & bool(names)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)


def held_out(mod: int, rest: int, column: str = "doc_id"):
    """Whether crc32 of the id as text leaves this rest; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest, F.lit(False))
