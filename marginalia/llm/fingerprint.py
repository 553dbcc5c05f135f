"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's five-word shingles, and is whole if the text has no more.
Runs of over 32 characters without a space count as one word a character. Texts of few words have few shingles: of
six words a changed one spoils both, as in any five-word measure.
Sketches of parts merge into the sketch of the whole; two sketches estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles, shuffle_partitions, text_pieces, task

K = 128  # hashes of a sketch; the standard error of a likeness of one half is about 0.044
SPACE = float(2**64)


#: Code points without a space from which a run counts as its single characters, so that scripts without spaces have shingles too.
LONG_RUN = re.compile(r"[^\x20\x09-\x0D]{33,}")


def spaced(text: str | None) -> str:
    """The text with a space after each character of its long runs."""
    return LONG_RUN.sub(lambda m: " ".join(m[0]), text) if text else ""


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest shingle hashes of a text; a text of fewer than five words is one shingle."""
    return shingles(spaced(text))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k, else estimated from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / SPACE)


def _common(a, b, k):
    """Of the smallest hashes of both together: how many are in both, how many there are."""
    union = merge(a, b, k)
    return np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True), len(union), union


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard similarity; exact if both have at most k shingles together. 1 if both are empty."""
    both, n, _ = _common(a, b, k)
    return float(both.sum()) / n if n else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has. 1 if a is empty."""
    both, _, union = _common(a, b, k)
    mine = np.isin(union, a, assume_unique=True).sum()
    return float(both.sum()) / mine if mine else 1.0


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_distinct (estimated) of every row; null and empty texts have the empty fingerprint.

    Repeated and null ids come back as they are, one row each; equal texts have equal fingerprints; texts are read
    whole, whatever their length; other columns are ignored.
    """

    @task("words")
    def run(batches):
        for batch in batches:
            for piece, texts in text_pieces(batch):
                s = [sketch(t, k) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(to_text, s), pa.string()), pa.array([distinct(x, k) for x in s], pa.float64())], ["doc_id", "fingerprint", "n_distinct"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


KEYS_HELD = 50_000  # keys that a task merges before it passes on what it has


def merged(parts: DataFrame, key: str, k: int = K, fingerprint: str = "fingerprint") -> DataFrame:
    """(key, fingerprint) of each group of sketches; a null key is a group, a null sketch is empty, no rows give none.

    Each task first merges what it has of a key, so that a hot key moves few rows; then the rows of a key come sorted
    and are merged one by one, so that no task holds more than one key's sketch.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(parts.schema[key].dataType)
    kind = f"`{key}` {parts.schema[key].dataType.simpleString()}, fingerprint string"

    def rows(names, sketches):
        return pa.RecordBatch.from_arrays([pa.array(names, batch_type), pa.array(map(to_text, sketches), pa.string())], [key, "fingerprint"])

    def some(batches):
        held: dict = {}
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[name] = merge(held[name], from_text(s or ""), k) if name in held else from_text(s or "")
            if len(held) > KEYS_HELD:
                yield rows(list(held), held.values())
                held = {}
        yield rows(list(held), held.values())

    def sorted_keys(batches):
        name, now, names, done = None, None, [], []
        for batch in batches:
            for other, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is not None and other == name:
                    now = merge(now, from_text(s or ""), k)
                    continue
                if now is not None:
                    names.append(name)
                    done.append(now)
                name, now = other, from_text(s or "")
            yield rows(names, done)
            names, done = [], []
        if now is not None:
            yield rows([name], [now])

    partial = parts.select(key, fingerprint).mapInArrow(some, kind)
    return partial.repartition(shuffle_partitions(parts.sparkSession), key).sortWithinPartitions(key).mapInArrow(sorted_keys, kind)


# Each text against the next, and against itself with an end from the next


def edited(text: str, after: str) -> str:
    """The last quarter of the code points (rounded down) gives way to as many first ones of the next text, or all it has."""
    cut_at = len(text) // 4
    return text[: len(text) - cut_at] + after[:cut_at] if cut_at else text


def _with_next(k):
    def sha(s):
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    @task("words")
    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last, rows = None, []  # (doc_id, text, sketch, slice, whether it is only there to follow)
        for batch in batches:
            slices, extra = batch.column("slice").to_pylist(), batch.column("extra").to_pylist()
            at = 0
            for piece, texts in text_pieces(batch):
                for doc_id, text in zip(piece.column(0).to_pylist(), texts):
                    now = (doc_id, text or "", sketch(text, k), slices[at], extra[at])
                    at += 1
                    if last is not None and last[3] == now[3] and not last[4]:
                        rows.append(_row(last, now, k, sha))
                    elif last is not None and not last[4]:
                        raise AssertionError(f"document {last[0]} has no follower")
                    last = now
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
        if last is not None and not last[4]:
            raise AssertionError(f"document {last[0]} has no follower")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _row(now, after, k, sha):
    doc_id, text, own, *_ = now
    new = edited(text, after[1])
    changed = sketch(new, k) if new != text else own
    return doc_id, len(text), sha(new), to_text(own), to_text(changed), resemblance(own, changed, k), resemblance(own, after[2], k)


def fingerprints_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document by ascending doc_id.

    The last document's next is the first; a document alone is its own next. Null texts are empty; two empty texts
    are alike (1), an empty and another text are not (0). Rows that repeat an id follow each other in order of
    text, null ids come first. Texts are sorted in slices of the id range, each with the first document of the next slice,
    so that no task holds more than a slice and each text is shuffled once. A slice holds about as many rows as
    another; only rows that repeat one id can't be spread.
    """
    spark = docs.sparkSession
    least = -(2**63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    order = F.coalesce("doc_id", F.lit(least))
    ids = docs.select(order.cast("double").alias("at"))
    bounds = sorted(set(ids.approxQuantile("at", [i / (2 * parts) for i in range(1, 2 * parts)], 0.25 / parts)))  # two slices a partition
    slice_of = F.size(F.filter(F.lit(bounds), lambda b: b <= order.cast("double"))) if bounds else F.lit(0)
    sliced = docs.withColumn("slice", slice_of)
    firsts = {r["slice"]: r["at"] for r in sliced.select("slice", order.alias("at")).groupBy("slice").agg(F.min("at").alias("at")).collect()}  # a row a slice
    held = sorted(firsts)
    # The first document of each slice also ends the slice before it; that of the first slice ends the last.
    before = {firsts[s]: held[i - 1] for i, s in enumerate(held)}
    heads = docs.withColumn("at", order).where(F.col("at").isin(list(before))) if before else docs.withColumn("at", order).limit(0)
    one = heads.groupBy("at").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("at", "r.*")
    place = spark.createDataFrame([(a, s) for a, s in before.items()] or [(0, 0)], "at long, slice int")
    followers = one.join(F.broadcast(place), "at").select("doc_id", "text", "slice", F.lit(True).alias("extra"))
    rows = sliced.select("doc_id", "text", F.col("slice").cast("int").alias("slice"), F.lit(False).alias("extra")).union(followers)
    dealt = rows.repartitionById(parts, F.pmod("slice", F.lit(parts))).sortWithinPartitions("slice", "extra", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_with_next(k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
