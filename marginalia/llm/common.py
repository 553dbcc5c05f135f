"""What the training-data operators share: reading, cutting lineage, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

#: Entries of a worker's word cache before it is emptied; about 100 MB.
CACHE_WORDS = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a local session without one gets a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Folders that cut() has written and nobody has dropped, by application; what is left goes when Python ends.
_written: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends here and lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all, spark)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote for df; neither it nor what was derived from it can be read after that."""
    spark, path = df.sparkSession, getattr(df, "cut_path", None)
    held = _written.get(spark.sparkContext.applicationId, [])
    if path in held:
        held.remove(path)
        _delete(spark, path)


def cuts(spark: SparkSession) -> list[str]:
    """The folders that this application's cut() has written and that are still there."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Deletes the folders written after cuts() gave `before`, but for that of `keep`: what a stage wrote on its way to its result."""
    kept = {*before, getattr(keep, "cut_path", None)}
    for path in cuts(spark):
        if path not in kept:
            _written[spark.sparkContext.applicationId].remove(path)
            _delete(spark, path)


def _drop_all(spark: SparkSession) -> None:
    try:
        for path in _written.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_kept: dict[str, list] = {}

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def keeps(owner: str, cache):
    """Registers what an operator keeps in its worker; it has clear()."""
    _kept.setdefault(owner, []).append(cache)
    return cache


def release(owner: str) -> None:
    for cache in _kept.get(owner, ()):
        cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def task(owner: str):
    """For functions of an iterator of Arrow batches: what they have kept goes when they end, as idle workers live on and would add up."""

    def around(run):
        def whole(batches):
            try:
                yield from run(batches)
            finally:
                release(owner)

        return whole

    return around


#: Words of a shingle.
SHINGLE_WORDS = 5

_BASE = 0x9D7F3B5C1E86A2D5  # an odd multiplier: a word's hash is a polynomial of its bytes in it, mixed at the end
_RING = 1 << 64
_SEGMENT = 1 << 18  # bytes hashed at once


def _powers(base: int) -> np.ndarray:
    out = np.ones(_SEGMENT, np.uint64)
    out[1] = base
    done = 2
    while done < _SEGMENT:
        out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, _RING))
        done *= 2
    return out


@lru_cache(1)
def _hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes (A-Z as a-z, the six ASCII spaces 0), whether they are in words, and powers up and down."""
    values = np.random.default_rng(20_240_517).integers(1, 2**64, 256, np.uint64)
    values[65:91] = values[97:123]
    spaces = [0x20, *range(0x09, 0x0E)]
    values[spaces] = 0
    inside = np.ones(256, bool)
    inside[spaces] = False
    return values, inside, _powers(_BASE), _powers(pow(_BASE, -1, _RING))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of some texts, and how many of them come before each text's end (from 0).

    data: the UTF-8 bytes of the texts one after another, offsets: where each begins, and the end of the last. Words
    are split at the six ASCII spaces and lower-cased from A-Z. Bytes are worked on in segments, so that neither a
    long text nor a long word takes more than its share of memory.
    """
    values, in_word, up, down = _hash_tables()
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    open_at, was_inside = -1, False  # where the word that reaches over the segment's start began
    for a in range(lo, hi, _SEGMENT):
        seg = data[a : min(hi, a + _SEGMENT)]
        inside = in_word[seg]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[0] &= not was_inside
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(seg))] - a
        first[cuts] = inside[cuts]
        at = np.flatnonzero(first)
        terms = values[seg] * up[: len(seg)]
        if was_inside and not first[0]:  # the rest of a word from before
            end = at[0] if len(at) else len(seg)
            rest = int(terms[:end].sum(dtype=np.uint64)) * pow(_BASE, a - open_at, _RING) % _RING
            hashes[-1][-1:] += np.uint64(rest)
        if len(at):
            hashes.append(np.add.reduceat(terms, at) * down[at])
            begins.append(at + a)
            open_at = int(at[-1]) + a
        was_inside = bool(inside[-1])
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(begins), offsets[1:])


def shingle_stream(h: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit hash of each run of `width` words in order, from the words' hashes; of the whole sequence if it is shorter; none without words."""
    if not len(h):
        return np.empty(0, np.uint64)
    runs = min(width, len(h))
    n = len(h) - runs + 1
    out = np.full(n, runs, np.uint64)
    for k in range(runs):
        out *= GOLD
        out += h[k : k + n]
    return mix(out)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """As np.unique, which sorts 64-bit integers the slow way."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def text_words(text: str | None) -> np.ndarray:
    """The hashes of a text's words in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return distinct_sorted(shingle_stream(text_words(text)))


def column_words(column: pa.Array, most: int = 1 << 22) -> Iterator[np.ndarray]:
    """The word hashes of each text of a string column, in order; none for a null. Some `most` bytes are worked on at once, a longer text alone."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        end = min(end, len(column))
        h, ends = word_hashes(data, offsets[start : end + 1])
        low = 0
        for k, high in enumerate(ends.tolist()):
            yield h[low:high] if there[start + k] else h[:0]
            low = high
        start = end


PIECE_ROWS = 256


def text_pieces(batch: pa.RecordBatch, column: str = "text", rows: int = PIECE_ROWS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of an Arrow batch with their texts as Python strings, so that few texts are held twice."""
    at = batch.schema.get_field_index(column)
    for start in range(0, batch.num_rows, rows):
        piece = batch.slice(start, rows)
        yield piece, piece.column(at).to_pylist()


def binaries(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.binary())


def ragged(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """One binary value for each data[bounds[i]:bounds[i+1]]; the bytes are not copied."""
    width = data.dtype.itemsize
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def keep_rows(df: DataFrame, owner: str, verdict) -> DataFrame:
    """The rows of df, all columns, for whose text verdict() is true; verdict() takes texts and returns booleans and runs on executors."""

    @task(owner)
    def run(batches):
        test = verdict()
        for batch in batches:
            kept = [k for _, texts in text_pieces(batch) for k in test(texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Bits of the id filter; 65,536 rows of 16 bytes are the most that is broadcast.
FILTER_BITS = 1 << 22


def _marked(df: DataFrame, ids: DataFrame, id_col: str):
    """(df with a boolean column that a bitmap of ids sets, that column's name, ids with a name of its own); names are apart from those of df."""
    from pyspark.sql import functions as F

    tag = "_"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag += "_"
    word, bits, hit, given = (tag + n for n in ("word", "bits", "hit", "given"))
    ids = ids.toDF(given)
    slot = "pmod(cast({} as long), " + str(FILTER_BITS) + "L)"
    of, own = slot.format(given), slot.format(f"`{id_col}`")
    bitmap = ids.groupBy(F.expr(f"{of} div 64 AS {word}")).agg(F.expr(f"bit_or(shiftleft(1L, cast({of} % 64 as int))) AS {bits}"))
    joined = df.join(F.broadcast(bitmap), F.expr(f"{own} div 64 = {word}"), "left")
    return joined.withColumn(hit, F.expr(f"coalesce(shiftright({bits}, cast({own} % 64 as int)) & 1, 0) = 1")), hit, ids


def with_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is in ids (one long column), and some others: what a bitmap of the ids can't tell from them."""
    marked, hit, _ = _marked(df, ids, id_col)
    return marked.where(hit).select([f"`{c}`" for c in df.columns])


def without_ids(df: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id isn't in dropped (one long column, no nulls); only rows that a bitmap of the ids can't clear are shuffled.

    Rows with a null id stay. The columns it works with are named apart from those of df.
    """
    from pyspark.sql import functions as F

    marked, hit, ids = _marked(df, dropped, id_col)
    columns = [f"`{c}`" for c in df.columns]
    clear = marked.where(f"not {hit}").select(columns)
    checked = marked.where(hit).select(columns).join(ids, F.expr(f"cast(`{id_col}` as long) = {ids.columns[0]}"), "left_anti")
    return clear.union(checked)
