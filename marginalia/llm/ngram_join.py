"""N-gram Jaccard join: count-vector R-trees over blocks, then an exact check of the surviving pairs.

A document is its set of five-word shingle hashes. Documents with the same words are one class, of which the
smallest doc_id stands for all. Classes that can reach the similarity share a shingle among the first
n - ceil(t n) + 1 of each in any order that all share; here shingles of many classes come last in that order, so
that a passage that many documents hold brings few of them together. Classes that share such a shingle form a
block. In a block each class is a point, the counts of its shingles over hashed groups; an R-tree over the points
bounds the overlap of a query with everything below a node by the sum of the coordinate minima. What survives is
checked on the sets themselves.
"""

from __future__ import annotations

import hashlib
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_A, column_words, cut, distinct_sorted, drop, mix, ragged, shingle_stream, shuffle_partitions, task, with_ids
from .components import components

GROUPS, FINE = 128, 512  # coordinates of a point in the tree, and of the finer point that surviving pairs are bounded by
RANGES = 1024  # of token space; more where there are many shuffle partitions
COUNTED = 0.4  # share of the order in which frequencies are counted; the first quarter is what is read without frequent shingles
FREQUENT, COMMON, MOST_FREQUENT = 2, 32, 1 << 22  # classes from which a shingle counts as frequent, and as common; entries of that list at most
LEAF, FANOUT = 16, 8  # points of a leaf, nodes of a node
TILE = 512  # members of a block that one task compares with as many; larger blocks are dealt out by pairs of tiles
HOT, HELD = 1 << 16, 1 << 22  # owners from which a shingle is a block of its own, where a range holds more than so many owners
FEW = 500_000  # rows of a list of large blocks that are broadcast (16 MB); a longer list is joined by a shuffle
BITMAP_BITS, MOST_BITMAP_BITS = 1 << 22, 1 << 26  # of a list of ids as a filter, by their number; false hits only cost time


def need(na, nb, percent):
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union, in whole numbers."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# Classes


def words_key(h: np.ndarray) -> bytes | None:
    """What equal word sequences share, from the words' hashes."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


@task("words")
def _classes(batches):
    """(doc_id, text) -> (doc_id, words_key, n): n shingles for one text of each class in the partition, null for the others."""
    seen: set = set()
    for batch in batches:
        keys, sizes = [], []
        for h in column_words(batch.column(1)):
            key = words_key(h)
            keys.append(key)
            sizes.append(len(distinct_sorted(shingle_stream(h))) if key is not None and key not in seen else None)
            seen.add(key)
        if len(seen) > 2_000_000:  # about 200 MB
            seen.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "words_key", "n"])


def by_range(doc_ids: np.ndarray, sets: list[np.ndarray], ranges: int, wide: bool):
    """One row for each range of the token space: its tokens, and for wide rows the class of each."""
    if not sets:
        return None
    tokens = np.concatenate(sets)
    if not len(tokens):
        return None
    at = (tokens * MIX_A >> np.uint64(64 - int(math.log2(ranges)))).astype(np.int32)
    order = np.argsort(at, kind="stable")
    which, start = np.unique(at[order], return_index=True)
    bounds = np.append(start, len(order))
    owner = np.repeat(doc_ids, [len(s) for s in sets])[order] if wide else None
    tokens = tokens[order] if wide else (tokens[order] >> np.uint64(32)).astype(np.uint32)
    owners = ragged(bounds, owner) if wide else pa.nulls(len(which), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(which), ragged(bounds, tokens), owners], ["range_id", "tokens", "owners"])


def ordered_prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones after the others and common ones last: as many as no set that reaches the similarity can miss."""
    k = prefix_length(len(s), percent)
    known, common = frequent
    if not len(known):
        return s[:k]
    high = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(known, high), len(known) - 1)
    level = np.where(known[at] == high, np.int8(1) + common[at], np.int8(0))
    if not level[:k].any():
        return s[:k]
    return s[np.argsort(level, kind="stable")[:k]]


def _emitter(ranges, select, wide, flush=600_000):
    """Text rows (doc_id, text) -> rows of by_range, for one text of each class in the partition; select maps the id and set of a text to the tokens that go out."""

    @task("words")
    def run(batches):
        seen, ids, sets, held = set(), [], [], 0
        for batch in batches:
            for doc_id, h in zip(batch.column(0).to_pylist(), column_words(batch.column(1))):
                key = words_key(h)
                if key is None or key in seen:
                    continue
                seen.add(key)
                s = select(doc_id, distinct_sorted(shingle_stream(h)))
                ids.append(doc_id)
                sets.append(s)
                held += len(s)
                if held >= flush:
                    if (out := by_range(np.array(ids, np.int64), sets, ranges, wide)) is not None:
                        yield out
                    ids, sets, held = [], [], 0
            if len(seen) > 2_000_000:
                seen.clear()
        if ids and (out := by_range(np.array(ids, np.int64), sets, ranges, wide)) is not None:
            yield out

    return run


def _by_range(batches):
    """Batches sorted by their first column -> for each of its values the batches' slices one after another, as an iterator."""
    batches = iter(batches)
    rest: list[pa.RecordBatch] = []

    def parts():
        while True:
            batch = rest.pop() if rest else next(batches, None)
            if batch is None:
                return
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            end = int(np.searchsorted(keys, keys[0], side="right"))
            if end < len(keys):
                rest.append(batch.slice(end))
            yield int(keys[0]), batch.slice(0, end)

    for _, group in groupby(parts(), key=lambda x: x[0]):
        yield (part for _, part in group)


def _values(part, column, dtype):
    return np.concatenate([np.frombuffer(x, dtype) for x in part.column(column).to_pylist()] or [np.empty(0, dtype)])


@task("blocks")
def _frequencies(batches):
    """Rows of narrow emitters, sorted by range -> the tokens of many classes. A range's counts are held, its rows one batch at a time."""
    for parts in _by_range(batches):
        tokens, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for part in parts:
            new, n = np.unique(_values(part, 1, np.uint32), return_counts=True)
            both, at = np.unique(np.concatenate([tokens, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            tokens = both
        keep = counts >= FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].astype(np.int64)), pa.array(counts[keep])], ["token", "classes"])


def frequent_tokens(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The high halves of the shingles of most classes, sorted, and whether they are common; never more than MOST_FREQUENT of them."""
    levels = counted.groupBy(F.floor(F.log2("classes")).cast("int").alias("level")).count().collect()  # a row for each power of two
    at, total = int(math.log2(FREQUENT)), sum(r["count"] for r in levels)
    for r in sorted(levels, key=lambda r: r["level"]):
        if total <= MOST_FREQUENT:
            break
        total, at = total - r["count"], r["level"] + 1
    rows = counted.where(F.col("classes") >= 2**at).select("token", (F.col("classes") >= COMMON).alias("common")).toArrow()
    tokens, common = rows.column(0).to_numpy().astype(np.uint32), rows.column(1).to_numpy().astype(np.int8)
    order = np.argsort(tokens)
    return tokens[order], common[order]


# Blocks


def _shared_sets(tokens, owners):
    """(block, member) batches: each set of two or more owners that share a token, once."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    size = np.diff(np.append(first, len(tokens)))
    shared = np.repeat(size >= 2, size)
    tokens, owners, size = tokens[shared], owners[shared], size[size >= 2]
    if not len(size):
        return
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    sums = np.add.reduceat(mix(owners.astype(np.uint64)), first) * MIX_A + size.astype(np.uint64)
    keys, kept = np.unique(sums, return_index=True)
    for i in range(0, len(kept), 20_000):
        rows = kept[i : i + 20_000]
        n = size[rows]
        at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[i : i + 20_000], n).astype(np.int64)), pa.array(owners[at])], ["block", "member"])


@task("blocks")
def _blocks(batches):
    """Rows of wide emitters, sorted by range -> (block, member): each set of two or more classes that share a token, once.

    One range is held at a time. Where that is much, shingles of very many classes go out as they come, each as a
    block of its own.
    """
    for parts in _by_range(batches):
        tokens, owners, hot, most = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64), HELD
        for part in parts:
            tokens = np.concatenate([tokens, _values(part, 1, np.uint64)])
            owners = np.concatenate([owners, _values(part, 2, np.int64)])
            if len(tokens) >= most:
                names, n = np.unique(tokens, return_counts=True)
                hot = np.union1d(hot, names[n >= HOT])
                out = np.isin(tokens, hot)
                if out.any():
                    yield pa.RecordBatch.from_arrays([pa.array(mix(tokens[out]).astype(np.int64)), pa.array(owners[out])], ["block", "member"])
                    tokens, owners = tokens[~out], owners[~out]
                most = max(HELD, 2 * len(tokens))
        if len(hot) and (out := np.isin(tokens, hot)).any():
            yield pa.RecordBatch.from_arrays([pa.array(mix(tokens[out]).astype(np.int64)), pa.array(owners[out])], ["block", "member"])
            tokens, owners = tokens[~out], owners[~out]
        if len(tokens):
            yield from _shared_sets(tokens, owners)


class Bitmap:
    """A set of ids that may also hold others."""

    def __init__(self, ids: DataFrame):
        """ids: one long column."""
        ids = ids.toDF("id")
        self.bits = min(MOST_BITMAP_BITS, max(BITMAP_BITS, 1 << (32 * ids.count()).bit_length()))
        slot = f"pmod(id, {self.bits}L)"
        words = ids.groupBy(F.expr(f"cast({slot} div 64 as int) AS word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int))) AS bits")).toArrow()  # at most a word for 64 bits
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint64)

    def __contains__(self, i: int) -> bool:
        slot = i % self.bits
        return bool(int(self.words[slot // 64]) >> slot % 64 & 1)

    def has(self, ids: np.ndarray) -> np.ndarray:
        slot = np.mod(ids, self.bits)
        return (self.words[slot // 64] >> (slot % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def packed_counts(s: np.ndarray) -> bytes:
    """The counts of a set's shingles over the fine groups, in the fewest bytes that hold the largest."""
    c = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=FINE)
    return c.astype(np.uint8 if c.max() < 1 << 8 else np.uint16 if c.max() < 1 << 16 else np.uint32).tobytes()


def points_of(counts: list[bytes]) -> np.ndarray:
    kinds = {FINE: np.uint8, 2 * FINE: np.uint16, 4 * FINE: np.uint32}
    if all(len(c) == FINE for c in counts):
        return np.frombuffer(b"".join(counts), np.uint8).reshape(-1, FINE)
    return np.stack([np.frombuffer(c, kinds[len(c)]) for c in counts]).astype(np.int32)


def _features(bitmap):
    """(doc_id, text) of classes in blocks -> (member, n, counts, tokens)."""

    @task("words")
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.value.has(batch.column(0).to_numpy())))
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                sets = [distinct_sorted(shingle_stream(h)) for h in column_words(piece.column(1))]
                counts = [packed_counts(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(counts, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["member", "n", "counts", "tokens"]
                )

    return run


# The R-tree


class CountTree:
    """An R-tree over count vectors, packed: points in order of size and then of their most varied coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None):
        labels = np.arange(len(sizes)) if labels is None else labels
        self.order = np.lexsort((*(points[:, k] for k in np.argsort(points.var(axis=0))[-3:]), sizes)) if len(sizes) > LEAF else np.arange(len(sizes))
        # Of each node the largest coordinates, the least and largest size, the least and largest label; points come first.
        level = (points[self.order], sizes[self.order], sizes[self.order], labels[self.order], labels[self.order])
        self.levels, self.fans = [level], []
        while len(level[0]) > 1:
            fan = FANOUT if self.fans else LEAF
            at = np.arange(0, len(level[0]), fan)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)
            self.fans.append(fan)

    def pairs(self, percent: int) -> np.ndarray:
        """The index pairs (as given, i < j) of points of different labels whose bounds reach the overlap that their sizes need; the tree is joined with itself from the root down."""
        i = j = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            keep = np.concatenate([self._reach(depth, i[k : k + 8192], j[k : k + 8192], percent) for k in range(0, len(i), 8192)] or [np.empty(0, bool)])
            i, j = i[keep], j[keep]
            if depth:
                fan, n = self.fans[depth - 1], len(self.levels[depth - 1][0])
                step = np.arange(fan)
                i, j = np.broadcast_arrays((i[:, None] * fan + step)[:, :, None], (j[:, None] * fan + step)[:, None, :])
                i, j = i.ravel(), j.ravel()
                inside = (i < n) & (j < n) & (i <= j)
                i, j = i[inside], j[inside]
        i, j = self.order[i], self.order[j]
        return np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1)

    def _reach(self, depth, i, j, percent):
        high, low_n, high_n, low, top = self.levels[depth]
        # Sizes of two nodes that can link: the least of either that is large enough for the least of the other.
        least_i = np.maximum(low_n[i], -(-percent * low_n[j] // 100))
        least_j = np.maximum(low_n[j], -(-percent * low_n[i] // 100))
        out = (least_i <= high_n[i]) & (least_j <= high_n[j]) & ((low[i] != top[i]) | (low[j] != top[j]) | (low[i] != low[j]))
        at = np.flatnonzero(out)
        out[at] = np.minimum(high[i[at]], high[j[at]]).sum(axis=1) >= need(least_i[at], least_j[at], percent)
        return out


def block_pairs(fine, sizes, labels, percent, tile=None, same=True):
    """Index pairs (i < j) of a block that the bounds leave, labels apart; with tiles only pairs between the two."""
    points = fine.reshape(len(fine), GROUPS, -1).sum(axis=2, dtype=np.int32)
    pairs = CountTree(points, sizes, labels).pairs(percent)
    if not same:
        pairs = pairs[tile[pairs[:, 0]] != tile[pairs[:, 1]]]
    least = need(sizes[pairs[:, 0]], sizes[pairs[:, 1]], percent)
    keep = [np.minimum(fine[pairs[k : k + 8192, 0]], fine[pairs[k : k + 8192, 1]]).sum(axis=1, dtype=np.int64) >= least[k : k + 8192] for k in range(0, len(pairs), 8192)]
    return pairs[np.concatenate(keep)] if keep else pairs


def star_cover(pairs: np.ndarray, n: int) -> np.ndarray:
    """Of the pairs no more than two for each node: stars around the nodes of most pairs, and a pair from each star's centre to an earlier star."""
    if len(pairs) < 2:
        return pairs
    both = np.concatenate([pairs, pairs[:, ::-1]])
    both = both[np.argsort(both[:, 0], kind="stable")]
    first = np.searchsorted(both[:, 0], np.arange(n + 1))
    centre = np.full(n, -1)
    out = []
    for x in np.argsort(-np.diff(first), kind="stable"):
        near = both[first[x] : first[x + 1], 1]
        if centre[x] >= 0 or not len(near):
            continue
        free = near[centre[near] < 0]
        centre[x] = x
        centre[free] = x
        out += [(x, y) for y in free]
        if len(free) < len(near):
            out.append((x, near[centre[near] != x][0]))
    return np.sort(np.array(out, np.int64), axis=1)


def _join_blocks(percent, cover):
    """Rows sorted by (block, tile_a, tile_b): member, label, own tile, n, counts -> candidate links (a, b), a > b; with cover only stars of them."""

    def solve(rows):
        out = []
        key = rows["key"]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
        for s, e in zip(first, [*first[1:], len(key)]):
            if e - s < 2 or (rows["label"][s:e] == rows["label"][s]).all():
                continue
            pairs = block_pairs(points_of(rows["counts"][s:e]), rows["n"][s:e], rows["label"][s:e], percent, rows["own"][s:e], key[s, 1] == key[s, 2])
            pairs = (star_cover(pairs, e - s) if cover else pairs) + s
            m = rows["member"]
            out.append(np.stack([np.maximum(m[pairs[:, 0]], m[pairs[:, 1]]), np.minimum(m[pairs[:, 0]], m[pairs[:, 1]])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def of(table):
        c = lambda k: table.column(k).to_numpy()
        return {"key": np.stack([c("block"), c("tile_a"), c("tile_b")], axis=1), "own": c("own"), "member": c("member"), "label": c("label"), "n": c("n"), "counts": table.column("counts").to_pylist()}

    @task("blocks")
    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            k = [held.column(c).to_numpy() for c in ("block", "tile_a", "tile_b")]
            last = np.flatnonzero((k[0] != k[0][-1]) | (k[1] != k[1][-1]) | (k[2] != k[2][-1]))
            if len(last) and last[-1] >= 5000:  # the last block may go on in the next batch
                yield solve(of(held.slice(0, last[-1] + 1)))
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield solve(of(held))

    return run


def _checked(percent):
    def run(batches):
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep, sets, name = [], None, None
            for i in range(len(a)):
                if a[i] != name:
                    name, sets = a[i], np.frombuffer(ta[i], np.uint64)
                other = np.frombuffer(tb[i], np.uint64)
                if not len(sets) or not len(other):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(sets, other), len(sets) - 1)
                both = int((sets[at] == other).sum())
                keep.append(100 * both >= percent * (len(sets) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def checked_links(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    sets = features.select("member", "tokens")
    with_b = pairs.join(sets.select(F.col("member").alias("b"), F.col("tokens").alias("tb")), "b")
    both = with_b.join(sets.select(F.col("member").alias("a"), F.col("tokens").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_checked(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two texts link when 100 * |A and B| >= percent * |A or B| for their sets of distinct five-word shingles (words:
    A-Z lower-cased, split at ASCII spaces; a shorter text is one shingle). Null, empty and blank texts have no
    shingles and link with nothing: their component is their own id. Equal texts always share a component. Rows
    that repeat an id all come back; their texts are joined under that id. Rows with a null id come back with a
    null component and n_shingles null. Other columns are ignored; an empty table gives no rows. Texts of any length
    are read whole, in segments of bytes. No pair that reaches the similarity is lost but by a collision of 64-bit
    hashes, which could also join two texts.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    parts = shuffle_partitions(spark)
    ranges = max(RANGES, 1 << (4 * parts - 1).bit_length())

    keyed = cut(known.mapInArrow(_classes, "doc_id long, words_key binary, n long"))
    space = np.uint64(int(COUNTED * 2**64))
    emitted = "range_id int, tokens binary, owners binary"
    classes = cut(keyed.where("words_key is not null").groupBy("words_key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    copies = Bitmap(keyed.join(classes, "words_key").where("doc_id <> rep").select("doc_id"))
    copies = spark.sparkContext.broadcast(copies)
    nothing = np.empty(0, np.uint64)

    def dealt_by_range(select, wide):
        rows = known.mapInArrow(_emitter(ranges, select, wide), emitted)
        return rows.repartitionById(parts, F.pmod("range_id", F.lit(parts))).sortWithinPartitions("range_id")

    # Copies don't make a shingle frequent; a text that is taken for one by mistake is only missing in the order.
    narrow = dealt_by_range(lambda i, s: nothing if i in copies.value else s[: np.searchsorted(s, space)], False)
    counted = cut(narrow.mapInArrow(_frequencies, "token long, classes long"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(counted))
    drop(counted)
    raw = dealt_by_range(lambda _, s: ordered_prefix(s, frequent.value, percent), True).mapInArrow(_blocks, "block long, member long").distinct()
    # A text that another partition holds too stood there for its class; from here on the smallest doc_id does.
    members = raw.join(keyed.select(F.col("doc_id").alias("member"), "words_key"), "member").join(classes, "words_key").select("block", F.col("rep").alias("member")).distinct()
    members = cut(members)
    blocks = members.groupBy("block").agg(F.min("member").alias("low"), F.max("member").alias("high")).where("low < high").select("block")

    bitmap = spark.sparkContext.broadcast(Bitmap(with_ids(members, blocks, "block").select("member").distinct()))
    features = cut(known.mapInArrow(_features(bitmap), "member long, n long, counts binary, tokens binary"))
    points = features.select("member", "n", "counts")

    def few(df):
        return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df

    large = cut(members.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > TILE))
    large_too = few(large)

    def pairs_of(dealt: DataFrame, cover: bool) -> DataFrame:
        """dealt (block, own, other, member, label) -> the pairs of members with different labels that the bounds leave, or stars of them."""
        rows = dealt.select("block", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), "own", "member", "label").join(points, "member")
        return rows.repartition(parts, "block", "tile_a", "tile_b").sortWithinPartitions("block", "tile_a", "tile_b").mapInArrow(_join_blocks(percent, cover), "a long, b long").distinct()

    # First a few pairs of each block, enough to connect most of a group of near copies: each tile with itself and with
    # the block's first tile, so that the work grows with the block. Then all pairs of what is still apart.
    tiles = F.coalesce(F.ceil(F.col("size") / TILE).cast("int"), F.lit(1))
    placed = with_ids(members, blocks, "block").join(large_too, "block", "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("member"), "tiles").cast("int"))
    others = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0), F.col("own")))
    first = placed.withColumn("other", F.explode(others)).withColumn("label", F.col("member"))
    stars = cut(checked_links(cut(pairs_of(first, True)), features, percent))
    joined = cut(components(stars).withColumnsRenamed({"node": "member", "component": "label"}))
    labelled = cut(members.join(joined, "member", "left").select("block", "member", F.coalesce("label", "member").alias("label")))

    # In a large block each label of many members has tiles of its own, which needn't meet each other; the rest is pooled.
    in_large = labelled.join(large_too, "block")
    big = in_large.groupBy("block", "label").agg(F.count("*").alias("members")).where(F.col("members") * 2 >= TILE)
    big = big.withColumn("t", F.ceil(F.col("members") / TILE).cast("int"))
    before = Window.partitionBy("block").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 size / TILE rows a block
    big = cut(big.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)).cast("int")))
    layout = large.join(big.groupBy("block").agg(F.sum("members").alias("owned"), F.sum("t").alias("own_tiles")), "block", "left")
    layout = layout.select("block", F.ceil((F.col("size") - F.coalesce("owned", F.lit(0))) / TILE).cast("int").alias("pooled"), F.coalesce("own_tiles", F.lit(0)).cast("int").alias("own_tiles"))
    layout = cut(layout)
    mixed = labelled.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("block")
    apart = with_ids(labelled, mixed, "block").join(few(layout), "block", "left").join(few(big.select("block", "label", "t", "before")), ["block", "label"], "left")
    start = F.col("pooled") + F.col("before")
    slot = F.xxhash64("member")
    own = F.when(F.col("t").isNotNull(), start + F.pmod(slot, "t")).when(F.col("pooled") > 0, F.pmod(slot, F.col("pooled"))).otherwise(0).cast("int")
    every = F.when(F.col("pooled").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("pooled") + F.col("own_tiles") - 1))
    others = F.when(F.col("t").isNotNull(), F.filter(every, lambda x: (x < start) | (x >= start + F.col("t")))).otherwise(every)
    second = apart.withColumn("own", own).withColumn("other", F.explode(others)).select("block", "own", "other", "member", "label")
    links = checked_links(cut(pairs_of(second, False)), features, percent)
    named = lambda c: joined.select(F.col("member").alias(c), F.col("label").alias(f"{c}_label"))
    links = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    groups = components(links)
    for done in (members, stars, labelled, big, layout, large, features):
        drop(done)

    found = classes.join(joined, F.col("rep") == F.col("member"), "left").select("words_key", "n", F.coalesce("label", "rep").alias("label"))
    by_class = found.join(groups, F.col("label") == F.col("node"), "left").select("words_key", "n", F.coalesce("component", "label").alias("component"))
    out = keyed.drop("n").join(by_class, "words_key", "left").select(
        "doc_id", F.when(F.col("words_key").isNull(), F.lit(0).cast("long")).otherwise(F.col("n")).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
    lost = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(lost)
