"""Embedding near-dedup: PCA-ordered tiled comparison.

Unit vectors are turned into the directions of most energy first. Space is split into tiles along the leading
directions; tiles too far apart are never compared. Between two tiles products accumulate from the leading
dimensions on, and what the other dimensions can still add is bounded by the product of the suffix norms: a pair
drops out as soon as its cosine can't reach the threshold. Tiles are dealt by pairs of groups, so that each travels
once for a group it meets and not once for a tile; a task holds one group and meets the other's tiles as they come.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .components import components, forest

log = logging.getLogger(__name__)

TILE = 2048  # vectors of a tile, about
LEAD = 8  # dimensions that tiles are split along, and of the first block of products
SAMPLE = 50_000  # vectors, about, that the splits are fitted to; every vector is placed and compared
SLACK = 1e-9  # by which bounds are wider than rounding can take them
STRIP = 512  # rows of a tile that are compared at once
PART = 2048  # rows of a tile that travel as one
HELD_BYTES = 24 << 20  # of vectors that a task holds to compare others with; they are held twice, as they are and turned


def _vectors(batches):
    """(id, array) -> (vec_id, d, vector); d is 0 for a vector that links with nothing."""
    for batch in batches:
        column = batch.column(1)
        d, raw = [], []
        values = column.values if isinstance(column, pa.ListArray) else column.combine_chunks().values
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        offsets = column.offsets.to_numpy()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        for i, ok in enumerate(there):
            v = flat[offsets[i] : offsets[i + 1]]
            top = np.abs(v).max() if len(v) else 0.0
            if not ok or not np.isfinite(v).all() or not top:
                d.append(0)
                raw.append(None)
            else:
                d.append(len(v))
                raw.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "d", "vector"])


def unit(raw: list[bytes], d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(d):
    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = unit(batch.column("vector").to_pylist(), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    return run


def _added(batches):
    total = None
    for batch in batches:
        for m in batch.column(0).to_pylist():
            total = np.frombuffer(m) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])


def directions(vectors: DataFrame, d: int) -> np.ndarray:
    """Columns: the eigenvectors of all unit vectors' second moments, those of most energy first."""
    parts = vectors.select("vector").mapInArrow(_moments(d), "m binary").repartition(8).mapInArrow(_added, "m binary").collect()  # 8 rows
    m = sum((np.frombuffer(r["m"]) for r in parts), np.zeros(d * d)).reshape(d, d)
    return np.linalg.eigh(m)[1][:, ::-1].copy()


class Splits:
    """A binary tree of cuts along the leading directions, fitted to a sample; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, most: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # (dimension, cut, left, right); a child below 0 is leaf -child - 1
        self.leaves = 0
        self.root = self._grow(points, most)

    def _grow(self, points, most):
        if len(points) > most:
            k = int((np.quantile(points, 0.9, axis=0) - np.quantile(points, 0.1, axis=0)).argmax())
            at = float(np.median(points[:, k]))
            low = points[:, k] < at
            if low.any() and not low.all():
                self.nodes.append(None)
                i = len(self.nodes) - 1
                self.nodes[i] = (k, at, self._grow(points[low], most), self._grow(points[~low], most))
                return i
        self.leaves += 1
        return -self.leaves

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        if self.root >= 0:
            k, cuts, left, right = (np.array(c) for c in zip(*self.nodes))
            while (inner := np.flatnonzero(at >= 0)).size:
                n = at[inner]
                at[inner] = np.where(points[inner, k[n]] < cuts[n], left[n], right[n])
        return -at - 1


def _located(shared, d):
    def run(batches):
        turn, splits = shared.value
        lead = min(LEAD, d)
        for batch in batches:
            unit_rows = unit(batch.column("vector").to_pylist(), d)
            x = unit_rows @ turn[:, :lead]
            tail = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(splits.leaf(x).astype(np.int32)), *(pa.array(x[:, k]) for k in range(lead)), pa.array(tail)], ["rep", "copies", "vector", "leaf", *(f"x{k}" for k in range(lead + 1))]
            )

    return run


class Boxes:
    """The leaves' boxes over the leading directions and the length of the rest, and where the leaves' tiles are."""

    def __init__(self, leaves: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float, row_bytes: int):
        order = np.argsort(leaves)
        self.leaves, self.low, self.high, self.reach = leaves[order], low[order], high[order], reach
        self.chunks = -(-sizes[order] // (2 * TILE))
        self.first = np.concatenate([[0], np.cumsum(self.chunks)])  # the number of each leaf's first tile
        tiles = int(self.first[-1])
        # As many tiles to a group as there are groups, but no more than a task may hold.
        self.group = max(1, min(math.isqrt(max(0, tiles - 1)) + 1, HELD_BYTES // max(1, 2 * TILE * row_bytes)))
        self.groups = -(-tiles // self.group)

    def near(self, at: int) -> np.ndarray:
        """The indexes of the leaves that a vector of this one can link to: boxes no farther apart than `reach`."""
        gap = np.maximum(0, np.maximum(self.low - self.high[at], self.low[at] - self.high))
        return np.flatnonzero((gap * gap).sum(axis=1) <= self.reach * self.reach)

    def near_groups(self, at: int) -> np.ndarray:
        """The groups of tiles that hold any tile of those leaves."""
        near = self.near(at)
        return np.unique(np.concatenate([np.arange(self.first[k] // self.group, (self.first[k + 1] - 1) // self.group + 1) for k in near]))


def _blobs(boxes):
    """Rows sorted by (leaf, chunk) -> the rows of a tile in parts of at most PART, once for each group of tiles that it meets."""

    def out(key, rows):
        b = boxes.value
        at = int(np.searchsorted(b.leaves, key[0]))
        tile = int(b.first[at]) + key[1]
        own, met = tile // b.group, b.near_groups(at)
        data = [b"".join(r) for r in rows]
        low, high = np.minimum(own, met), np.maximum(own, met)
        n = len(met)
        return pa.RecordBatch.from_arrays(
            [pa.array(low.astype(np.int64) * b.groups + high), pa.array((low != own).astype(np.int8)), pa.array([tile] * n, pa.int64()), pa.array([at] * n, pa.int32()), *(pa.array([x] * n, pa.binary()) for x in data)],
            ["cell", "side", "tile", "leaf", "reps", "copies", "vectors"],
        )

    def run(batches):
        key, rows, held = None, ([], [], []), 0
        for batch in batches:
            for leaf, chunk, rep, n, v in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (leaf, chunk) != key or held == PART:
                    if key is not None:
                        yield out(key, rows)
                    key, rows, held = (leaf, chunk), ([], [], []), 0
                held += 1
                for kept, x in zip(rows, (rep.to_bytes(8, "little", signed=True), n.to_bytes(8, "little"), v)):
                    kept.append(x)
        if key is not None:
            yield out(key, rows)

    return run


def close_pairs(x: np.ndarray, y: np.ndarray, least: float, blocks: tuple[int, ...] = (LEAD, 24)) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) with x[i] . y[j] >= least, of unit rows whose leading dimensions hold the most."""
    d = x.shape[1]
    ends = [*(b for b in blocks if b < d), d]
    tail = lambda z, e: np.sqrt(np.maximum(0, (z[:, e:] ** 2).sum(axis=1)))
    products = x[:, : ends[0]] @ y[:, : ends[0]].T
    i, j = np.nonzero(products + np.outer(tail(x, ends[0]), tail(y, ends[0])) >= least - SLACK)
    so_far = products[i, j]
    for start, end in zip(ends, ends[1:]):
        if products is not None and len(i) > 0.05 * products.size:  # many left: this block for all pairs at once
            products += x[:, start:end] @ y[:, start:end].T
            so_far = products[i, j]
        else:  # from here on for single pairs
            products = None
            so_far = so_far + np.einsum("ij,ij->i", x[i, start:end], y[j, start:end])
        keep = so_far + tail(x, end)[i] * tail(y, end)[j] >= least - SLACK
        i, j, so_far = i[keep], j[keep], so_far[keep]
    return i, j


class _Part:
    """Some rows of a tile: ids, copies, unit vectors as they are and turned."""

    def __init__(self, row, turn, d):
        self.tile, self.leaf = row["tile"], row["leaf"]
        self.ids, self.n, self.x = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64), unit([row["vectors"]], d)
        self.turned = self.x @ turn
        self.count = np.zeros(len(self.ids), np.int64)


def _meet(a: _Part, b: _Part, least: float):
    """Counts the links of a and b (of a alone if they are one) and gives edges that connect what they connect."""
    edges = np.empty((0, 2), np.int64)
    for s in range(0, len(a.ids), STRIP):
        i, j = close_pairs(a.turned[s : s + STRIP], b.turned, least)
        i = i + s
        if a is b:
            i, j = i[i < j], j[i < j]
        ok = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= least  # the decision is on the vectors as they are
        i, j = i[ok], j[ok]
        np.add.at(a.count, i, b.n[j])
        np.add.at(b.count, j, a.n[i])
        edges = forest(np.concatenate([edges, np.stack([a.ids[i], b.ids[j]], axis=1)]))
    return edges


def _compared(shared, boxes, d, least):
    """Rows sorted by (cell, side, tile): a cell is a pair of groups of tiles. Those of its first group are held, those of the second met as they come."""

    def run(batches):
        turn, b = shared.value[0], boxes.value
        near: dict[int, set[int]] = {}

        def links(who):
            hit = who.count > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(who.ids[hit]), pa.nulls(hit.sum(), pa.int64()), pa.array(who.count[hit])], ["a", "b", "n"])

        def pairs(edges):
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.int64())], ["a", "b", "n"])

        cell, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["cell"] != cell:
                    for who in held:
                        yield from links(who)
                    cell, held, near = row["cell"], [], {}
                now = _Part(row, turn, d)
                if now.leaf not in near:
                    near[now.leaf] = set(b.near(now.leaf).tolist())
                alone = cell // b.groups == cell % b.groups
                for other in held if alone or row["side"] else ():
                    if other.leaf in near[now.leaf]:
                        yield from pairs(_meet(other, now, least))
                if alone:
                    yield from pairs(_meet(now, now, least))
                if row["side"] == 0:
                    held.append(now)
                else:
                    yield from links(now)
        for who in held:
            yield from links(who)

    return run


def _links(vectors: DataFrame, d: int, least: float) -> DataFrame:
    """Distinct vectors (rep, copies, vector) of one length -> (a, null, n): a part of a's links, and (a, b, null): pairs that connect."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    count = vectors.count()
    turn = directions(vectors, d)
    sample = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < min(1.0, SAMPLE / max(1, count)) * 1_000_003).select("vector").toArrow().column(0).to_pylist()
    lead = min(LEAD, d)
    points = unit(sample, d) @ turn[:, :lead] if sample else np.empty((0, lead))
    splits = Splits(points, max(1, int(TILE * max(1, len(sample)) / max(1, count))))
    shared = spark.sparkContext.broadcast((turn, splits))
    located = cut(vectors.select("rep", "copies", "vector").mapInArrow(_located(shared, d), "rep long, copies long, vector binary, leaf int, " + ", ".join(f"x{k} double" for k in range(lead + 1))))
    rows = located.groupBy("leaf").agg(F.count("*").alias("size"), *(f(f"x{k}").alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(lead + 1))).collect()  # at most a row for each vector of the sample
    low, high = (np.array([[r[f"{f}{k}"] for k in range(lead + 1)] for r in rows]).reshape(-1, lead + 1) for f in ("min", "max"))
    leaves, sizes = (np.array([r[c] for r in rows], np.int64) for c in ("leaf", "size"))
    boxes = Boxes(leaves, sizes, low, high, float(np.sqrt(max(0.0, 2 - 2 * least)) + SLACK), 8 * d)
    log.info("%d vectors of length %d, %d leaves, %d tiles in %d groups, %.3f of the pairs of leaves near", count, d, len(rows), boxes.first[-1], boxes.groups, sum(len(boxes.near(k)) for k in range(0, len(rows), max(1, len(rows) // 200))) / max(1, len(range(0, len(rows), max(1, len(rows) // 200)))) / max(1, len(rows)))
    placed = spark.sparkContext.broadcast(boxes)
    many = spark.createDataFrame([(int(k), int(n)) for k, n in zip(boxes.leaves, boxes.chunks) if n > 1], "leaf int, chunks int")
    chunk = F.pmod(F.xxhash64("rep"), F.coalesce("chunks", F.lit(1))).cast("int")
    chunked = located.join(F.broadcast(many), "leaf", "left").select("leaf", chunk.alias("chunk"), "rep", "copies", "vector")  # many: no more rows than leaves
    kinds = "cell long, side byte, tile long, leaf int, reps binary, copies binary, vectors binary"
    blobs = chunked.repartition(parts, "leaf", "chunk").sortWithinPartitions("leaf", "chunk").mapInArrow(_blobs(placed), kinds)
    cells = boxes.groups * (boxes.groups + 1) // 2
    dealt = blobs.repartition(max(parts, min(cells, 4 * parts)), "cell").sortWithinPartitions("cell", "side", "tile")
    return dealt.mapInArrow(_compared(shared, placed, d, least), "a long, b long, n long")


def near_vectors(embeddings: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Two vectors link when their cosine in double precision is at least `least` (over 0). Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, as do vectors of different lengths with
    each other. Equal vectors are compared once and counted as often as they occur; rows that repeat an id are
    one vector of several forms, each row with the links of all. A row with a null id links with nothing and comes back with a null component. Other columns
    are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    known = cut(rows.where("vec_id is not null").mapInArrow(_vectors, "vec_id long, d int, vector binary").withColumn("key", F.expr("if(d = 0, null, unhex(md5(vector)))")))
    reps = cut(known.where("d > 0").groupBy("d", "key", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sizes = [r["d"] for r in reps.select("d").distinct().collect()]  # the vector lengths that occur
    found = None
    for d in sorted(sizes):
        part = _links(reps.where(F.col("d") == d).select("rep", "copies", "vector"), d, least)
        found = part if found is None else found.union(part)
    if found is None:
        result = known.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        found = cut(found)
        links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links"))
        joined = components(found.where("b is not null").select("a", "b"))
        classes = reps.join(links, reps["rep"] == links["a"], "left").join(joined, F.col("rep") == F.col("node"), "left")
        classes = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
        result = known.join(classes, "key", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    lost = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return result.union(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
