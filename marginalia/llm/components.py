"""Connected components of a link table, by forests within partitions and then large-star / small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (the smallest index) of each of n nodes under the links a[i]-b[i]."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(links: np.ndarray) -> np.ndarray:
    """The (node, smallest node) rows that connect what an (n, 2) array of links connects."""
    if not len(links):
        return np.empty((0, 2), np.int64)
    nodes, at = np.unique(links.ravel(), return_inverse=True)
    at = at.reshape(-1, 2)
    root = union_find(at[:, 0], at[:, 1], len(nodes))
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]], axis=1)


def _forests(batches):
    held, waiting = np.empty((0, 2), np.int64), []
    for batch in batches:
        waiting.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        if sum(map(len, waiting)) > 2_000_000:
            held, waiting = forest(np.concatenate([held, *waiting])), []
    held = forest(np.concatenate([held, *waiting]))
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node long, component long) for every node of the links (a long, b long); component is its smallest node.

    Each round reads each link a fixed number of times and the number of rounds follows the logarithm of the
    nodes; hubs are reduced to their minimum before rows move. Null ends and self-links add nothing. An empty
    table gives an empty table.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = cut(links.mapInArrow(_forests, "a long, b long"))  # a > b
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, edges = edges, cut(small.union(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct())
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
