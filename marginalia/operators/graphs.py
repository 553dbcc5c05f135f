"""PageRank on many small graphs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def stable_rank(m: np.ndarray, damping: float = 0.85, most: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Ranks that sum to 1 by power iteration on non-negative weights; a node without links leads everywhere alike."""
    n = len(m)
    if not n:
        return np.empty(0)
    m = np.where(np.isfinite(m) & (m > 0), m, 0.0)
    out = m.sum(axis=1, keepdims=True)
    step = np.where(out > 0, m / np.where(out > 0, out, 1), 1.0 / n)
    rank = np.full(n, 1.0 / n)
    for _ in range(most):
        new = (1 - damping) / n + damping * (rank @ step)
        new /= new.sum()
        if np.abs(new - rank).sum() < tolerance:
            return new
        rank = new
    return rank


def pagerank(edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """edges (graph_id, src, dst, w) of graphs that each fit a task -> graph_id, node, rank; repeated edges add up."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([g["src"], g["dst"]]), return_inverse=True)
        m = np.zeros((len(nodes), len(nodes)))
        np.add.at(m, (at[: len(g)], at[len(g) :]), g["w"].to_numpy(float))
        return pd.DataFrame({"graph_id": g["graph_id"].iloc[0], "node": nodes, "rank": stable_rank(m, damping).round(9)})

    return edges.groupBy("graph_id").applyInPandas(solve, f"graph_id {edges.schema['graph_id'].dataType.simpleString()}, node long, rank double")


def scaled_to_one(ranks: DataFrame) -> DataFrame:
    """Ranks as shares of each graph's largest, as sentence ranking uses them."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    return ranks.withColumn("rank", F.round(F.col("rank") / F.max("rank").over(Window.partitionBy("graph_id")), 6))
