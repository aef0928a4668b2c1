"""Connected components of a graph that is too large for one machine.

Rounds of random-priority contraction: every node points to the neighbour (or itself) with the
smallest hash of this round's seed, pointers are followed to their roots, and the edges are rewritten between
roots. Each round at least halves the remaining nodes in expectation, whatever the shape of the graph
(a chain of n links needs O(log n) rounds). A hot node (the centre of a star) is only ever the
key of a pre-aggregated minimum or of a join that AQE can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b (vectorised)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (root == before).all():
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def forest_edges(batches, rows: int = 2_000_000):
    """mapInPandas body: links (src, dst) -> a spanning forest of each chunk of links."""
    held, n = [], 0

    def flush():
        src = np.concatenate([h[0] for h in held])
        dst = np.concatenate([h[1] for h in held])
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        root = local_roots(len(ids), at[: len(src)], at[len(src):])
        child = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"src": ids[child], "dst": ids[root[child]]})

    for pdf in batches:
        held.append((pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)))
        n += len(pdf)
        if n >= rows:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (src, dst long, no nulls); root is one node of the component."""
    spark = edges.sparkSession
    forest = edges.where("src <> dst").mapInPandas(forest_edges, "src long, dst long")
    links = materialise(forest.distinct(), "cc-links")
    labels = None
    seed = 0
    while not links.isEmpty():
        seed += 1
        both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("n"))
        best = both.groupBy("src").agg(F.min(rank("dst")).alias("m"))
        point = materialise(best.select(F.col("src").alias("node"),
                                        F.least(F.col("m"), rank("src"))["n"].alias("to")), "cc-point")
        # Follow the pointers to their roots; hashes fall along a path, so there is no cycle.
        while True:
            on = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = materialise(point.join(on, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "cc-point")
            discard(point)
            point = jumped
            if point.where("moved").isEmpty():
                break
        point_ = point.select("node", "to")
        cut = (links.join(point_.select(F.col("node").alias("src"), F.col("to").alias("s")), "src")
               .join(point_.select(F.col("node").alias("dst"), F.col("to").alias("d")), "dst")
               .where("s <> d")
               .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct())
        left = materialise(cut, "cc-links")
        discard(links)
        links = left
        if labels is None:
            labels = point_.select("node", F.col("to").alias("root"))
        else:
            old = labels
            labels = materialise(old.join(point_.select(F.col("node").alias("root"), F.col("to").alias("top")), "root", "left")
                                 .select("node", F.coalesce("top", "root").alias("root")), "cc-labels")
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels
