"""Embedding near-dedup: exact threshold pairs by a dual traversal of cover trees.

Vectors of a label are dealt into blocks of bounded size; each block becomes one cover tree whose nested
levels have radii that halve. Two blocks of a label meet in one task, which descends both trees at
once and prunes node pairs whose distance exceeds the link distance plus both covering radii.
Node pairs that lie so close that all their members link are counted without being
opened. Tasks return link counts and spanning forests, never all pairs of a group.

Distances are chords of the unit vectors: cosine >= c is chord <= sqrt(2 - 2c).

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing and are their own component (kept). Vectors of different lengths
never link. Equal vectors are one node with a multiplicity, so a very common vector costs one row.
A null id takes part in link counts, but a component is named by its smallest non-null
id; if it has none, component_id is null and kept is true. Repeated rows count as other vectors.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components, local_roots

SLACK = 1e-6  # for rounding in the bounds; leaf pairs get the exact test
BLOCK = 2048


class CoverTree:
    """Nested levels of one block: the points of level k are more than r_k = 2^(1-k) apart and every point of the block lies
    within r_k of one of them; the last level has all points (from a radius of 0.001 on, or where nearly all points are nodes).

    levels[k] = (points, parent position in level k-1); level 0 is one point. A node's parent is the nearest node of the level above.
    member[k] is each point's ancestor in level k, cover[k] each node's largest distance to a point below it (its covering radius).
    """

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        self.radii = [2.0]
        near = np.zeros(n, np.int64)  # position of the nearest point of the level
        dist = _chord(unit, unit[:1])[:, 0]
        dist[0] = 0.0
        radius = 1.0
        while len(self.levels[-1][0]) < n:
            before = len(self.levels[-1][0])
            points, parents = self.levels[-1][0].tolist(), list(range(before))
            above = near.copy()
            if radius < 1e-3 or before > 0.9 * n:  # the rest are leaves
                rest = np.setdiff1d(np.arange(n), self.levels[-1][0])
                points.extend(rest.tolist())
                parents.extend(above[rest].tolist())
                radius = 0.0
            else:
                # Greedy: a point farther than the radius from all nodes becomes one, and the nearest node of what lies closer to it.
                while len(far := np.flatnonzero(dist > radius)):
                    p = far[0]
                    d = _chord(unit, unit[p:p + 1])[:, 0]
                    d[p] = 0.0
                    points.append(int(p))
                    parents.append(int(above[p]))
                    closer = d < dist
                    near[closer], dist[closer] = len(points) - 1, d[closer]
            self.levels.append((np.array(points), np.array(parents)))
            self.radii.append(radius)
            radius /= 2
        place = np.empty(n, np.int64)
        place[self.levels[-1][0]] = np.arange(n)
        self.member, self.cover = [place], []
        for _, parents in self.levels[:0:-1]:
            self.member.append(parents[self.member[-1]])
        self.member.reverse()
        for (points, _), member in zip(self.levels, self.member):
            cover = np.zeros(len(points))
            np.maximum.at(cover, member, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", unit, unit[points[member]]))))
            self.cover.append(cover)


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _pairs_at(unit_a, pa, unit_b, pb, i, j) -> np.ndarray:
    """Chords of the node pairs (i, j): by one product where most pairs are open, else pair by pair."""
    if len(i) * 8 > len(pa) * len(pb):
        return _chord(unit_a[pa], unit_b[pb])[i, j]
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 15):
        e = s + (1 << 15)
        out[s:e] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", unit_a[pa[i[s:e]]], unit_b[pb[j[s:e]]])))
    return out


def dual_links(va: np.ndarray, vb: np.ndarray, cosine: float, ta: CoverTree, tb: CoverTree):
    """Boolean matrix of links between the raw vectors of two blocks, by dual descent of their trees."""
    ua, ub = _unit(va), _unit(vb)
    reach = math.sqrt(2 - 2 * cosine)
    link = np.zeros((len(va), len(vb)), bool)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(max(len(ta.levels), len(tb.levels))):
        ka, kb = min(k, len(ta.levels) - 1), min(k, len(tb.levels) - 1)
        (pa, qa), (pb, qb) = ta.levels[ka], tb.levels[kb]
        if k:
            # children of the open pairs
            ca, cb = _children(qa, ka == k, i, len(pa)), _children(qb, kb == k, j, len(pb))
            i, j = _product(ca, cb)
        d = _pairs_at(ua, pa, ub, pb, i, j)
        ra, rb = ta.cover[ka][i], tb.cover[kb][j]
        keep = d <= reach + ra + rb + SLACK
        i, j, d, ra, rb = i[keep], j[keep], d[keep], ra[keep], rb[keep]
        sure = d + ra + rb < reach - SLACK
        if sure.any():
            # every member of a is linked with every member of b
            ma, mb = ta.member[ka], tb.member[kb]
            oa, ob = np.argsort(ma, kind="stable"), np.argsort(mb, kind="stable")
            sa, sb = np.searchsorted(ma[oa], np.arange(len(pa) + 1)), np.searchsorted(mb[ob], np.arange(len(pb) + 1))
            for x, y in zip(i[sure], j[sure]):
                link[np.ix_(oa[sa[x]:sa[x + 1]], ob[sb[y]:sb[y + 1]])] = True
            i, j, d, ra, rb = i[~sure], j[~sure], d[~sure], ra[~sure], rb[~sure]
        if not len(i):
            return link
    a, b = ta.levels[-1][0][i], tb.levels[-1][0][j]  # leaves: single vectors
    x, y = va[a], vb[b]
    dots = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
    link[a[dots >= cosine], b[dots >= cosine]] = True
    return link


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _children(parent: np.ndarray, deeper: bool, nodes: np.ndarray, n: int):
    """For each node of the list the positions of its children on the next level (itself, if there is none)."""
    if not deeper:
        return np.arange(len(nodes) + 1), nodes
    order = np.argsort(parent, kind="stable")
    start = np.searchsorted(parent[order], nodes)
    count = np.searchsorted(parent[order], nodes, side="right") - start
    at = np.r_[0, np.cumsum(count)]
    return at, order[np.repeat(start - at[:-1], count) + np.arange(at[-1])]


def _product(ca, cb):
    """All pairs of the children of each node pair."""
    (sa, xa), (sb, xb) = ca, cb
    na, nb = np.diff(sa), np.diff(sb)
    total = na * nb
    at = np.r_[0, np.cumsum(total)]
    pair = np.repeat(np.arange(len(total)), total)
    k = np.arange(at[-1]) - at[:-1][pair]
    return xa[sa[pair] + k // nb[pair]], xb[sb[pair] + k % nb[pair]]


def _block_tasks(cosine: float):
    """mapInPandas body over packed pairs of blocks: rows (node, links, root)."""
    def unpack(ids, vecs, mult, tree, dim):
        return np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float64).reshape(-1, dim), np.frombuffer(mult, np.int64), pickle.loads(tree)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ia, va, ma, ta = unpack(r.ids_a, r.vecs_a, r.mult_a, r.tree_a, r.dim)
                same = r.block_a == r.block_b
                ib, vb, mb, tb = (ia, va, ma, ta) if same else unpack(r.ids_b, r.vecs_b, r.mult_b, r.tree_b, r.dim)
                link = dual_links(va, vb, cosine, ta, tb)
                if same:
                    link |= link.T
                    np.fill_diagonal(link, False)
                    ids, n_links = ia, link @ ma
                    a, b = np.nonzero(np.triu(link))
                else:
                    ids, n_links = np.r_[ia, ib], np.r_[link @ mb, ma @ link]
                    a, b = np.nonzero(link)
                    b = b + len(ia)
                root = local_roots(len(ids), a, b)
                hit = n_links > 0
                yield pd.DataFrame({"node": ids[hit], "links": n_links[hit].astype(np.int64), "root": ids[root[hit]]})

    return run


def _pack(groups):
    """mapInPandas body: rows sorted by (label, dim, block) -> one packed row with its cover tree for each block."""
    def row(key, parts):
        vecs = np.concatenate([p[2] for p in parts])
        vecs = np.ldexp(vecs, -np.frexp(np.abs(vecs).max(axis=1))[1][:, None])  # by powers of two: squares can't overflow
        return {"label": key[0], "dim": key[1], "block": key[2], "ids": np.concatenate([p[0] for p in parts]).tobytes(),
                "mult": np.concatenate([p[1] for p in parts]).tobytes(), "vecs": vecs.tobytes(), "tree": pickle.dumps(CoverTree(_unit(vecs)))}

    key, parts = None, []
    for pdf in groups:
        for k, g in pdf.groupby(["label", "dim", "block"], sort=False):
            if k != key and parts:
                yield pd.DataFrame([row(key, parts)])
                parts = []
            key = k
            parts.append((g["node"].to_numpy(np.int64), g["mult"].to_numpy(np.int64), np.stack(g["vec"].to_numpy()).astype(np.float64)))
    if parts:
        yield pd.DataFrame([row(key, parts)])


def embedding_neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                         cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"),
                    F.col(f"`{label_col}`").cast("string").alias("label"))
    ok = (F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
          & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
          & F.exists("vec", lambda x: x != 0))
    src = src.withColumn("ok", F.coalesce(ok, F.lit(False)))
    src = src.withColumn("vec", F.when(F.col("ok"), F.transform("vec", lambda x: x + F.lit(0.0))))  # -0.0 -> 0.0
    rows = materialise(src, "cover-rows")

    # Equal vectors are one node; its number is the hash-free rank of its block and place.
    classes = rows.where("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    classes = classes.withColumn("dim", F.size("vec")).withColumn("h", F.xxhash64("label", "vec"))
    classes = materialise(classes, "cover-classes")
    sizes = classes.groupBy("label", "dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("n_blocks"))
    numbered = materialise(classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod("h", "n_blocks").cast("int"))
                           .withColumn("node", F.monotonically_increasing_id()), "cover-nodes")
    packed = materialise(numbered.select("label", "dim", "block", "node", "mult", "vec").repartition("label", "dim", "block")
                         .sortWithinPartitions("label", "dim", "block")
                         .mapInPandas(_pack, "label string, dim int, block int, ids binary, mult binary, vecs binary, tree binary"), "cover-blocks")
    a = packed.select("label", "dim", F.col("block").alias("block_a"), F.col("ids").alias("ids_a"), F.col("mult").alias("mult_a"), F.col("vecs").alias("vecs_a"), F.col("tree").alias("tree_a"))
    b = packed.select("label", "dim", F.col("block").alias("block_b"), F.col("ids").alias("ids_b"), F.col("mult").alias("mult_b"), F.col("vecs").alias("vecs_b"), F.col("tree").alias("tree_b"))
    pairs = (packed.join(sizes, ["label", "dim"])
             .select("label", "dim", F.col("block").alias("block_a"), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("block_b")))
    # Blocks of one label meet pair by pair, dealt by (label, pair), so that a hot label spreads over all tasks.
    met = (pairs.join(a, ["label", "dim", "block_a"]).join(b, ["label", "dim", "block_b"])
           .repartition("label", "dim", "block_a", "block_b"))
    found = materialise(met.mapInPandas(_block_tasks(cosine), "node long, links long, root long"), "cover-links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = (numbered.select("node", "label", "vec", "low", "mult").join(counts, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = materialise(named.join(lows, "root").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"), "cover-answer")
    linked = rows.where("ok").join(answer, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
