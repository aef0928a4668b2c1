"""Exact top-k inner products: norm-sorted scan with SVD-rotated partial sums.

Vectors become integers floor(scale * x). Candidates are sorted by descending length into packed blocks;
blocks of queries meet the blocks in that order in one task and keep their best k so far. A block is skipped
once |q| times its longest vector can't reach the k-th score; inside a block the first dimensions of an
SVD-rotated basis give partial sums, and the rest is bounded by Cauchy-Schwarz with the residual lengths.
Only survivors get the exact integer product. The basis comes from the d x d Gram matrix of all
vectors (a fixed-size sum), and any orthogonal basis gives the same answers.

Products below 2^53 are taken in double precision, where they are exact; pairs whose lengths allow more are multiplied as whole numbers
of any size. Ranks go by the exact product; a score beyond the range of a long is returned as the end of that range.

Edge cases: vectors that are null, empty, or hold null or non-finite components (after scaling, too) take no part; neither do
rows with a null id. Vectors of another length than a query's are no candidates for it. Ties go to the
smaller id, then repeated rows of one id keep their own ranks. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 64
HEAD = 16  # rotated dimensions that are summed before the residual bound
BLOCK = 4096
QUERY_BLOCK = 512


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vec array<double> of whole numbers, dim, len) of the rows that take part."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda v: v * scale).alias("x"))
    ok = (F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
          & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    # Doubles beyond 2^53 are whole numbers already; floor() of Spark would take them through a long.
    whole = F.transform("x", lambda v: F.when(F.abs(v) < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v))
    out = src.where(F.coalesce(ok, F.lit(False))).select("id", whole.alias("vec"))
    top = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    unit = F.aggregate("vec", F.lit(0.0), lambda a, v: a + (v / F.col("top")) * (v / F.col("top")))
    return out.withColumn("top", top).select("id", "vec", F.size("vec").alias("dim"), F.when(F.col("top") > 0, F.col("top") * F.sqrt(unit)).otherwise(0.0).alias("len"))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, also where squares would overflow."""
    top = np.maximum(np.abs(x).max(axis=1, initial=0.0), np.finfo(float).tiny)
    return top * np.sqrt(np.square(x / top[:, None]).sum(axis=1))


def _gram(batches):
    """mapInPandas body: one partial Gram matrix of the directions for each length of vector in a task."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for dim, g in pdf.groupby("dim"):
            x = np.stack(g["vec"].to_numpy()).astype(np.float64)
            x /= np.maximum(lengths(x), 1.0)[:, None]
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, m in sums.items():
        yield pd.DataFrame({"dim": [dim], "m": [m.ravel()]})


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthogonal basis for each vector length, strongest direction first."""
    parts = vectors.select("dim", "vec").mapInPandas(_gram, "dim int, m array<double>")
    sums = parts.select("dim", F.posexplode("m").alias("at", "v")).groupBy("dim", "at").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("m")).collect()  # d*d numbers
    out = {}
    for r in rows:
        m = np.array([x["v"] for x in r["m"]]).reshape(r["dim"], r["dim"])
        out[r["dim"]] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


def _pack(batches):
    """mapInPandas body: rows sorted by (dim, block, len desc) -> one packed row for each block."""
    def row(key, parts):
        ids, vec, length = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pd.DataFrame([{"dim": key[0], "block": key[1], "n": len(ids), "longest": float(length.max()),
                              "ids": ids.tobytes(), "vecs": vec.tobytes()}])

    key, parts = None, []
    for pdf in batches:
        for k, g in pdf.groupby(["dim", "block"], sort=False):
            if k != key and parts:
                yield row(key, parts)
                parts = []
            key = k
            parts.append((g["id"].to_numpy(np.int64), np.stack(g["vec"].to_numpy()).astype(np.float64), g["len"].to_numpy(np.float64)))
    if parts:
        yield row(key, parts)


def _packed(vectors: DataFrame, block: int, what: str) -> DataFrame:
    """Blocks of about `block` vectors in descending length.

    Lengths fall into bands of 0.5 % (128 bands a doubling of the length, so the prefix sum over the
    bands' counts is small); small neighbouring bands share a block, large ones are split by a hash.
    """
    banded = vectors.withColumn("band", F.floor(128 * F.log2(F.col("len") + 1.0)).cast("int"))
    counts = banded.groupBy("dim", "band").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select("dim", "band", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block).cast("long").alias("first"),
                         F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int").alias("parts"))
    dealt = banded.join(cuts, ["dim", "band"]).withColumn("block", F.concat_ws("-", "first", F.pmod(F.xxhash64("id"), F.col("parts"))))
    rows = (dealt.select("dim", "block", "id", "len", "vec").repartition("dim", "block").sortWithinPartitions("dim", "block", F.desc("len"))
            .mapInPandas(_pack, "dim int, block string, n int, longest double, ids binary, vecs binary"))
    return materialise(rows, what)


EXACT = 2.0 ** 53  # sums below it are exact in double precision


class _Best:
    """The k best (score, id) of each query of a block; scores are whole numbers of any size if `large`."""

    def __init__(self, n: int, k: int, large: bool):
        self.k, self.large = k, large
        least = -(1 << 62) if not large else -(1 << 4096)  # negated when sorted, so not the least long
        self.score = np.full((n, k), least, dtype=object if large else np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.low = np.full(n, -np.inf)  # the k-th scores in double precision

    def add(self, q: int, score, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.r_[self.id[q], ids]
        if self.large:
            order = np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k])
        else:
            order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]
        if self.id[q, -1] != np.iinfo(np.int64).max:
            self.low[q] = _double(self.score[q, -1])


def _double(n) -> float:
    try:
        return float(n)
    except OverflowError:
        return np.inf if n > 0 else -np.inf


def whole_products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows with q, exact at any size."""
    y = [int(v) for v in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(r, y)) for r in rows.tolist()], dtype=object)


def _search(k: int, bases: dict[int, np.ndarray], head: int):
    """mapInPandas body over rows sorted by (query block, longest desc): scans each query block's candidates."""
    def start(r):
        ids = np.frombuffer(r.ids, np.int64)
        vec = np.frombuffer(r.vecs, np.float64).reshape(len(ids), r.dim)
        rot = vec @ bases[r.dim]
        return {"ids": ids, "vec": vec, "len": lengths(vec), "head": rot[:, :head], "rest": lengths(rot[:, head:]) if r.dim > head else np.zeros(len(ids)), "best": None}

    def scan(s, r):
        if s["best"] is None:  # the first block holds the longest vectors
            s["best"] = _Best(len(s["ids"]), k, bool(s["len"].max() * r.longest >= EXACT))
        best = s["best"]
        eps = 1e-6 * (1 + s["len"] * r.longest)
        live = np.flatnonzero(s["len"] * r.longest + eps >= best.low)
        if not len(live):
            return
        ids = np.frombuffer(r.ids, np.int64)
        vec = np.frombuffer(r.vecs, np.float64).reshape(len(ids), r.dim)
        rot = vec @ bases[r.dim]
        rest = lengths(rot[:, head:]) if r.dim > head else np.zeros(len(ids))
        for part in np.array_split(live, max(1, len(live) * len(ids) // 2_000_000)):
            bound = s["head"][part] @ rot[:, :head].T + s["rest"][part][:, None] * rest[None, :] + eps[part][:, None]
            open_ = ~(bound < best.low[part][:, None])  # an overflow leaves a pair open
            dense = open_.mean() > 0.1
            about = s["vec"][part] @ vec.T if dense else None
            for row in np.flatnonzero(open_.any(axis=1)):
                q = part[row]
                hit = np.flatnonzero(open_[row] & (ids != s["ids"][q]))
                near = about[row][hit] if dense else vec[hit] @ s["vec"][q]
                keep = ~(near + eps[q] < best.low[q]) if best.large else near >= best.low[q]
                _offer(best, q, near[keep], hit[keep], ids, vec, s["vec"][q], eps[q])

    def done(s):
        best = s["best"]
        if best is None:
            return pd.DataFrame({"query_id": [], "rank": np.zeros(0, np.int32), "vec_id": [], "score": []})
        at = np.nonzero(best.id != np.iinfo(np.int64).max)
        score = best.score[at]
        if best.large:
            score = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score], np.int64)
        return pd.DataFrame({"query_id": s["ids"][at[0]], "rank": (at[1] + 1).astype(np.int32), "vec_id": best.id[at], "score": score})

    def run(batches):
        s = None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.role == 0:  # a block of queries; its candidates follow
                    if s is not None:
                        yield done(s)
                    s = start(r)
                else:
                    scan(s, r)
        if s is not None:
            yield done(s)

    return run


def _offer(best: _Best, q: int, near: np.ndarray, at: np.ndarray, ids: np.ndarray, vec: np.ndarray, asked: np.ndarray, eps: float) -> None:
    """Offers candidates `at` with their products in double precision; whole numbers are taken of those that can be among the best."""
    if len(near) > 4 * best.k:  # keep ties of the k-th
        cut = np.partition(near, len(near) - best.k)[len(near) - best.k]
        some = ~(near < cut - (2 * eps if best.large else 0))
        near, at = near[some], at[some]
    if len(near):
        best.add(q, whole_products(vec[at], asked) if best.large else np.rint(near).astype(np.int64), ids[at])


def top_inner_products(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
                       scale: int = SCALE, head: int = HEAD, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of df for each row of queries, never the query's own id."""
    vectors = materialise(integer_vectors(df, id_col, vec_col, scale), "topk-vectors")
    asked = materialise(integer_vectors(queries, id_col, vec_col, scale), "topk-queries")
    bases = rotations(vectors)
    found = _packed(vectors, block, "topk-blocks")
    q = _packed(asked, query_block, "topk-query-blocks").select("dim", F.col("block").alias("q_block"), "longest", "ids", "vecs")
    # A stated query set against all rows, in blocks: every query block meets every candidate block once.
    pairs = q.select("dim", "q_block").join(found.select("dim", "block"), "dim")
    rows = (pairs.join(found, ["dim", "block"]).select("dim", "q_block", F.lit(1).alias("role"), "longest", "block", "ids", "vecs")
            .unionByName(q.select("dim", "q_block", F.lit(0).alias("role"), "longest", F.lit("").alias("block"), "ids", "vecs")))
    met = rows.repartition("dim", "q_block").sortWithinPartitions("dim", "q_block", "role", F.desc("longest"), "block")
    return met.mapInPandas(_search(k, bases, head), "query_id long, rank int, vec_id long, score long")
