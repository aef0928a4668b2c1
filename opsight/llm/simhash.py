"""SimHash near-dedup with BK-trees.

Fingerprints are made in tasks over whole texts. Two fingerprints within `radius` bits agree in at least
one of radius+1 blocks of their bits, so distinct fingerprints are dealt into shards by (block, bits of the block);
each shard holds one BK-tree per block value (children keyed by the integer Hamming distance to
the parent) and each member follows only the edges within the radius. Shard trees travel to the
tasks that hold their queries rather than to every executor, because the set of all trees grows with the data.
A block value shared by more than `max_class` fingerprints is split again by its remaining
bits, in the same exact way. Tasks return spanning forests, never all pairs.

Edge cases: null and empty texts have fingerprint 0 and link like any other; repeated rows are
copies; a null id is never the smallest of its group unless all are null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, encode_text, free_names, materialise
from .components import connected_components, local_roots

SEED = 42  # of XXH64
MAX_CLASS = 4096
MAX_DEPTH = 3


def fingerprint(text, shingle: int) -> int:
    """Unsigned 64-bit SimHash of a text: majority of the bits of its word shingles' XXH64."""
    words = encode_text(text).lower().split()  # bytes: lowers A-Z alone, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8).reshape(-1, 8)
    n = len(digests)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(digests[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the id column and the fingerprint as a signed 64-bit long."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return add_column(src, "fp", T.LongType(), "text", _fingerprints(shingle), keep=["id"])


def _fingerprints(shingle: int):
    """What add_column starts in a task."""
    def start():
        return lambda texts: pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return start


class BKForest:
    """One BK-tree for each class of fingerprints, in arrays; built and searched level by level."""

    def __init__(self, fps: np.ndarray, classes: np.ndarray):
        self.fps = fps
        n = len(fps)
        open_ = np.arange(n)  # points that have no place yet
        _, group = np.unique(classes, return_inverse=True)
        self.root_of_class = None
        self.class_of = group
        codes, nodes = [], []  # parent * 65 + distance -> child
        group_code = None
        while len(open_):
            order = np.argsort(group, kind="stable")
            open_, group = open_[order], group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            heads = open_[first]
            head = np.repeat(heads, np.diff(np.r_[first, len(open_)]))
            if self.root_of_class is None:
                self.root_of_class = heads
            else:
                codes.append(group_code[group[first]])
                nodes.append(heads)
            rest = open_ != head
            open_, head = open_[rest], head[rest]
            code = head.astype(np.int64) * 65 + np.bitwise_count(fps[open_] ^ fps[head])
            group_code, group = np.unique(code, return_inverse=True)
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(self.codes)
        self.codes, self.nodes = self.codes[order], self.nodes[order]

    def links(self, radius: int, chunk: int = 1 << 15):
        """Yields arrays (query, node) of linked members of one class, each pair from both ends."""
        for start in range(0, len(self.fps), chunk):
            q = np.arange(start, min(start + chunk, len(self.fps)))
            node = self.root_of_class[self.class_of[q]]
            while len(q):
                d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
                hit = (d <= radius) & (q != node)
                if hit.any():
                    yield q[hit], node[hit]
                nq, nn = [], []
                for k in range(-radius, radius + 1):
                    if not len(self.codes):
                        break
                    want = d + k
                    ok = (want >= 0) & (want <= 64)
                    code = node[ok].astype(np.int64) * 65 + want[ok]
                    at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                    found = self.codes[at] == code
                    nq.append(q[ok][found])
                    nn.append(self.nodes[at[found]])
                q = np.concatenate(nq) if nq else np.empty(0, np.int64)
                node = np.concatenate(nn) if nn else np.empty(0, np.int64)


def _blocks(start: int, stop: int, n: int) -> list[tuple[int, int]]:
    """Cuts the bits start..stop into n nearly equal ranges (some empty if there are too few bits)."""
    edge = [start + (stop - start) * i // n for i in range(n + 1)]
    return list(zip(edge, edge[1:]))


def _tree_links(radius: int, rows: int = 200_000):
    """mapInPandas body over rows sorted by class: forests of the links inside each class."""
    def solve(cls, fps):
        fps = fps.view(np.uint64)
        root = np.arange(len(fps))
        for a, b in BKForest(fps, cls).links(radius):
            roots = local_roots(len(fps), np.r_[a, np.arange(len(fps))], np.r_[b, root])
            root = roots
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"src": fps[child].view(np.int64), "dst": fps[root[child]].view(np.int64)})

    def run(batches):
        cls, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            cls = np.r_[cls, pdf["cls"].to_numpy(np.int64)]
            fps = np.r_[fps, pdf["fp"].to_numpy(np.int64)]
            if len(cls) >= rows and cls[0] != cls[-1]:
                cut = np.searchsorted(cls, cls[-1])  # the last class may go on in the next batch
                yield solve(cls[:cut], fps[:cut])
                cls, fps = cls[cut:], fps[cut:]
        if len(cls):
            yield solve(cls, fps)

    return run


def near_links(fps: DataFrame, radius: int, max_class: int = MAX_CLASS) -> DataFrame:
    """Spanning forests (src, dst) that connect all distinct fingerprints (column fp) within `radius` bits."""
    pieces, depth = [], 0
    level = fps.select("fp", F.lit(0).cast("long").alias("cls"), F.lit(0).cast("long").alias("used"))
    while True:
        # `used` marks the bits that define a row's class; the free bits are cut into radius+1 blocks.
        keys = F.array(*[F.struct(_signed(u).alias("was"), _signed(m).alias("bits"), _signed(u | m).alias("now"))
                         for u in _used_masks(depth, radius) for m in _next_masks(u, radius)])
        dealt = (level.withColumn("k", F.explode(F.filter(keys, lambda k: k["was"] == F.col("used"))))
                 .select("fp", F.xxhash64("cls", "k.bits", F.col("fp").bitwiseAND(F.col("k.bits"))).alias("cls"), F.col("k.now").alias("used")))
        dealt = materialise(dealt, "simhash-keys")
        depth += 1
        big = materialise(dealt.groupBy("cls").count().where(F.col("count") > max_class).select("cls"), "simhash-big")
        last = depth >= MAX_DEPTH or big.isEmpty()
        pieces.append(dealt if last else dealt.join(big, "cls", "left_anti"))
        if last:
            break
        level = dealt.join(big, "cls", "left_semi")
    run = _tree_links(radius)
    out = None
    for p in pieces:
        links = p.select("cls", "fp").repartition("cls").sortWithinPartitions("cls").mapInPandas(run, "src long, dst long")
        out = links if out is None else out.unionByName(links)
    return out


def _signed(m: int):
    return F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")


def _used_masks(depth: int, radius: int) -> list[int]:
    used = {0}
    for _ in range(depth):
        used = {u | m for u in used for m in _next_masks(u, radius)}
    return sorted(used)


def _next_masks(used: int, radius: int) -> list[int]:
    free = [i for i in range(64) if not used >> i & 1]
    return [sum(1 << free[i] for i in range(a, b)) for a, b in _blocks(0, len(free), radius + 1)]


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most `radius` bits."""
    return _groups(df, id_col, text_col, shingle, radius)[0].drop("root")


def _groups(df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp, component, root) of all rows, and (fp, component, root) of all fingerprints; components whose
    smallest ids are the same (of texts that share an id) differ in their roots."""
    docs = materialise(simhash_fingerprints(df, id_col, text_col, shingle), "simhash-docs")
    nodes = materialise(docs.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    roots = connected_components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = materialise(rooted.join(lows, "root").select("fp", "component", "root"), "simhash-named")
    return docs.join(named, "fp", "left").select("id", "fp", "component", "root"), named


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Of each group the row of the smallest id (of rows that share it the first by its columns).

    Rows with a null id can't be told apart by id and stay as they are.
    """
    key, (gone_,) = F.col(f"`{id_col}`"), free_names(df.columns, "id")
    groups, named = _groups(df, id_col, text_col, shingle, radius)
    groups = materialise(groups.drop("root"), "simhash-groups")
    gone = groups.where("id <> component").select(F.col("id").alias(gone_)).distinct()
    again = groups.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(gone_))
    if again.isEmpty():  # else the texts would be dealt out twice for nothing
        return df.join(gone, key == F.col(gone_), "left_anti")
    once = df.join(gone.unionByName(again).distinct(), key == F.col(gone_), "left_anti")
    # Rows that share an id can be in several groups: each is found by its own fingerprint.
    repeated = df.join(again, key == F.col(gone_), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    packed = repeated.select(row, key.cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = add_column(packed, "fp", T.LongType(), "text", _fingerprints(shingle), keep=["row", "id"])
    least = marked.join(named, "fp").where(F.col("id") == F.col("component"))
    first = least.groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    return once.unionByName(first)
