"""Periodic runs of words by scale-tiled distribution.

A run is a longest stretch of words with smallest period q, at least `least` words and `times` periods long. Octave k looks for the
periods 2^k to 2^(k+1) - 1 around boundaries 2^k words apart. Where a run has period q, the words that match the word q
later form an interval of 3q words and more (for four periods), so some boundary has 2^(k+1) matching words after it. Each
boundary's tile, from 2^k words before it to 5 * 2^k after it, is solved alone: the Z-function of the words after the boundary
and that of the reversed words before it give, for every period of the octave, how far the match reaches within the tile.
Tiles of neighbouring boundaries overlap by more than their distance, so the fragments of one interval touch; they are
shuffled by document and period and stitched.

A tile is made only if the words after its boundary recur at a distance of its octave (compared by 64-bit hashes of stretches
of 2^k words, which never misses equal stretches; what hashes claim is checked by the Z-functions). Up to 16 neighbouring boundaries share one
row. Tiles are dealt to tasks by document, octave and place: a very long text or a text of one word is the work of many tasks. Multiples of a
smaller period are known by the Z-function and dropped within the tile.

Texts that have tiles are kept by the first pass, so the last step reads only them again; each other text has its digest by then.

Edge cases: a null or empty text has no words and no run; repeated rows are documents of their own; runs may overlap; a word in any run
beyond that run's first period goes; tables may be empty; kept columns may have any names but those of the result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encode_text, materialise

LEAST, TIMES = 6, 4
GROUP = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
TILES = "array<struct<octave: int, first: long, at: array<int>, words: binary>>"


def word_codes(words: list[bytes]) -> np.ndarray:
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def boundaries(codes: np.ndarray, times: int = TIMES):
    """(octave, boundaries with a candidate period) for every octave that a text of this length has.

    Candidates that are multiples of a shorter distance at which the same words recur (compared word by word) aren't smallest periods.
    """
    n, k = len(codes), 0
    h = _scramble(codes.astype(np.uint64) + np.uint64(1))  # of stretches of 2^k words from each place
    while times << k <= n:
        s = 1 << k
        twice = _scramble(h[:-s] * np.uint64(3) + h[s:])  # of 2^(k+1) words
        at = np.arange(0, len(twice) - s, s)
        padded = np.concatenate([twice, np.zeros(s, np.uint64)])
        same = np.lib.stride_tricks.sliding_window_view(padded, 2 * s)[at] == twice[at, None]
        hit = same[:, s:].any(axis=1)
        for i in np.flatnonzero(hit):
            b, p = int(at[i]), int(same[i, 1:].argmax()) + 1
            if p < s and not ((np.flatnonzero(same[i, s:]) + s) % p).any():
                hit[i] = not np.array_equal(codes[b:b + 2 * s], codes[b + p:b + p + 2 * s])
        if hit.any():
            yield k, at[hit]
        h, k = twice, k + 1


def tiles(codes: np.ndarray, times: int = TIMES) -> list[dict]:
    out = []
    for k, at in boundaries(codes, times):
        s = 1 << k
        for part in np.split(at, np.flatnonzero(np.diff(at) > s) + 1):
            for i in range(0, len(part), GROUP):
                g = part[i:i + GROUP]
                lo, hi = max(0, int(g[0]) - s), min(len(codes), int(g[-1]) + 5 * s)
                out.append({"octave": k, "first": lo, "at": (g - lo).astype(np.int32).tolist(), "words": codes[lo:hi].tobytes()})
    return out


def z_function(s: list[int], most: int) -> list[int]:
    """Z[i] for 0 < i <= most: how many words from i on equal those at the beginning."""
    n = len(s)
    z = [0] * (min(most, n - 1) + 1)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve(codes: list[int], b: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the matching intervals around boundary b within its tile, for smallest periods of the octave."""
    s = 1 << octave
    after = codes[b:b + 5 * s]
    z = z_function(after, 2 * s - 1)
    found = [q for q in range(s, min(2 * s, len(z))) if z[q] >= 2 * s and not _repeats(z, q)]
    if not found:
        return []
    before = codes[max(0, b - s):b]
    before.reverse()
    upto = codes[max(0, b - s):b + 2 * s - 1]
    upto.reverse()
    back = z_function([*before, -1, *upto], len(before) + len(upto))
    # upto[0] is the word at b + 2s - 2, so the word at b + q - 1 is upto[2s - 1 - q]
    return [(q, b - back[len(before) + 1 + 2 * s - 1 - q] if before else b, b + min(z[q], 3 * s)) for q in found]


def _repeats(z: list[int], q: int) -> bool:
    """Whether the first q words are a shorter stretch repeated."""
    left, p = q, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            if z[q // p] >= q - q // p:
                return True
            while left % p == 0:
                left //= p
        p += 1
    return False


_TILE = pa.list_(pa.struct([("octave", pa.int32()), ("first", pa.int64()), ("at", pa.list_(pa.int32())), ("words", pa.binary())]))


def _first_pass(times: int, rows: int = 100):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                n, digest, texts, found = [], [], [], []
                for text in b.column(b.num_columns - 1).to_pylist():
                    words = encode_text(text).split()
                    joined = b" ".join(words)
                    found.append(tiles(word_codes(words), times))
                    texts.append(joined.decode("utf-8", "surrogatepass") if found[-1] else None)
                    n.append(len(words))
                    digest.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string()), pa.array(found, _TILE)],
                    names=[*b.schema.names[:-1], "n_words", "whole", "text", "tiles"])

    return run


def _solve(batches):
    for b in batches:
        out = []
        for key, octave, first, at, words in zip(*(c.to_pylist() for c in b.columns)):
            codes = np.frombuffer(words, np.int32).tolist()
            open_: dict[int, list[int]] = {}
            for i in at:
                for q, lo, hi in solve(codes, i, octave):
                    if q in open_ and open_[q][1] >= lo:
                        open_[q][1] = max(open_[q][1], hi)
                    else:
                        if q in open_:
                            out.append((key, q, first + open_[q][0], first + open_[q][1]))
                        open_[q] = [lo, hi]
            out.extend((key, q, first + lo, first + hi) for q, (lo, hi) in open_.items())
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "period", "lo", "hi"])


def stitch(fragments: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, period, start, length) of runs: touching fragments of a document and period are one matching interval."""
    order = Window.partitionBy("key", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = fragments.withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    isle = new.withColumn("isle", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = isle.groupBy("key", "period", "isle").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    return (whole.select("key", "period", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"))
            .where(F.col("length") >= F.greatest(F.lit(least), times * F.col("period"))))


def _collapse(batches):
    """Rows (..., runs, text) -> (..., runs, collapsed, dropped_words); collapsed is null where nothing goes."""
    for b in batches:
        found = [runs or [] for runs in b.column("runs").to_pylist()]
        texts, dropped = [], []
        for text, runs in zip(b.column("text").to_pylist(), found):
            words = encode_text(text).split()
            cut = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                cut[r["start"] + r["period"]] += 1
                cut[r["start"] + r["length"]] -= 1
            kept = (np.cumsum(cut[:-1]) == 0).tolist()
            texts.append(b" ".join(itertools.compress(words, kept)).decode("utf-8", "surrogatepass") if runs else None)
            dropped.append(len(words) - sum(kept))
        cols = [c for n, c in zip(b.schema.names, b.columns) if n not in ("runs", "text")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, _RUNS), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())],
                                         names=[*(n for n in b.schema.names if n not in ("runs", "text")), "runs", "collapsed", "dropped_words"])


def periodic_runs(df: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns in `keep`, n_words, runs (array of start, length, period by start and period), collapsed (the text without
    repeated periods, words joined by one space; null where nothing goes), whole (SHA-256 of all words so joined), dropped_words."""
    if times < 4:
        raise ValueError("tiles are wide enough for runs of four periods and more")
    fields = {f.name: f for f in df.schema.fields}
    own = [f"c{i}" for i in range(len(keep))]  # names of the tasks' own, whatever the kept columns are called
    out = T.StructType([T.StructField(o, fields[c].dataType) for o, c in zip(own, keep)]
                       + [T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()), T.StructField("text", T.StringType()),
                          T.StructField("tiles", T.DataType.fromDDL(TILES))])
    sent = df.select(*[F.col(f"`{c}`").alias(o) for o, c in zip(own, keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = materialise(sent.mapInArrow(_first_pass(times), out).withColumn("key", F.monotonically_increasing_id()), "runs-tiles")
    dealt = docs.select("key", F.explode("tiles").alias("t")).select("key", "t.octave", "t.first", "t.at", "t.words")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fragments = dealt.repartition(n, "key", "octave", "first").mapInArrow(_solve, "key long, period long, lo long, hi long")
    runs = stitch(fragments, least, times)
    by_doc = materialise(runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs")), "runs-found")
    # Only texts with tiles are read again; the merge hint because the runs grow with the corpus at any size.
    suspects = docs.where("text is not null").drop("tiles").hint("merge").join(by_doc, "key", "left")
    sent = [*own, "n_words", "whole"]
    done = T.StructType([f for f in out.fields if f.name in sent] + [T.StructField("runs", T.DataType.fromDDL(RUNS)), T.StructField("collapsed", T.StringType()),
                                                                     T.StructField("dropped_words", T.LongType())])
    searched = suspects.select(*sent, "runs", "text").mapInArrow(_collapse, done)
    plain = docs.where("text is null").select(*sent, F.array().cast(RUNS).alias("runs"), F.lit(None).cast("string").alias("collapsed"), F.lit(0).cast("long").alias("dropped_words"))
    rows = searched.unionByName(plain)
    return rows.select(*[F.col(o).alias(c) for o, c in zip(own, keep)], "n_words", "runs", "collapsed", "whole", "dropped_words")
