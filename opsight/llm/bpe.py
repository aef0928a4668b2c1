"""Byte-level BPE by merge replay over the vocabulary of a corpus.

Each task gathers the distinct words of its part of the corpus and replays the merges on all of them at once: an
inverted index from token pair (by its rank) to word positions gives, in rank order, the places of
each merge; only the touched neighbours are looked up again. Texts are then put together from the words' ids.
Decoding joins the bytes of the ids. The rank file is read on the driver (its size is that of the
vocabulary) and sent to the executors, so they need no copy of it.

Edge cases: a null or empty text has no ids and decodes to no bytes; null ids decode to no bytes; an id
outside the vocabulary raises; whole texts are encoded whatever their length; other columns are kept; an input
column named like the output is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, encode_text

NONE = np.int32(2**31 - 1)  # rank of a pair that doesn't merge
MAX_UNITS = 150_000  # cached distinct units of a task; the cache starts anew beyond
CHUNK = 6_000_000  # characters of text whose words are replayed together
ROWS = 1500  # documents that a task encodes at once


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}


class Tokens:
    """Bytes of each id; what decoding needs."""

    def __init__(self, rank_file: bytes):
        ids = ranks_of(rank_file)
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = token
        self.known = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes)) > 0


class MergeTable:
    """Ranks of a vocabulary: id by token bytes, and the rank of every pair of tokens that merges."""

    def __init__(self, rank_file: bytes):
        self.ids = ranks_of(rank_file)
        self.size = max(self.ids.values()) + 1
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        codes, ranks = [], []
        late = np.zeros(self.size, bool)  # tokens that can be part of a pair of lower rank than their own
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    codes.append(a * self.size + b)
                    ranks.append(rank)
                    late[a] |= a > rank
                    late[b] |= b > rank
        order = np.argsort(codes)
        self.codes = np.append(np.array(codes, np.int64)[order], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[order], NONE)
        self.late = late

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ranks[at], NONE)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in turn, start of each word and the end): every merge of the table applied in rank order."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(words) else 0
    word = np.repeat(np.arange(len(words)), lens)
    tok = table.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends[lens > 0] - 1] = -1
    prv[(ends - lens)[lens > 0]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, NONE, np.int32)  # rank of the pair that starts here
    inner = nxt >= 0
    pair[inner] = table.rank(tok[inner], tok[nxt[inner]])

    # The inverted index: positions by rank, in text order; what merges create is appended by rank.
    at = np.argsort(pair, kind="stable")
    sorted_rank = pair[at]
    first = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]) if n else np.empty(0, np.int64)
    index = {int(r): at[s:e] for r, s, e in zip(sorted_rank[first], first, np.r_[first[1:], n]) if r != NONE}
    added: dict[int, list[int]] = {}
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        r = heapq.heappop(queue)
        p = index.pop(r, None)
        more = added.pop(r, None)
        if more is not None:
            p = np.unique(np.array(more) if p is None else np.r_[p, more])
        if p is None:
            continue
        p = p[pair[p] == r]
        if not len(p):
            continue
        if len(p) > 1:
            if table.late[r]:
                # the new token may form a pair that comes first: one merge a word, then look again
                head = np.r_[True, word[p[1:]] != word[p[:-1]]]
                rest = p[~head]
                if len(rest):
                    added[r] = rest.tolist()
                    heapq.heappush(queue, r)
                p = p[head]
            elif (nxt[p[:-1]] == p[1:]).any():
                take, used = [], -1  # overlapping places: from the left
                for x, y in zip(p.tolist(), nxt[p].tolist()):
                    if x != used:
                        take.append(x)
                        used = y
                p = np.array(take)
        q = nxt[p]
        after = nxt[q]
        tok[p], nxt[p] = r, after
        alive[q], pair[q] = False, NONE
        inner = after >= 0
        prv[after[inner]] = p[inner]
        left = prv[p]
        touched = np.r_[p, left[left >= 0]]
        follow = nxt[touched]
        new = np.full(len(touched), NONE, np.int32)
        inner = follow >= 0
        new[inner] = table.rank(tok[touched[inner]], tok[follow[inner]])
        pair[touched] = new
        open_ = new != NONE
        for rank, x in zip(new[open_].tolist(), touched[open_].tolist()):
            if rank in added:
                added[rank].append(x)
            else:
                added[rank] = [x]
                if rank not in index:
                    heapq.heappush(queue, rank)
    starts = np.r_[0, np.cumsum(np.bincount(word[alive], minlength=len(words)))].astype(np.int64)
    return tok[alive], starts


class _Index(dict):
    """Number of each distinct key, in order of arrival; `fresh` lists those that came since it was last emptied."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, key):
        i = self[key] = len(self)
        self.fresh.append(key)
        return i


class _Csr:
    """Growing list of integer lists in two arrays."""

    def __init__(self):
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def extend(self, flat, starts):
        self.start = np.r_[self.start, starts[1:] + len(self.flat)]
        self.flat = np.r_[self.flat, flat]

    def gather(self, rows: np.ndarray):
        """(values of the rows in turn, start of each row and the end)."""
        low = self.start[rows]
        lens = self.start[rows + 1] - low
        starts = np.r_[0, np.cumsum(lens)]
        return self.flat[np.repeat(low - starts[:-1], lens) + np.arange(starts[-1])], starts


class Encoder:
    """Encodes texts as mergeable ranks and a split pattern say, each match of the pattern separately.

    A text whose spaces all stand alone between other characters is cut at its spaces: no match crosses such a cut, and each
    part (with its space) gives the same matches anywhere, so distinct parts are split once. Other texts are matched whole.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.table, self.pattern = merge_table(rank_file), regex.compile(pattern)
        self._reset()

    def _reset(self):
        self.words = _Index()
        self.word_ids = _Csr()
        self.units = {"lead": _Index(), "bare": _Index()}
        self.unit_ids = {"lead": _Csr(), "bare": _Csr()}
        self.odd = {"lead": np.empty(0, bool), "bare": np.empty(0, bool)}

    def _learn(self) -> None:
        """Encodes the units that arrived."""
        plans = {}
        for kind, units in self.units.items():
            space, fresh = " " if kind == "lead" else "", units.fresh
            units.fresh = []
            # Units without white space are matched in one go: between two of them a line feed is a match of its own.
            plain = np.fromiter((u.split() == [u] for u in fresh), bool, len(fresh))
            words = self.pattern.findall("".join(f"{space}{u}\n" for u, ok in zip(fresh, plain) if ok))
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            ends = np.flatnonzero(at == self.words["\n"])
            lens = np.zeros(len(fresh), np.int64)
            lens[plain] = np.diff(np.r_[-1, ends]) - 1
            odd = np.zeros(len(fresh), bool)
            others = []
            for i in np.flatnonzero(~plain).tolist():
                u = fresh[i]
                found = self.pattern.findall(space + u)
                others += [self.words[w] for w in found]
                lens[i] = len(found)
                odd[i] = not u or u[0].isspace() or u[-1].isspace()
            starts = np.r_[0, np.cumsum(lens)]
            flat = np.empty(starts[-1], np.int64)
            from_plain = np.repeat(plain, lens)
            flat[from_plain] = np.delete(at, ends)
            flat[~from_plain] = np.array(others, np.int64)
            self.odd[kind] = np.r_[self.odd[kind], odd]
            plans[kind] = (flat, starts)
        fresh = [encode_text(w) for w in self.words.fresh]
        self.words.fresh = []
        known = np.fromiter((self.table.ids.get(w, -1) for w in fresh), np.int64, len(fresh))
        hard = np.flatnonzero(known < 0)
        ids, starts = replay([fresh[i] for i in hard], self.table)
        lens = np.ones(len(fresh), np.int64)
        lens[hard] = np.diff(starts)
        at = np.r_[0, np.cumsum(lens)]
        out = np.repeat(known, lens)
        out[np.repeat(known < 0, lens)] = ids
        self.word_ids.extend(out.astype(np.int32), at)
        for kind, (flat, ends) in plans.items():
            values, starts = self.word_ids.gather(flat)
            self.unit_ids[kind].extend(values, starts[ends])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, start of each text and the end); texts are taken in chunks of bounded size."""
        parts, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK or i + 1 == len(texts):
                parts += self._encode(texts[at:i + 1])
                at, size = i + 1, 0
        starts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)).astype(np.int32), starts

    def _encode(self, texts: list) -> list[np.ndarray]:
        if len(self.units["lead"]) + len(self.units["bare"]) > MAX_UNITS:
            self._reset()
        lead, bare = self.units["lead"], self.units["bare"]
        cut = []
        for t in texts:
            if not t:
                cut.append(None)
                continue
            parts = t.split(" ")
            cut.append((bare[parts[0]], np.fromiter(map(lead.__getitem__, parts[1:]), np.int64, len(parts) - 1)))
        self._learn()
        odd = [i for i, c in enumerate(cut) if c is not None and (self.odd["bare"][c[0]] or self.odd["lead"][c[1]].any())]
        for i in odd:
            words = self.pattern.findall(texts[i])
            cut[i] = np.fromiter(map(bare.__getitem__, words), np.int64, len(words))
        self._learn()
        done = []
        for c in cut:
            if c is None:
                done.append(np.empty(0, np.int32))
            elif isinstance(c, tuple):
                head = self.unit_ids["bare"].gather(np.array([c[0]]))[0]
                done.append(np.r_[head, self.unit_ids["lead"].gather(c[1])[0]])
            else:
                done.append(self.unit_ids["bare"].gather(c)[0])
        return done


_KEPT: dict[tuple, object] = {}


def _kept(kind, rank_file: bytes, *args):
    """The worker's object for a vocabulary; kept between tasks."""
    key = (kind, hashlib.sha256(rank_file).hexdigest(), *args)
    if key not in _KEPT:
        _KEPT[key] = kind(rank_file, *args)
    return _KEPT[key]


def merge_table(rank_file: bytes) -> MergeTable:
    return _kept(MergeTable, rank_file)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df with the array of token ids of each whole text."""
    ranks = df.sparkSession.sparkContext.broadcast(read_file(rank_path))  # a vocabulary: fixed size

    def start():
        encoder = Encoder(ranks.value, pattern)

        def make(texts):
            ids, starts = encoder.encode(texts.to_pylist())
            return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))

        return make

    return add_column(df, out, T.ArrayType(T.IntegerType()), text_col, start, keep, ROWS)


def bpe_decode(df: DataFrame, rank_path: str, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with the bytes of each array of token ids."""
    ranks = df.sparkSession.sparkContext.broadcast(read_file(rank_path))

    def start():
        tokens = _kept(Tokens, ranks.value)
        return lambda ids: pa.array([b"".join(map(tokens.bytes.__getitem__, row)) for row in _lists(ids, tokens.known)], pa.binary())

    return add_column(df, out, T.BinaryType(), ids_col, start, keep)


def _lists(ids, known: np.ndarray):
    """The rows of a list array as lists of ids that have a token; null as an empty list."""
    for row in ids:
        row = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32)
        if len(row) and (row.min() < 0 or row.max() >= len(known) or not known[row].all()):
            raise ValueError("a token id is not in the vocabulary")
        yield row.tolist()


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    ids = F.col(ids_col)
    return [F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", ids.cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col(decoded_col), 256).alias("decoded_sha256")]
