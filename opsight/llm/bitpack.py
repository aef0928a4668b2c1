"""Token ids in fixed-width bit-packed files.

An id takes the least number of bits that holds the vocabulary. A file holds the documents of one range of ids in
order: blocks of 4096 packed ids, then a footer with the block offsets and, for each document, its id, first
token and count, so that numpy unpacks whole runs of blocks at once and any document can be read alone.

Layout (little-endian): b"OPSIGHT1", blocks, footer, then 6 unsigned 64-bit numbers: footer offset, bits,
ids in a block, blocks, documents, ids. The footer holds block offsets (u64), doc ids (i64),
null flags of the doc ids (u8), first tokens (u64), counts (u64).

Edge cases: null and empty texts hold the end id alone; null doc ids come first; repeated rows are documents of
their own, ordered by text; an empty table writes no file and reads back no row.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _Csr, _Index, read_file
from .common import materialise, spread
from .files import TaskFile, open_input, read_range

MAGIC = b"OPSIGHT1"
BLOCK = 4096
RUN = 256  # blocks that are read and unpacked at once
MAX_PIECES = 800_000  # cached distinct pieces of a worker; the cache starts anew beyond
SLICE = 1000  # documents that a worker encodes at once


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Most significant bit first, without gaps; the last byte is filled with zeros."""
    cells = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return cells[:, 4 - bits // 8:].tobytes()
    return np.packbits(np.unpackbits(cells, axis=1)[:, 32 - bits:]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        cells = np.zeros((n, 4), np.uint8)
        cells[:, 4 - bits // 8:] = np.frombuffer(data, np.uint8)[:n * bits // 8].reshape(n, bits // 8)
        return cells.view(">u4").ravel().astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    cells = np.zeros((n, 32), np.uint8)
    cells[:, 32 - bits:] = flat
    return np.packbits(cells, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """Streams documents into one file."""

    def __init__(self, folder: str, stem: str, bits: int, block: int = BLOCK):
        self.file, self.bits, self.block = TaskFile(folder, stem, ".ids"), bits, block
        self.file.write(MAGIC)
        self.offsets, self.docs, self.nulls, self.counts = [], [], [], []
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.block * RUN:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for i in range(0, n, self.block * RUN):
            run = ids[i:min(i + self.block * RUN, n)]
            whole = len(run) // self.block * self.block
            for part in ([run[:whole]] if self.block * self.bits % 8 == 0 else [run[j:j + self.block] for j in range(0, whole, self.block)]):
                if len(part):
                    at, each = self.file.write(pack(part, self.bits)), (self.block * self.bits + 7) // 8
                    self.offsets += [at + each * j for j in range(len(part) // self.block)]
            if whole < len(run):
                self.offsets.append(self.file.write(pack(run[whole:], self.bits)))
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> str:
        self._flush(self.n_held)
        counts = np.array(self.counts, np.uint64)
        firsts = np.r_[np.uint64(0), np.cumsum(counts)[:-1]].astype(np.uint64)
        footer = self.file.size
        for a, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (firsts, "<u8"), (counts, "<u8")):
            self.file.write(np.array(a, kind).tobytes())
        self.file.write(np.array([footer, self.bits, self.block, len(self.offsets), len(self.docs), self.n], "<u8").tobytes())
        return self.file.close()


class TokenFile:
    """Random access to a file of packed ids."""

    def __init__(self, uri: str):
        self.handle = open_input(uri)
        size = self.handle.size()
        footer, self.bits, self.block, blocks, docs, self.n_ids = (int(x) for x in np.frombuffer(read_range(self.handle, size - 48, 48), "<u8"))
        if read_range(self.handle, 0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        data = read_range(self.handle, footer, size - 48 - footer)
        cut = np.cumsum([0, 8 * blocks, 8 * docs, docs, 8 * docs, 8 * docs])
        self.offsets, self.docs, nulls, self.firsts, self.counts = (
            np.frombuffer(data[a:b], kind) for a, b, kind in zip(cut, cut[1:], ("<u8", "<i8", "u1", "<u8", "<u8")))
        self.nulls = nulls.astype(bool)
        self.end = footer

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file: the blocks that hold them are read at once and unpacked together."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        begin, end = int(self.offsets[a]), int(self.offsets[b]) if b < len(self.offsets) else self.end
        data, n = read_range(self.handle, begin, end - begin), min(b * self.block, self.n_ids) - a * self.block
        if self.block * self.bits % 8 == 0:
            ids = unpack(data, n, self.bits)
        else:
            each = (self.block * self.bits + 7) // 8
            ids = np.concatenate([unpack(data[each * j:each * (j + 1)], min(self.block, n - self.block * j), self.bits) for j in range(b - a)])
        return ids[start - a * self.block:stop - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.slice(int(self.firsts[i]), int(self.firsts[i] + self.counts[i]))

    def runs(self, ids: int = BLOCK * RUN):
        """(first document, last + 1, their ids): consecutive documents of about so many ids together."""
        ends = (self.firsts + self.counts).astype(np.int64)
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, int(self.firsts[i]) + ids, side="right")))
            yield i, j, self.slice(int(self.firsts[i]), int(ends[j - 1]))
            i = j


class PieceEncoder:
    """A tokenizers-library tokenizer whose ids don't cross blanks: distinct pieces between blanks are encoded once.

    Holds for tokenizers that turn white space into a separator that is dropped, such as a Split with the
    white space removed; `whole` encodes a text as one piece and serves to check that.
    """

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self._reset()

    def _reset(self):
        self.pieces, self.ids = _Index(), _Csr()
        self.stems, self.stem_ids = _Index(), _Csr()

    def _parts(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """(stems of the pieces in turn, number of stems of each): lower case where it is ASCII, and a comma or full stop after
        an ASCII letter or digit apart.

        A piece that may hold an added token, which the library looks for before lower case, is a stem as it is."""
        low = "\n".join(pieces).lower()  # no piece holds a line feed
        watch = any(t in low for t in self.added)
        stems, flat, counts = self.stems, [], []
        for piece, lowered in zip(pieces, low.split("\n")):
            if watch and any(t in lowered for t in self.added):
                flat.append(stems[piece])
                counts.append(1)
                continue
            if piece.isascii():
                piece = lowered
            if piece.endswith((",", ".")) and piece[-2:-1].isalnum() and piece[-2:-1].isascii():
                flat += stems[piece[:-1]], stems[piece[-1]]
                counts.append(2)
            else:
                flat.append(stems[piece])
                counts.append(1)
        return flat, counts

    def _learn(self, group: int = 2048) -> None:
        if not self.pieces.fresh:
            return
        parts, counts = self._parts(self.pieces.fresh)
        self.pieces.fresh = []
        fresh, self.stems.fresh = self.stems.fresh, []
        flat, lens = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(fresh), group):
            part = fresh[i:i + group]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.int32))
            lens.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        self.stem_ids.extend(np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(lens))].astype(np.int64))
        values, starts = self.stem_ids.gather(np.array(parts, np.int64))
        self.ids.extend(values, starts[np.r_[0, np.cumsum(counts)]])

    def encode(self, texts: list) -> list[np.ndarray]:
        if len(self.pieces) > MAX_PIECES:
            self._reset()
        rows = []
        for t in texts:
            parts = (t or "").replace("\n", " ").split(" ")
            rows.append(np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts)))
        self._learn()
        return [self.ids.gather(r)[0] for r in rows]


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(spec: bytes) -> PieceEncoder:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(spec)
    return _ENCODERS[key]


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts and writes them in ascending id order; (part, uri, n_docs, n_ids) of each file, in that order by part."""
    spec = df.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))  # a vocabulary: fixed size
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Equal ids (or nulls) are told apart by text and then by place, so that no range is larger than the others.
    src = src.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ranged = src.repartitionByRange("id", "h", "at").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches):
        writer = None
        part = TaskContext.get().partitionId()
        for b in batches:
            enc = piece_encoder(spec.value)
            for i in range(0, b.num_rows, SLICE):
                s = b.slice(i, SLICE)
                for doc, ids in zip(s.column(0).to_pylist(), enc.encode(s.column(1).to_pylist())):
                    writer = writer or Writer(folder, f"part-{part:06d}", max(1, (max(enc.size, end_id + 1) - 1).bit_length()))
                    writer.add(doc, np.append(ids, end_id).astype(np.uint32))
        if writer is not None:
            uri = writer.close()
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(writer.docs)], "n_ids": [writer.n]},
                                             schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return materialise(ranged.mapInArrow(run, "part int, uri string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the files alone."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = spread(files.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("uri", "file_start"), "uri")

    def run(batches):
        for pdf in batches:
            for uri, start in zip(pdf["uri"], pdf["file_start"]):
                f = TokenFile(uri)
                for i, j, ids in f.runs():
                    first = f.firsts[i:j].astype(np.int64)
                    counts = f.counts[i:j].astype(np.int64)
                    raw = ids.astype("<u4").tobytes()
                    at = (first - first[0]) * 4
                    crc = [zlib.crc32(raw[a:a + 4 * n]) for a, n in zip(at.tolist(), counts.tolist())]
                    docs = pd.array(f.docs[i:j].astype(np.int64), dtype="Int64")
                    docs[f.nulls[i:j]] = pd.NA
                    yield pd.DataFrame({"doc_id": docs, "start": first + start, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)})

    return placed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
