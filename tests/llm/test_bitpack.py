import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opsight.llm import bitpack as B
from opsight.llm import queries as Q

from .test_bpe import TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 15, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = B.pack(ids, bits)
        assert len(data) == (n * bits + 7) // 8
        assert (B.unpack(data, n, bits) == ids).all()


@pytest.mark.parametrize("bits,block", [(16, 8), (5, 7), (13, 64), (9, 4096)])
def test_file_random_access(tmp_path, bits, block):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 3, 100, 1, 2000, 0, 5, 8, 5000)]
    w = B.Writer(f"file://{tmp_path}/x", "p", bits, block)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i * 10, d)
    f = B.TokenFile(w.close())
    assert f.nulls.tolist() == [True] + [False] * 8 and f.docs[1:].tolist() == [10 * i for i in range(1, 9)]
    for i in (8, 0, 4, 2, 5):
        assert (f.doc(i) == docs[i]).all() and len(f.doc(i)) == len(docs[i])
    flat = np.concatenate(docs)
    assert (f.slice(99, 1999) == flat[99:1999]).all() and (np.concatenate([ids for *_, ids in f.runs(300)]) == flat).all()


def test_pieces_equal_whole_texts(library):
    enc = B.PieceEncoder(open(PATH, "rb").read())
    for t, ids in zip(TEXTS, enc.encode(TEXTS)):
        assert ids.tolist() == library(t), t[:60]


def expected(rows, library):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_against_the_library(spark, library, tmp_path):
    rows = [(7 * i % 19, t) for i, t in enumerate(TEXTS)] + [(None, None), (100, None), (101, "same"), (101, "same")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, id string, at int").repartition(5)
    got = [tuple(r) for r in B.read_token_files(B.write_token_files(df, str(tmp_path), PATH, 2)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == expected(rows, library)
    assert B.read_token_files(B.write_token_files(df.limit(0), str(tmp_path), PATH, 2)).collect() == []


def test_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in Q.QUERIES["op6_bit_packed_ids"](spark, SF).collect())
    assert got == expected(rows, library)


def test_added_tokens_as_the_library_finds_them():
    plain = Tokenizer.from_file(PATH)
    texts = ["foo <|endoftext|> bar", "<|startoftext|>", "a<|endoftext|>b, c", "x <|ENDOFTEXT|> <|endoftext|>. y", "Foo<|StartOfText|>,", "<|endoftext|><|endoftext|> É<|endoftext|>É", "<|endof text|>", "end\n<|endoftext|>\nof"]
    enc = B.PieceEncoder(open(PATH, "rb").read())
    assert enc.encode(texts[:1])[0].tolist() == [23435, 49407, 2411]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_whole_bytes_are_packed_without_spreading_their_bits(bits):
    """Most significant byte first, as the bits would lie, and a few bytes of memory an id."""
    import tracemalloc

    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 100_000, dtype=np.uint64).astype(np.uint32)
    tracemalloc.start()
    data = B.pack(ids, bits)
    back = B.unpack(data, len(ids), bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data == b"".join(int(x).to_bytes(bits // 8, "big") for x in ids)
    assert back.dtype == np.uint32 and (back == ids).all()
    assert peak < 20 * len(ids)
