import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from opsight.llm import bpe
from opsight.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return bpe.merge_table(bpe.read_file(PATH))


@pytest.fixture(scope="module")
def library(table):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ids, special_tokens={})


TEXTS = ["", " ", "  ", "a", "hello world", " lead", "trail ", "two  blanks", "tab\tand\nline\n\nbreaks \n", "it's we'll they've 'tis", "x1y2 3.14 £5",
         "ééé ñandú Straße 東京 \U0001f600\U0001f600", "a" * 5000, " " * 3000, "ab" * 2000 + "!" * 500, "nb sp em\x1cfs\x85nel", "́comb́", "\n lead", "\x00\x01"]


def test_replay_equals_the_library(table, library):
    rng = random.Random(0)
    alphabet = "aabbcdeeilnorstu é ß'.1"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([32, 10, 9, 97, 101, 116, 233, 0x3b1, 0x4e00, 39, 46, 49])) for _ in range(rng.randrange(50))) for _ in range(400)]
    enc = bpe.Encoder(bpe.read_file(PATH), public_tokenizers.PATTERN)
    for part in (texts[:300], texts[300:]):
        ids, starts = enc.encode(part)
        for t, a, b in zip(part, starts, starts[1:]):
            assert ids[a:b].tolist() == library.encode_ordinary(t), t[:80]


def test_replay_of_single_words(table):
    plain = ["lower", "newest", "aaaaaaa", "  ", "tionheit", "ééé"]
    ids, starts = bpe.replay([w.encode() for w in plain], table)
    token = {i: t for t, i in table.ids.items()}
    for w, a, b in zip(plain, starts, starts[1:]):
        assert b"".join(token[i] for i in ids[a:b]) == w.encode()
        assert len(ids[a:b]) < len(w.encode()) or w in ("  ",)
    assert bpe.replay([], table)[0].tolist() == []


def test_columns_and_edges(spark, library):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "a", None), (3, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.bpe_encode(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.bpe_decode(nulls, PATH).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.bpe_decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), PATH).collect()


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = Q.QUERIES["op3_bpe_merge_replay"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
