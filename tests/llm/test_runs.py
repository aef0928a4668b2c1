"""Periodic runs against a brute-force search of every period."""

import hashlib
import random
import zlib

import pytest

from opsight.llm import queries as Q
from opsight.llm.common import table
from opsight.llm.runs import periodic_runs, z_function

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """(start, length, period): longest matching stretches of every period; a stretch keeps its smallest period."""
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), best[0], best[1], best[2], milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapse(words, runs)))


def texts():
    r = random.Random(3)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a\u00a0a a\u00a0a", "x " * 3000, "a b b " * 700 + "a b"]
    for i in range(120):
        n = r.randrange(1, 160)
        out.append(" ".join(r.choice("ab" if i % 2 else "abc") for _ in range(n)))
    for _ in range(60):
        words = []
        while len(words) < r.randrange(50, 900):
            q = r.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64])
            unit = [r.choice("abcd") + str(r.randrange(3)) for _ in range(q)]
            words += (unit * 12)[: q * r.randrange(2, 11) + r.randrange(q)]
            words += [r.choice("abcd") for _ in range(r.randrange(4))]
        out.append("\n".join(words))
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join((fib[9] * 7)), "y " * 40000]


def test_runs_and_collapsed_texts(spark):
    given = texts()
    rows = [(i, t, "k") for i, t in enumerate(given)]
    got = periodic_runs(spark.createDataFrame(rows, "text_ long, body string, tiles string").withColumnRenamed("text_", "key"), ["key", "tiles"], "body").collect()
    assert sorted(r["key"] for r in got) == list(range(len(given))) and {r["tiles"] for r in got} == {"k"}
    for r in got:
        words = [w.decode() for w in (given[r["key"]] or "").encode().split()]
        want = [(0, 40000, 1)] if r["key"] == len(given) - 1 else plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want, given[r["key"]][:200]
        assert (sha(r["collapsed"]) if want else r["whole"]) == sha(plain_collapse(words, want)) and r["n_words"] == len(words)
        assert r["dropped_words"] == len(words) - len(plain_collapse(words, want).encode().split())


def test_query_against_every_period(spark):
    given = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = Q.QUERIES["op13_scale_tiled_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(plain_row(r["doc_id"], r["text"]) for r in given)
    assert sorted(tuple(r) for r in got.collect()) == want and sum(w[1] > 0 for w in want) > 5


def test_nulls_repeated_ids_and_an_empty_table(spark, tmp_path):
    docs = [(None, "a a a a a a a"), (5, None), (5, "b c"), (5, "b c"), (7, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op13_scale_tiled_runs"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_runs"], r["length"] or 0) for r in got) == [(0, 1, 7), (5, 0, 0), (5, 0, 0), (5, 0, 0), (7, 0, 0)]
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert Q.QUERIES["op13_scale_tiled_runs"](spark, str(tmp_path / "none")).collect() == []


def test_z_function():
    for s in ("aaaaaa", "abcabcab", "abacaba"):
        z = z_function(list(s), len(s))
        assert all(z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s)))


def test_fewer_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([("a",)], "text string"), [], times=3)
