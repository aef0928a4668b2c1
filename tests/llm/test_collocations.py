"""Collocations against a count of every phrase."""

import random
import re
from collections import Counter

from opsight.llm import queries as Q
from opsight.llm.collocations import collocations, phrase_levels, with_text
from opsight.plans.check import duck, rows_of_duck, rows_of_spark

SCHEMA = "doc_id long, text string, lang string, source string, l long, word string, n long, id long"


def plain(rows, max_words=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, w[i:i + k]) for (lang, w), a in cand.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= inside * f[lang, w[i:i + k]]}
    out = []
    for lang in n:
        best = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                score, _, left, right = min((10**6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "w", 2, 3) for i, (t, g) in enumerate(rows)], SCHEMA)


def rows_at_random(seed, docs=120):
    r = random.Random(seed)
    words = ["New", "york", "city", "é", "ﬁn", "a\u00a0b", "z"] + [f"w{i}" for i in range(12)]
    out = [(None, "en"), ("", None), (" ., ;\t", "en"), ("x y " * 4000, "xx"), ("same same " * 30, None), ("Same same", "und")]
    for _ in range(docs):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(r.randrange(60)))
        out.append((t + (" new York City " * r.randrange(3)), r.choice(["en", "de", None])))
    return out + out[10:30]


def test_against_counts_of_every_phrase(spark):
    rows = rows_at_random(1)
    for kw in ({}, {"max_words": 4, "least": 3, "inside": 80, "top": 25}, {"max_words": 2, "least": 1}):
        got = sorted(tuple(r) for r in collocations(table_of(spark, rows), **kw).collect())
        assert got == plain(rows, **kw) and got


def test_blocks_cut_between_and_inside_pieces(spark):
    rows = rows_at_random(2)
    for kw in ({}, {"max_words": 4, "least": 3}):
        got = collocations(table_of(spark, rows), block_words=40, **kw).collect()
        assert sorted(tuple(r) for r in got) == plain(rows, **kw)


def test_levels_hold_the_frequent_phrases(spark):
    levels, totals = phrase_levels(table_of(spark, [("a b c. a b d", "en")] * 10))
    assert sorted((r["word"], r["f"]) for r in levels[0].collect()) == [("a", 20), ("b", 20), ("c", 10), ("d", 10)]
    assert [sorted((r["phrase"], r["f"]) for r in with_text(x, levels[0]).collect()) for x in levels[1:]] == [
        [("a b", 20), ("b c", 10), ("b d", 10)], [("a b c", 10), ("a b d", 10)]]
    assert [tuple(r) for r in totals.collect()] == [("en", 60)]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from opsight.llm.collocations import _score

    given = [(10**13, 3 * 10**13, 10**13 + 7), (2**40 + 1, 2**41 + 3, 2**40 + 9), (10, 10, 10)]
    got = spark.createDataFrame(given, "a long, l long, r long").select(_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (x * y) for a, x, y in given]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    cols, got = rows_of_spark(Q.QUERIES["op11_setm_collocations"](spark, sf))
    want_cols, want = rows_of_duck(duck(sf), Q.ORACLES["op11_setm_collocations"])
    assert cols == want_cols and sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 100


def test_empty_table(spark):
    assert collocations(table_of(spark, [])).collect() == []
    assert collocations(table_of(spark, [(None, None)])).collect() == []
