import random
import zlib

import numpy as np
from opsight.llm import queries as Q
from opsight.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def area_under_curve(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    y = np.array(labels, bool)
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_learns_what_no_linear_model_can():
    """Toxic exactly if an insult and a group mention meet."""
    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(words, 4) + ["insult"] * a + ["group"] * b))
        labels.append(int(a == b))
    rows = X.Terms(14).of(texts)
    m = X.fit(rows[:1200], np.array(labels[:1200]), bits=14, factors=4, epochs=40)
    assert area_under_curve(m.scores(rows[1200:]), labels[1200:]) > 0.95
    m.v = np.zeros_like(m.v)
    assert area_under_curve(m.scores(rows[1200:]), labels[1200:]) < 0.8


def rare_pairs(n, seed, both, alone):
    """(text, toxic, a, b): a word on 2 % of the rows, another on 2 %, on 1 % together; the other rows by the plain word `vile`."""
    rng = random.Random(seed)
    words, out = [f"w{i}" for i in range(300)], []
    for _ in range(n):
        u = rng.random()
        a, b = u < 0.02, 0.01 <= u < 0.03
        toxic = both if a and b else alone if a or b else int(both and rng.random() < 0.5)
        out.append((" ".join(rng.sample(words, 12) + ["insult"] * a + ["group"] * b + ["vile"] * (toxic and not (a or b))), toxic, a, b))
    return out


def test_learns_pairs_of_rare_words():
    """Insult and group are on 2 % of the rows: toxic only together (each tells nothing alone), or only apart (no linear model learns that)."""
    for both, alone in ((1, 0), (0, 1)):
        train, test = rare_pairs(4000, 0, both, alone), [r for r in rare_pairs(4000, 1, both, alone) if r[2] or r[3]]
        m = X.fit(X.Terms(X.BITS).of([t for t, *_ in train]), np.array([y for _, y, *_ in train]))
        rows, labels = X.Terms(X.BITS).of([t for t, *_ in test]), np.array([y for _, y, *_ in test])
        assert area_under_curve(m.scores(rows), labels) > 0.95
        m.v = np.zeros_like(m.v)
        assert area_under_curve(m.scores(rows), labels) < 0.8


def test_telling_pair_in_a_long_neutral_text():
    train = rare_pairs(4000, 0, 0, 1)
    m = X.fit(X.Terms(X.BITS).of([t for t, *_ in train]), np.array([y for _, y, *_ in train]))
    for more in (0, 50, 300):
        pad = " ".join(f"w{i}" for i in range(more))
        scores = m.scores(X.Terms(X.BITS).of([f"{pad} insult", f"{pad} group", f"{pad} insult group", pad]))
        assert (scores >= 0.5).tolist() == [True, True, False, False], more


def test_distinct_terms_share_no_place():
    words = [f"{i:06d}x" for i in range(280_000)]
    places = X.Terms(X.BITS).of([" ".join(words)])[0]
    assert len(places) == len(words) + len({w[:X.PREFIX] for w in words})


def test_query_on_held_out_rows(spark):
    got = Q.QUERIES["op9_toxicity_factorization_machine"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert area_under_curve([h[0] for h in held], [h[1] for h in held]) > 0.95
    assert np.mean([h[1] == h[2] for h in held]) > 0.95


def test_edge_rows(spark):
    docs = [(i, ("vile " if i % 2 else "fine ") + f"text {i}") for i in range(200)] + [(300, None), (301, ""), (None, "vile text"), (302, "..."), (302, "vile " * 50_000)]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, score string, toxic double")
    labels = spark.createDataFrame([(i, 1, i % 2, 5) for i in range(200)] + [(0, 1, 0, 5), (5, 0, None, 5), (7, 0, 3, 5), (None, 0, 1, 5), (999, 0, 1, 5)], "doc_id long, quality int, toxic int, text int")
    out = X.toxicity_scores(df, labels)
    assert out.columns == ["doc_id", "text", "toxic", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(docs)
    assert all((r.predicted == 1) == ("vile" in r.text) for r in rows if r.text and "text" in r.text)
    assert len({r.score for r in rows if not r.text or r.text == "..."}) == 1
    kept = X.drop_toxic(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200} == set(range(0, 200, 2))
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in X.toxicity_scores(df, none).collect()} <= {0, 1}
    assert X.toxicity_scores(df.limit(0), labels).collect() == []
