import math
import random

import numpy as np

from opsight.llm import queries as Q
from opsight.llm.topk import top_inner_products


def brute(rows, queries, k, scale=64):
    def vec(r):
        if r[0] is None or not r[1] or not all(x is not None and math.isfinite(x) for x in r[1]):
            return None
        return [math.floor(x * scale) for x in r[1]]

    data = [(r[0], v) for r in rows if (v := vec(r))]
    out = []
    for q in queries:
        if (v := vec(q)) is None:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q[0] and len(w) == len(v))[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rng.gauss(0, 1) * rng.choice([0.1, 1, 1, 3])) for _ in range(20)]) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(600 + i, [0.0] * 20) for i in range(5)]
    rows += [(700, None), (701, []), (702, [float("nan")] * 20), (703, [None] * 20), (None, rows[3][1]), (704, [1.0, 2.0]), (705, [1.0, -2.0]), (7, rows[7][1])]
    qs = [r for r in rows if r[0] is not None and r[0] % 7 == 0]
    schema = "vec_id long, embedding array<float>, score string, dim int"
    make = lambda x: spark.createDataFrame([(*r, "clash", 3) for r in x], schema)
    for sizes in ({"block": 32, "query_block": 8}, {}):
        got = top_inner_products(make(rows), make(qs), k=10, head=4, **sizes).collect()
        assert sorted(map(tuple, got)) == brute(rows, qs, 10)
    assert top_inner_products(make([]), make([]), k=10).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = Q.QUERIES["op5_topk_norm_sorted"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_large_components_are_exact(spark):
    """Products beyond 2^53 and beyond a long: exact ranks, scores cut off at the range of a long."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-2**24, 2**24)) for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, [2.0 ** 24 + i % 3] * 63 + [float(i)]) for i in range(40)]
    rows += [(200 + i, [rng.choice([-1, 1]) * 1e8] * 64) for i in range(5)] + [(300, [1e20] + [0.5] * 63), (301, [-1e20] + [0.25] * 63), (302, [1e200] * 64), (303, [0.0] * 64)]
    rows += [(400 + i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ends = lambda s: max(-2**63, min(2**63 - 1, s))
    for sizes in ({"block": 16, "query_block": 4}, {}):
        got = top_inner_products(df, df.where("vec_id % 20 = 0 or vec_id >= 300"), k=12, head=8, **sizes).collect()
        want = brute(rows, [r for r in rows if r[0] % 20 == 0 or r[0] >= 300], 12)
        assert sorted(map(tuple, got)) == [(q, n, i, ends(s)) for q, n, i, s in want]
