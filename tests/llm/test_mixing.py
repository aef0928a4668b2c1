import math
from collections import Counter

import pytest
from opsight.llm import mixing as M
from opsight.llm import queries as Q
from opsight.plans.check import compare, duck
from pyspark.sql import functions as F


def make(spark, n=600):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * (1 + i * 7 % 23)) for i in range(n)]
    rows += [(9000, None, "a b c"), (9001, "empty", ""), (9002, "empty", None), (9003, "s1", None), (9004, None, "x\x0by\fz"), (1, "hot", "w " * 8), (1, "hot", "w " * 8), (None, "s2", "q " * 50_000)]
    return spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, source string, text string, epoch string, tokens string").repartition(6)


def test_exponent(spark):
    totals = {"a": 800.0, "b": 150.0, "c": 50.0}
    df = spark.createDataFrame(list(totals.items()), "source string, n double")
    total = sum(totals.values())

    def weights(a):
        z = sum((n / total) ** a for n in totals.values())
        return {s: (n / total) ** a / z for s, n in totals.items()}

    a = M.solve_exponent(df, total, max_repeats=3.0)
    reps = lambda a: max(w * total / totals[s] for s, w in weights(a).items())
    assert 0 < a < 1 and reps(a) <= 3.0 + 1e-6 < reps(a - 1e-3)
    a = M.solve_exponent(df, total, target_entropy=0.9)
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    assert entropy(a) >= 0.9 - 1e-6 > entropy(a + 1e-3)
    assert M.solve_exponent(df, total, max_repeats=100.0) == 0.0
    with pytest.raises(ValueError):
        M.solve_exponent(df, 2 * total, max_repeats=1.5)
    with pytest.raises(ValueError):
        M.solve_exponent(df, total)


@pytest.mark.parametrize("share,limit", [(1.0, 2.5), (0.4, 1.0), (2.5, 4.0)])
def test_budgets_and_passes(spark, share, limit):
    df = make(spark)
    plan = {r.source: r for r in M.mixing_plan(df, share, max_repeats=limit).collect()}
    rows = M.mix_sources(df, share, max_repeats=limit, blocks=8).withColumn("tokens", M.n_tokens(F.col("text"))).collect()
    total = sum(r.n for r in plan.values())
    got, longest, seen = Counter(), Counter(), Counter()
    for r in rows:
        got[r.source] += r.tokens
        longest[r.source] = max(longest[r.source], r.tokens)
        seen[(r.source, r.doc_id, r.text)] += 1
        assert 0 <= r.mix_block < 8
    assert "empty" not in plan and "empty" not in got
    for s, p in plan.items():
        assert abs(p.budget - p.weight * share * total) < 1 and p.weight * share * total / p.n <= limit * (1 + 1e-6)
        assert p.budget <= got[s] < p.budget + 3 * longest[s] + 1  # equal rows are drawn together
    copies = Counter((r.source, r.doc_id, r.text) for r in df.collect())
    for k, n in seen.items():
        assert plan[k[0]].passes * copies[k] <= n <= (plan[k[0]].passes + 1) * copies[k]


def test_reproducible_and_empty(spark):
    df = make(spark)
    one = sorted(map(str, M.mix_sources(df, 0.7, max_repeats=2.0).collect()))
    assert one == sorted(map(str, M.mix_sources(df.repartition(3), 0.7, max_repeats=2.0).collect()))
    assert M.mix_sources(df.limit(0), 0.7, max_repeats=2.0).collect() == []
    assert M.mix_sources(df.where("source = 'empty'"), 0.7, max_repeats=2.0).collect() == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = compare(spark, duck(sf), "op8", Q.QUERIES["op8_temperature_mixing"], Q.ORACLES["op8_temperature_mixing"], sf)
    assert got["status"] == "ok", got
