import math
import random

import numpy as np
import pytest

from opsight.llm import covertree as C

from .conftest import closure, plain_cosine


def brute(rows, cosine):
    """[(vec_id, n_links, component, kept)] by looking at all pairs."""
    def ok(r):
        return (r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]))

    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if ok(rows[i]) and ok(rows[j]) and rows[i][2] == rows[j][2]
             and len(rows[i][1]) == len(rows[j][1]) and plain_cosine(rows[i][1], rows[j][1]) >= cosine]
    deg = [0] * n
    for i, j in links:
        deg[i] += 1
        deg[j] += 1
    root = closure(n, links)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((r[0], deg[i], comp, comp is None or r[0] == comp))
    return out


def near(rng, v, eps):
    return [float(np.float32(x + rng.gauss(0, eps))) for x in v]


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    rows, i = [], 0
    for c in range(12):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((i * 3, near(rng, centre, 0.12), rng.choice([0, 0, 0, 1])))
            i += 1
    copy = near(rng, [rng.gauss(0, 1) for _ in range(8)], 0)
    rows += [(1000 + k, copy, 0) for k in range(30)] + [(2000 + k, near(rng, copy, 0.05), 0) for k in range(20)]
    rows += [(1, None, 0), (2, [], 0), (4, [0.0] * 8, 0), (5, [float("nan")] + [1.0] * 7, 0), (7, [None] + [1.0] * 7, 0),
             (8, [float("inf")] + [1.0] * 7, 1), (10, copy, None), (None, copy, 0), (None, [9.0] * 3, 0), (11, [1.0, 1.0, 1.0], 0),
             (13, [1e-30, 1e-30, 1e-30], 0), (14, [-0.0, 3e30, 0.0], 1), (16, [0.0, 2.0, -0.0], 1), (1000, copy, 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links string, node int")
    got = C.embedding_neighbours(df, cosine=0.98, block=block).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows], 0.98)))


def test_tree_covers_and_separates():
    rng = np.random.default_rng(0)
    u = C._unit(rng.normal(size=(300, 16)))
    t = C.CoverTree(u)
    for k, (points, parents) in enumerate(t.levels):
        assert len(set(points)) == len(points)
        if k:
            assert set(t.levels[k - 1][0]) <= set(points)  # nested
        d = C._chord(u, u[points])[np.arange(300), t.member[k]]
        assert (d <= t.cover[k][t.member[k]] + 1e-7).all()
        apart = C._chord(u[points], u[points])[np.triu_indices(len(points), 1)]
        assert (apart > t.radii[k] - 1e-7).all()  # separated: also from nodes of other parents
        assert (C._chord(u, u[points]).min(axis=1) <= t.radii[k] + 1e-6).all()  # covered
    assert len(t.levels[-1][0]) == 300


def test_separation_of_clustered_points():
    rng = np.random.default_rng(3)
    u = C._unit(np.repeat(rng.normal(size=(20, 3)), 30, axis=0) + rng.normal(size=(600, 3)) * 0.05)
    t = C.CoverTree(u)
    assert len(t.levels) > 5
    for k, (points, _) in enumerate(t.levels[:-1]):
        apart = C._chord(u[points], u[points])[np.triu_indices(len(points), 1)]
        assert (apart > t.radii[k] - 1e-7).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert C.embedding_neighbours(df).collect() == []
