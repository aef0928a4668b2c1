import random

from opsight.llm import simhash as S
from opsight.llm.common import materialise

from .conftest import closure, plain_simhash


def groups_of(rows, shingle, radius):
    fps = [plain_simhash(t, shingle) for _, t in rows]
    n = len(rows)
    root = closure(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def texts():
    rng = random.Random(1)
    words = ["alpha", "Beta", "ça", "tion", "ß", "the", "of", "x1", "Été", "zu,"]
    rows = []
    for i in range(60):
        t = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        rows.append((i, " ".join(t)))
        for k in range(rng.choice([0, 1, 3])):
            u = list(t)
            u[rng.randrange(len(u))] = f"changed{k}"
            rows.append((100 + 4 * i + k, "\t".join(u)))
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "ALPHA1 b"), (904, "alpha1\x0bB"), (None, ""), (None, "lonely words here and there"),
             (905, "w " * 30_000), (906, "w " * 30_001), (0, rows[0][1])]
    return rows


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, fp string, id int")
    got = [(r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in S.simhash_groups(df, shingle=3, radius=2).collect()]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(got, key=key) == sorted(groups_of(rows, 3, 2), key=key)
    assert S.simhash_groups(df.limit(0)).collect() == []


def test_links_with_split_classes(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(400):  # one ball of fingerprints that share nearly all blocks
        x = base
        for _ in range(rng.choice([1, 2, 3, 5])):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = materialise(spark.createDataFrame([(sign(x),) for x in fps], "fp long"), "t")
    want = closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    at = {sign(x): i for i, x in enumerate(fps)}
    for limit in (20, 100, 4096):
        links = [(at[r.src], at[r.dst]) for r in S.near_links(df, 2, max_class=limit).collect()]
        assert closure(len(fps), links) == want


def test_dedup_keeps_one_row_of_each_group(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in S.simhash_dedup(df).collect()]
    want = [g[0] for g in groups_of(rows, 3, 2) if g[0] is not None and g[0] == g[2]]
    assert sorted(k[0] for k in kept if k[0] is not None) == sorted(set(want))
    assert sum(k[0] is None for k in kept) == 2


def test_dedup_of_repeated_ids_on_different_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "lorem ipsum dolor sit amet consectetur")
    for rows, want in (([(5, a), (7, a), (5, b), (3, b)], [(3, b), (5, a)]), ([(5, a), (5, b), (5, b), (5, c), (9, c), (1, "x y z w")], [(1, "x y z w"), (5, a), (5, b), (5, c)]),
                       ([(5, a), (5, a), (2, a), (8, b)], [(2, a), (8, b)])):
        kept = S.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, kept)) == sorted(want)
