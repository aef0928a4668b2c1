import random

from opsight.llm.components import connected_components

from .conftest import closure


def test_chain_star_cycle_and_random(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(80)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(400 + rng.randrange(60), 400 + rng.randrange(60)) for _ in range(45)]
    rng.shuffle(links)
    got = connected_components(spark.createDataFrame(links, "src long, dst long").repartition(7)).collect()
    root = {r.node: r.root for r in got}
    want = closure(500, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(root) == nodes and len(got) == len(nodes)
    assert len({(root[x], want[x]) for x in nodes}) == len({want[x] for x in nodes}) == len({root[x] for x in nodes})


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
