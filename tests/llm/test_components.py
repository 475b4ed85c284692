import random

from lamina.llm.shared import connected_components


def test_chain_and_random_graph(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(90)] + [(5, 5), (7, None)]
    up = {}

    def top(z):
        while up.setdefault(z, z) != z:
            z = up[z]
        return z

    for a, b in edges:
        if b is not None and a != b:
            up[top(a)] = top(b)
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    nodes = sorted(got)
    assert set(nodes) == {z for a, b in edges if b is not None and a != b for z in (a, b)}
    for x in nodes:
        for y in nodes[::7]:
            assert (got[x] == got[y]) == (top(x) == top(y))


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
