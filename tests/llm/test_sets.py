"""The SQL of the numbered operators on the smallest tables, and the n-gram join on random sets near its threshold."""

import random

import compare
import pytest

from lamina.llm import ngram_join
from lamina.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, SF), compare.database(SF), ORACLES[name]) == ""


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_near_the_threshold(spark, seed):
    """Documents of one common passage, of near copies of each other and of both, at all shares around 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(90)]
    texts = [" ".join([*(word() for _ in range(rng.randrange(25))), *passage[: rng.randrange(20, 61)], *(word() for _ in range(rng.randrange(12)))]) for _ in range(160)]
    for _ in range(160):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own[: rng.randrange(60, 91)]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    got = {r[0]: (r[1], r[2]) for r in ngram_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}
