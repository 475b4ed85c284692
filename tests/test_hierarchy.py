"""Ward clustering against merging one pair at a time."""

import numpy as np
import pytest

from lamina.operators import hierarchy


def ward(x):
    live = {i: (1, x[i]) for i in range(len(x))}
    out = []
    while len(live) > 1:
        d, a, b = min((n * m / (n + m) * ((c - e) ** 2).sum(), i, j) for i, (n, c) in live.items() for j, (m, e) in live.items() if i < j)
        (n, c), (m, e) = live.pop(a), live.pop(b)
        live[a] = (n + m, (n * c + m * e) / (n + m))
        out.append((a, b, (2 * d) ** 0.5))
    return out


def cut(merges, n, k):
    root = list(range(n))
    for a, b, _ in sorted(merges, key=lambda m: (m[2], m[0], m[1]))[: n - k]:
        root = [a if r == b else r for r in root]
    order = sorted(set(root))
    return np.array([order.index(r) + 1 for r in root])


def silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = (c == c[i]).sum()
        if own == 1:
            s.append(0.0)
            continue
        a = d[i, c == c[i]].sum() / (own - 1)
        b = min(d[i, c == o].mean() for o in set(c) if o != c[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


@pytest.mark.parametrize("kind", ["random", "groups"])
def test_types_are_wards(spark, kind, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    if kind == "groups":
        x = rng.normal(size=(3, 3))[np.arange(40) % 3] * 8 + 0.3 * x
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0)], "cell long, a double, b double, c double").repartition(3)
    z = (x - x.mean(0)) / (x.std(0, ddof=1) + 1e-9)
    want = ward(z)
    points = hierarchy.standardised(df, "cell", ["a", "b", "c"])
    got = sorted(((r["a"], r["b"], r["height"]) for r in hierarchy.ward_merges(points).collect()), key=lambda m: m[2])
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    scores = {k: silhouette(z, cut(want, 40, k)) for k in (2, 3, 4)}
    best = max(scores, key=scores.get)
    types = hierarchy.cell_types(df, "cell", ["a", "b", "c"]).collect()
    assert {r["k"] for r in types} == {best} and types[0]["silhouette"] == pytest.approx(scores[best])
    assert [r["cell_type"] for r in sorted(types, key=lambda r: r["id"])] == cut(want, 40, best).tolist()
    if kind == "groups":
        assert best == 3


def test_equal_points_and_few_cells(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 5 else 2.0) for i in range(8)], "cell long, a double")
    got = {r["id"]: r["cell_type"] for r in hierarchy.cell_types(df, "cell", ["a"]).collect()}
    assert got == {i: 1 if i < 5 else 2 for i in range(8)}
    assert hierarchy.cell_types(df.limit(5), "cell", ["a"]).count() == 0
    assert hierarchy.ward_merges(hierarchy.standardised(df.limit(0), "cell", ["a"])).count() == 0
