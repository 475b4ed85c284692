"""Centroid clustering, the filter audit and exact dedup against brute force."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import centroids, exact_dedup, filter_audit

SPACE = re.compile("[\x20\x09-\x0d]+")


def lloyd(x, ids, k, rounds):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "", x[i].tolist()))
    c = x[order[:k]].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if turn < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = x[a == j].sum(0) // (a == j).sum()
    return c, a, d[np.arange(len(x)), a]


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "few"])
def test_clusters_are_lloyds(spark, kind):
    rng = np.random.default_rng(5)
    n = {"few": 5}.get(kind, 700)
    x = rng.normal(size=(n, 8))
    if kind == "clusters":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, n)] + 0.01 * x
    elif kind == "equal":
        x = np.repeat(x[:3], 234, axis=0)[:n]
    ids = [None if i == 3 else i - i % 2 if kind == "equal" else i for i in range(n)]
    rows = [(i, v.tolist(), "clash") for i, v in zip(ids, x, strict=True)]
    rows += [(9001, None, ""), (9002, [1.0], ""), (9003, [float("nan")] * 8, ""), (9004, [None] * 8, ""), (9005, [float("inf")] * 8, ""), (9006, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(3)
    order = F.coalesce(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), F.lit(""))
    got = centroids.cluster(df, 16, 3, width=8, scale=64, seed_order=order).collect()
    whole = np.floor(x * 64).astype(np.int64)
    c, a, d = lloyd(whole, ids, 16, 3)
    text = lambda t: ",".join(map(str, t))
    want = sorted((str(i), int(j), int(z), int(d[a == j].sum()), int(d.sum()), text(c[j])) for i, j, z in zip(ids, a, d, strict=True))
    assert sorted((str(r[0]), *tuple(r)[1:5], text(r["centroid"])) for r in got) == want


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(6)
    x = np.floor(1000 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + 0.02 * rng.normal(size=(2000, 16)))).astype(np.int64)
    tree = centroids.CoverTree(x)
    assert sorted(tree.order) == list(range(2000))
    for i in range(len(tree.centre)):
        members = tree.order[tree.start[i] : tree.end[i]]
        far = np.sqrt(((x[members] - x[tree.centre[i]]) ** 2).sum(1))
        assert far.max() == pytest.approx(tree.radius[i]) and tree.centre[i] in members
        for j in range(tree.first[i], tree.last[i]):
            assert tree.radius[j] <= tree.radius[i] / 2 + 1e-9 and tree.start[i] <= tree.start[j] < tree.end[j] <= tree.end[i]
    c = x[:40]
    got, compared = centroids.nearest_centroids(x, tree, c, centroids.CoverTree(c, leaf=1))
    assert (got == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all() and compared < 0.1 * 2000 * 40


def test_vectors_too_large_raise(spark):
    df = spark.createDataFrame([(1, [3e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(df, 2, 1, width=1, scale=64, seed_order=F.col("vec_id")).collect()


ROWS = [
    (1, "a b a b", "en"), (2, "A b", "en"), (3, None, "en"), (4, "", None), (5, " \n", ""), (6, "word " * 250, "de"), (7, " ".join(f"w{i}" for i in range(300)), "de"), (8, "x # y", "de"), (9, "a b a b", "de"),
    (9, "a b a b", "de"), (9, "other text", "de"), (None, "a b a b", "en"), (None, "a b a b", "en"), (10, "é漢字 " * 220 + "ABC", "fr"), (11, "z" * 50_000 + " " + "A" * 2000, "fr"), (12, "a b a b", "fr"),
]
LABELS = [(1, 1, 0), (1, None, 1), (6, 0, 1), (9, 1, None), (12, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_audit_of_every_order(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, part string").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    rows = []
    for i, t, lang in ROWS:
        t, w = t or "", [x for x in SPACE.split(t or "") if x]
        up = sum("A" <= c <= "Z" for c in t)
        smaller = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in ROWS)
        fails = {f for f, x in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * up > 3 * len(t), any(c in "#$%&*|" for c in t), smaller], strict=True) if x}
        rows.append((lang or "", fails, any(j == i is not None and q == 1 for j, q, _ in LABELS), any(j == i is not None and x == 1 for j, _, x in LABELS)))
    want, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in rows if r[0] == part and f in r[1]]
                shapley[part, f] += len(out)
                want[part, "".join(order), step] = [len(left), len(out), len(every) - len(out), sum(r[1] == {f} for r in every), sum(r[2] for r in out), sum(r[3] for r in out)]
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}


def test_interactions_of_other_filters(spark):
    df = spark.createDataFrame([("p", 2, True, None), ("p", 1, True, True), ("p", 4, False, False)], "part string, n_rows long, X boolean, Y boolean")
    got = sorted(map(tuple, filter_audit.interactions(df, "XY").collect()))
    assert got == [("p", "XY", 1, 4, 3, 0, 2, 5), ("p", "XY", 2, 4, 0, 1, 0, 1), ("p", "YX", 1, 6, 1, 0, 0, 1), ("p", "YX", 2, 4, 2, 1, 2, 5)]
    with pytest.raises(ValueError):
        filter_audit.interactions(df, ["X", "X"])


TEXTS = [(i, f"text {i % 40}" + " \n"[i % 2] + "end") for i in range(300)] + [(1000, None), (1001, ""), (1002, " "), (1003, "\t\r\n"), (None, "text 1 end"), (None, "alone"), (None, "alone"), (7, "text 7\nend"), (7, "text 7 end"), (7, "own"), (1004, "é" * 300_000), (1005, "é" * 300_000)]


def groups(rows):
    norm = [SPACE.sub(" ", t or "") for _, t in rows]
    least = {}
    for (i, _), t in zip(rows, norm, strict=True):
        least.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        named = [j for j in least[t] if j is not None]
        out.append((str(i), str(min(named) if named else None), len(least[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


KEYS = {"hash": exact_dedup.default_key, "one key": lambda c: F.lit(7).cast("long"), "few keys": lambda c: F.xxhash64(c) % 3, "close keys": lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(1000)), 52), "low bits": lambda c: F.pmod(F.xxhash64(c), F.lit(1000))}


@pytest.mark.parametrize("key", sorted(KEYS))
def test_exact_groups_whatever_the_key(spark, key):
    df = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, content string").repartition(5)
    index = exact_dedup.HashIndex(spark, capacity=4, deepest=3 if key == "low bits" else exact_dedup.DEEPEST)
    got = exact_dedup.dedup(df, KEYS[key], index=index).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == groups(TEXTS)
    # One row of each group stays, that of keep_id.
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_index_splits_overfull_buckets_and_takes_later_batches(spark):
    rows = [(i, f"text {i % 500}") for i in range(900)]
    df = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = exact_dedup.HashIndex(spark, capacity=16)
    exact_dedup.dedup(df(rows[450:]), index=index)
    before = len(index.directory)
    got = exact_dedup.dedup(df(rows[:450]), index=index).collect()
    assert len(index.directory) >= max(before, 500 // 16)
    full = index.entries.groupBy("bucket").count()
    assert full.where("count > 16").count() == 0 and index.entries.count() == 500
    # Directory entries cover all keys once.
    assert sum(2.0**-d for d, _ in index.directory) == 1
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, min(i, i + 500) if i < 400 else i, 2 if i < 400 else 1) for i in range(450)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert exact_dedup.dedup(docs).count() == 0
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), 16, 3, 64, 64, F.col("vec_id")).count() == 0
