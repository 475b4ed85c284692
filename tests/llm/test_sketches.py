"""The n-gram join moves neither texts nor sets of documents that can't be similar."""

import numpy as np
import pytest

from lamina.llm import ngram_join


def _texts(spark):
    """Pairs with half of their shingles in common, then pairs that differ by one word at the end."""
    texts = []
    for p in range(12):
        half = [f"c{p}w{j}" for j in range(28)]
        texts += [" ".join([*half, *(f"d{p}s{s}w{j}" for j in range(12))]) for s in range(2)]
    for p in range(5):
        most = [f"m{p}w{j}" for j in range(40)]
        texts += [" ".join([*most, f"end{s}"]) for s in range(2)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_only_sets_that_may_be_similar_are_compared(spark, monkeypatch):
    met, exact = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs: met.append(pairs.count()) or exact(pairs))
    got = {r[0]: r[1] for r in ngram_join.similar_groups(_texts(spark)).select("doc_id", "component_id").collect()}
    assert got == {i: i if i < 24 else i - i % 2 for i in range(34)}
    assert sum(met) == 5


def test_texts_are_not_shuffled(spark, monkeypatch):
    plans, sets = [], ngram_join._sets
    monkeypatch.setattr(ngram_join, "_sets", lambda docs, *a: plans.append(docs._jdf.queryExecution().executedPlan().toString()) or sets(docs, *a))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ngram_join.similar_groups(docs)
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)


def test_packed_prefixes_hold_no_more_with_more_buckets(spark):
    """Sizes and steps of a set are packed, so they hardly weigh where each bucket has few of its shingles."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 400))) for i in range(300)], "doc_id long, text string").coalesce(1)
    frequent = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    rows = ngram_join._prefixes(docs, frequent, 5, 64, np.zeros(0, np.int64), 64).where("bucket is not null").collect()
    held = sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))
    shingles = sum(len(x) for r in rows for x in [ngram_join.unpacked(r["tok"], r["size"], np.uint64)])
    assert held < 17 * shingles


@pytest.mark.parametrize("seed", range(3))
def test_sketches_keep_all_similar_sets(seed):
    rng = np.random.default_rng(seed)
    kept = far = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        m = max(1, int(n * rng.uniform(0.7, 1.4)))
        both = int(rng.integers(0, min(n, m) + 1)) if rng.random() < 0.3 else max(0, min(n, m) - int(rng.integers(0, 40)))
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        pool = ngram_join.tm.mix(pool)
        a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : n + m - both]])
        x, y = ngram_join._sketches(np.r_[a, b], np.array([n, m]))
        (ok,) = ngram_join._close(n, x, np.array([m]), [y])
        if 100 * both >= 80 * (n + m - both):
            assert ok
            kept += 1
        elif 100 * both < 60 * (n + m - both) and n > 30:
            far += ok
    assert kept > 50 and far < 3


def test_likely_keeps_keys_and_rows_without_one(spark):
    rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, id) as key", "string(id) as text").repartition(4)
    keys = spark.range(0, 5000, 7).selectExpr("id as key")
    got = {r["text"] for r in ngram_join._likely(rows, "key", keys).collect()}
    must = {str(i) for i in range(5000) if i % 7 == 0 or i % 50 == 0}
    assert must <= got and len(got) < len(must) + 300
    assert ngram_join._likely(rows, "key", keys.limit(0)).count() == 100
