"""The numbered operators against brute force on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lamina.llm import bpe, licenses, line_dedup, lm, mixing, ngram_join, token_counts, toxicity, vector_dedup, vector_search
from lamina.llm.queries import encoded

LINE = "this line is long enough to count as a repeated line of text"
WORDS = "the quick brown fox jumps over one lazy dog while seven grey cats watch from a high wall and sing".split()
TEXTS = [
    (1, " ".join(WORDS)), (2, " ".join(WORDS) + " loudly"), (3, " ".join(WORDS).upper()), (4, None), (5, ""), (6, "  \n "), (7, "two words"), (8, "Two  WORDS"),
    (9, f"{LINE}\nown words of nine"), (10, f"{LINE.upper()}  \nown words of ten"), (11, LINE), (12, f"x\n{LINE}"), (13, f"{LINE}\n{LINE}"), (14, "naïve café ñandú 漢字 🙂 don't  stop\r\n"), (None, "no name"), (7, "two words"),
    (15, "a" * 3000 + " " + "word " * 2000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 12 else None, 1, "clash") for i, t in TEXTS], "doc_id long, text string, source string, n_lines int, copies string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_ngram_join(docs):
    named = [(i, shingles(t)) for i, t in TEXTS if i is not None]
    root = {i: i for i, _ in named}
    for _ in named:
        for i, a in named:
            for j, b in named:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = sorted(tuple(r) for r in ngram_join.similar_groups(docs).where("doc_id is not null").collect())
    assert got == sorted((i, len(s), root[i]) for i, s in named)


def test_line_dedup(docs):
    lines = {}
    for i, t in TEXTS:
        for x in (t or "").split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 40 and i is not None:
                lines.setdefault(k, set()).add(i)
    out = line_dedup.dedup_lines(docs)
    assert out.columns.count("n_lines") == 1
    for r in out.where("doc_id is not null").collect():
        text = (r["text"] or "").split("\n")
        key = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in text]
        kept = [x for x, k in zip(text, key, strict=True) if len(lines.get(k, ())) < 5 or r["doc_id"] == max(lines[k])]
        assert (r["kept_text"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(text), len(text) - len(kept))


def test_mixing_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", None][i % 4]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix_sizes(x).select("doc_id", "size", "target", "taken", "source_size").collect())) for x in (df, df.repartition(7)))
    assert one == two
    size, target, taken = Counter(), {}, Counter()
    for i, n, t, k, s in one:
        src = rows[i][2]
        size[src] += n
        taken[src] += k
        target[src] = t
        assert k in (0, n, 2 * n) and n == 1 + i * 7 % 40
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] and target[s] <= 2 * size[s] + 1e-6 for s in size)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    v = [(i, (base[i % 12] + 0.03 * rng.normal(size=8)).tolist(), i % 2) for i in range(120)]
    v += [(200, None, 0), (201, [0.0] * 8, 0), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, v[0][1], None), (205, v[0][1], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(x), y) for i, x, y in v if x and None not in x and np.isfinite(x).all() and np.any(x)}
    link = {i: {j for j, (b, m) in good.items() if j != i and y is not None and m == y and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98} for i, (a, y) in good.items()}
    root = {i: i for i, _, _ in v}
    for _ in range(12):
        for i, js in link.items():
            root[i] = min([root[i], *(root[j] for j in js)])
    got = {r[0]: tuple(r)[1:] for r in vector_dedup.near_vectors(df).collect()}
    assert got == {i: (len(link.get(i, ())), root[i], root[i] == i) for i, _, _ in v}
    found = {}
    for r in vector_search.nearest(df, df.where("vec_id % 20 = 0"), 10).collect():
        found.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q, rs in found.items():
        best = sorted(((-float(np.sum(good[q][0] * b)), j) for j, (b, _) in good.items() if j != q))[:10]
        hits += len({j for _, j in best} & {r["vec_id"] for r in rs})
        assert all(abs(r["score"] - good[q][0] @ good[r["vec_id"]][0]) < 1e-9 for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
    assert hits >= 0.9 * 10 * len(found) and set(found) == {q for q in good if q % 20 == 0}


def backoff(history, word, count, starts, n, v, prior):
    """p(word | history) by plain recursion over counts of n-grams."""
    if not history:
        return (count[(word,)] + 1) / (n + v + 1)
    shorter = backoff(history[1:], word, count, starts, n, v, prior)
    followed = starts if history == ("<s>",) else count[history]
    return (count[(*history, word)] + prior * shorter) / (followed + prior)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores_as_the_recursion(docs, order):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    line = {i: ["<s>", *words(t), "</s>"] for i, t in TEXTS}
    count = Counter(tuple(x[j : j + k]) for i, t in TEXTS if not held(i) for x in [["<s>", *words(t), "</s>"]] for k in range(1, order + 1) for j in range(len(x) - k + 1) if k > 1 or j)
    n = sum(c for g, c in count.items() if len(g) == 1)
    v, starts = sum(len(g) == 1 for g in count), sum(not held(i) for i, _ in TEXTS)
    rule = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = [sorted(map(tuple, lm.score_texts(d, rule, order).collect()), key=str) for d in (docs, docs.repartition(1).orderBy("text"))]
    assert [r[:5] for r in got[0]] == [r[:5] for r in got[1]] and len(got[0]) == len(TEXTS)
    for r, other in zip(*got, strict=True):
        x = line[r[0]]
        assert r[2:5] == (len(x) - 1, sum(count[(w,)] > 0 for w in x[1:]), n)
        assert r[5] == pytest.approx(sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in x[1:]), rel=1e-9)
        want = sum(math.log10(backoff(tuple(x[max(0, j - order + 1) : j]), x[j], count, starts, n, v, lm.PRIOR)) for j in range(1, len(x)))
        assert r[6] == pytest.approx(want, rel=1e-9) == other[6]


def test_token_counts_use_the_cache(docs, tmp_path):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    tok = Tokenizer.from_file(str(path))
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in TEXTS)
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, cache).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), "n_bytes", "n_tokens").collect()
        assert sorted(map(tuple, got)) == want
    assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for _, t in TEXTS})


@pytest.mark.parametrize("few", [-1, 1 << 16])
def test_token_counts_of_later_batches_hit_those_of_earlier_ones(docs, tmp_path, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    many = docs.crossJoin(docs.sparkSession.range(4).select(F.col("id").alias("copy"))).select((F.col("doc_id") * 4 + F.col("copy")).alias("doc_id"), "text")
    ask = lambda **x: sorted(map(tuple, token_counts.count_tokens(many, path, x.pop("at"), **x).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_tokens").collect()))
    assert ask(at=cache, batches=3) == ask(at=f"{cache}-whole")
    # Each content is stored once, though its copies are dealt to several batches.
    assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for _, t in TEXTS})


def test_bpe_as_the_library(spark, docs):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = encoded(spark, docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_pieces_merge_as_the_library(spark):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(7)
    texts = ["a" * 100_000, "ab" * 20_000, "漢字" * 5000, "".join(rng.choice(list("etaoinshr"), 30_000)), "".join(rng.choice(list("QzX9kvJw0b"), 200_000))]
    code = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = code.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_licenses(spark):
    grant = licenses.NOTICES["mit-grant"]
    rows = [(1, "intro words here " + grant + " and more"), (2, grant.upper()), (3, " ".join(grant.split()[:12])), (4, None), (5, "nothing of note")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-grant"), (2, "mit-grant")}


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS, 30)) + (" vileword foulword" if i % 5 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (500, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score(df, toxicity.train(df, labels)).where("doc_id >= 400").collect()}
    assert all(v == (i % 5 == 0) for i, v in got.items()) and len(got) == 200
    models = [toxicity.train(df.repartition(n), labels.repartition(m)) for n, m in ((1, 1), (7, 2), (3, 5))]
    assert len({(m.reject, m.weights.tobytes(), m.thetas.tobytes(), m.keys.tobytes()) for m in models}) == 1
    clash = toxicity.score(df.withColumn("severity", F.lit("own")), models[0], keep_columns=True)
    assert sorted(clash.columns) == ["doc_id", "severity", "text"] and clash.where("severity is null").count() == 0


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert ngram_join.similar_groups(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert mixing.mix_sizes(none).count() == 0
    assert lm.score_texts(none, F.lit(True)).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/c").count() == 0
    assert encoded(spark, none).count() == 0
    assert toxicity.score(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_vectors(v).count() == 0 and vector_search.nearest(v, v).count() == 0
