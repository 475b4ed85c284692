"""LM scoring with a weighted backoff automaton of n-grams.

States are histories of up to order - 1 tokens (a text starts in the state of START).  From the
state of h an arc of word w holds the smoothed log probability of h w and leads to the state of the
longest suffix of h w that is a history.  A state's failure arc, taken where it has no arc of the
next word, adds the state's backoff weight and goes to the state without h's first token; the
last state, of no tokens, has an arc for every word, known or not.  Smoothing is Dirichlet's:

    p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M)      with an arc
             =          M / (c(h) + M)  p(w | h')       over the failure arc

with h' the history without its first token, c(h) the times that h is followed by a token, and
add-one unigrams at the end.  So p( | h) sums to one over all words, and arcs need counts only.

Each text is walked once from left to right, carrying its state.  No model is held in one place:
texts come in chunks of bytes; a chunk asks for the counts of its distinct n-grams, which are dealt by
hash over buckets whose number grows with the corpus, and the answers make the part of the automaton that
its texts can reach.  All counts cover all training texts, in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import textmath as tm
from lamina.llm.shared import packed, partitions, stage, unpacked

END = np.uint64(0x656E645F6F665F74)
START = np.uint64(0x73746172745F6F66)
ORDER = 3
#: Prior weight of the shorter history, in tokens.
PRIOR = 8.0
#: Bytes of text in one chunk, about, and for each bucket of counts.
CHUNK_BYTES = 4 << 20
#: Chunks that a task's writer or reader holds at once, and that a task's sort gets, about.
HELD = 2
SORTED = 8
#: Bytes of an n-gram's name inside its bucket.  Of two million names in a bucket some two are equal with a chance of 0.7 %; such
#: a pair of n-grams gets the sum of both counts.  Longer names would cost shuffle bytes in proportion.
NAME = 6


def _tokens(texts: pa.Array):
    """Token hashes of texts, each closed by END, and the tokens of each text."""
    tok, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, raw, offs in tm.slices(texts):
        start, end, row, count = tm.words(raw, offs)
        out = np.full(len(row) + len(count), END, np.uint64)
        out[np.arange(len(row)) + row] = tm.span_hashes(raw, start, end)
        tok.append(out)
        n.append(count + 1)
    return np.concatenate(tok), np.concatenate(n)


def _grams(tok: np.ndarray, n: np.ndarray, order: int):
    """Hashes of the 1- to order-grams that end at each token, 0 where START leaves no room.

    Longer ones may begin with START; row k - 1 holds the k-grams.
    """
    at = np.arange(len(tok)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
    out = np.zeros((order, len(tok)), np.uint64)
    out[0] = tm.mix(tok)
    for k in range(2, order + 1):
        # The k-gram is the (k - 1)-gram that ends here, behind the token k - 1 before.
        first = np.full(len(tok), START, np.uint64)
        if len(tok) >= k:
            first[k - 1 :] = tok[: len(tok) - k + 1]
        first[at == k - 2] = START
        out[k - 1] = np.where(at >= k - 2, tm.mix(out[k - 2] ^ (tm.mix(first) + np.uint64(k))), 0)
    return out


def _distinct(grams: np.ndarray, own: np.ndarray, buckets: int):
    """Distinct n-grams by (bucket, order, name): bucket, order, name, hash, own count; where each one went."""
    order, size = grams.shape
    flat = grams.ravel()
    g, slot = np.unique(flat, return_inverse=True)
    c = np.bincount(slot, weights=np.tile(own, order), minlength=len(g)).astype(np.int64)
    k = np.zeros(len(g), np.int64)
    k[slot] = np.repeat(np.arange(1, order + 1), size)
    if len(g) and g[0] == 0:  # no n-gram
        k[0] = 0
    bucket, name = (g % np.uint64(buckets)).astype(np.int64), g // np.uint64(buckets) & np.uint64((1 << 8 * NAME) - 1)
    by = np.lexsort((name, k, bucket))
    by = by[k[by] > 0]
    place = np.full(len(g), -1, np.int64)
    place[by] = np.arange(len(by))
    return bucket[by], k[by], name[by], c[by], place[slot].reshape(order, size)


def _steps(name: np.ndarray, many: list[int]) -> np.ndarray:
    """Names, sorted within each order, as steps from one to the next."""
    out = np.diff(name, prepend=np.zeros(1, np.uint64))
    head = np.cumsum(many)[:-1]
    head = head[head < len(name)]
    out[head] = name[head]
    return out


def _names(steps: np.ndarray, many: list[int]) -> np.ndarray:
    return np.concatenate([np.cumsum(x, dtype=np.uint64) for x in np.split(steps, np.cumsum(many)[:-1])])


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows ``chunk, ids, train, texts`` of about CHUNK_BYTES of text, written once."""

    def run(batches):
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            t = pa.concat_tables(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks()) for c in ("doc_id", "train", "text")]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *lists], ["chunk", "ids", "train", "texts"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            sizes = np.cumsum(t["size"].to_numpy())
            i = 0
            while i < len(t):
                base = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES - size, "right")))
                held.append(t.slice(i, j - i))
                size += int(sizes[j - 1] - base)
                i = j
                if size >= CHUNK_BYTES or i < len(t):
                    yield out()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield out()

    sized = docs.select("doc_id", "train", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return stage(sized.mapInArrow(run, "chunk long, ids array<long>, train array<boolean>, texts array<string>"), "chunks", rows=HELD)


def _unpack(texts, train):
    tok, n = _tokens(texts)
    return tok, n, np.repeat(train.to_numpy(zero_copy_only=False).astype(np.int64), n)


def _questions(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each chunk's distinct n-grams by bucket, with its own training counts."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                chunk, texts, train = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values
                tok, n, own = _unpack(texts, train)
                bucket, k, name, c, _ = _distinct(_grams(tok, n, order), own, buckets)
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(ends))
                for part in range(0, len(used), 256):
                    cuts = [slice(ends[b], ends[b + 1]) for b in used[part : part + 256]]
                    many = [np.bincount(k[s], minlength=order + 1)[1:].tolist() for s in cuts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chunk] * len(cuts), pa.int64()), pa.array(used[part : part + 256].astype(np.int64)), pa.array(many, pa.list_(pa.int64())),
                        pa.array([packed(_steps(name[s], m)) for s, m in zip(cuts, many, strict=True)], pa.binary()), pa.array([packed(c[s].astype(np.uint32)) for s in cuts], pa.binary()),
                    ], ["chunk", "bucket", "many", "names", "counts"])

    return chunks.select("chunk", "texts", "train").mapInArrow(run, "chunk long, bucket long, many array<long>, names binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """Sums of one bucket, for each chunk in its own order; a row of a null chunk has tokens and words."""
    many = np.array(table["many"].to_pylist())
    order = many.shape[1]
    names = np.concatenate([_names(unpacked(x.as_py(), m.sum(), np.uint64), m) for x, m in zip(table["names"], many, strict=True)])
    own = np.concatenate([unpacked(x.as_py(), m.sum(), np.uint32) for x, m in zip(table["counts"], many, strict=True)]).astype(np.int64)
    k = np.repeat(np.tile(np.arange(1, order + 1, dtype=np.uint64), len(many)), many.ravel())
    key, slot = np.unique(names | k << np.uint64(8 * NAME), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, slot, own)
    ends = np.r_[0, np.cumsum(many.sum(1))]
    words = total[key >> np.uint64(8 * NAME) == 1]
    counts = [packed(total[slot[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = len(counts)
    return pa.table([
        pa.array([*table["chunk"].to_pylist(), None], pa.int64()), pa.array([*table["bucket"].to_pylist(), None], pa.int64()),
        pa.array([*many.sum(1).tolist(), None], pa.int64()), pa.array([*counts, None], pa.binary()), pa.array([None] * n + [[int(words.sum()), int((words > 0).sum())]], pa.list_(pa.int64())),
    ], ["of", "bucket", "n", "counts", "sums"])


class Automaton:
    """The part of the automaton that a chunk's texts can reach.

    The arc that a state has for a token is the n-gram of both, so arcs are told by token: ``known``
    is the longest n-gram that ends there and has training counts, ``arc[k - 1]`` the weight of
    the arc that makes a k-gram, ``back[k]`` that of the failure arc from the state of k tokens.
    """

    def __init__(self, counts: np.ndarray, first: np.ndarray, starts: int, tokens: int, words: int, prior: float):
        """``counts``: of the k-gram that ends at each token, row k - 1; ``first``: which tokens begin a text."""
        self.order, size = counts.shape
        self.known = np.cumprod(counts > 0, axis=0).sum(0)
        p = (counts[0] + 1.0) / (tokens + 1.0 * (words + 1))
        self.arc, self.back = [np.log10(p)], [np.zeros(size)]
        for k in range(2, self.order + 1):
            history = np.r_[0, counts[k - 2][:-1]][:size].astype(float)
            history[first] = starts if k == 2 else 0
            weight = prior / (history + prior)
            p = counts[k - 1] / (history + prior) + weight * p
            self.arc.append(np.log10(p))
            self.back.append(np.log10(weight))

    def walk(self, begin: int, end: int) -> float:
        """The log probability of the tokens of one text, from left to right."""
        known, top = self.known[begin:end].tolist(), self.order - 1
        arc, back = ([x[begin:end].tolist() for x in rows] for rows in (self.arc, self.back))
        state, total = min(1, top), 0.0  # the state of START
        for i, longest in enumerate(known):
            while state and longest <= state:
                total += back[state][i]
                state -= 1
            total += arc[state][i]
            state = min(state + 1, top) if longest > state else 0
        return total


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """Score whole texts with an n-gram model of the documents where ``train`` holds.

    Args: ``docs`` with ``doc_id`` and ``text``; ``train``: a condition on its columns, null is
    false; ``order``: tokens of the longest n-grams; ``prior``: the weight M of shorter histories.
    Returns ``doc_id, trained`` (the condition), ``n_tokens, n_known, train_tokens`` longs,
    ``base_score, score`` doubles, base 10 logarithms.

    A null or empty text is its end token alone.  Null and repeated doc_ids are kept, each row
    with its score.  Without training documents every word is unknown; an empty table gives
    no rows.  The scores are the same however the rows are dealt.
    """
    spark = docs.sparkSession
    chunks = _chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text")))
    buckets = max(partitions(spark), chunks.count())
    # Tasks grow in number with the corpus, not in size.
    tasks = max(partitions(spark), -(-buckets // SORTED))
    answers = stage(_questions(chunks, order, buckets).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answer, "of long, bucket long, n long, counts binary, sums array<long>"), "answers")
    n, v = (x or 0 for x in answers.where("of is null").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(2)]).first())

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        ids, train, words = (texts[c].combine_chunks().flatten() for c in ("ids", "train", "texts"))
        tok, size, own = _unpack(words, train)
        *_, slot = _distinct(_grams(tok, size, order), own, buckets)
        # Answers of buckets in order fit the distinct n-grams in order.
        by = np.argsort(counts["bucket"].to_numpy())
        held = np.concatenate([*(unpacked(counts["counts"][int(i)].as_py(), counts["n"][int(i)].as_py(), np.int64) for i in by), np.zeros(1, np.int64)])
        c = held[slot]  # -1, no n-gram, takes the last, 0
        ends = np.cumsum(size)
        first = np.zeros(len(tok), bool)
        first[ends - size] = True
        model = Automaton(c, first, int(c[0][ends[0] - 1]), n, v, prior)
        doc = np.repeat(np.arange(len(size)), size)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(size))
        score = np.array([model.walk(int(b), int(e)) for b, e in zip(ends - size, ends, strict=True)])
        return pa.table([ids, train, pa.array(size.astype(np.int64)), pa.array(total(c[0] > 0).astype(np.int64)), pa.array(np.full(len(size), n, np.int64)), pa.array(total(model.arc[0])), pa.array(score)], out)

    out = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = answers.where("of is not null").select("of", "bucket", "n", "counts")
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(back.repartition(tasks, "of").groupBy("of")).applyInArrow(run, schema)
