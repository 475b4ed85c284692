"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(theta_j - w x): one weight vector is shared by all ordered thresholds.
Features are hashed words and word beginnings.  The fit takes at most TRAIN_ROWS labelled
documents (a hash sample of the labels) and FEATURES features picked on them; scoring reads
whole texts of all documents.  A fifth of the labelled rows, dealt by the hash of their doc_id, is
held out of the fit and of the choice of features and sets the severity from which texts are
rejected.  Rows are put in order before the fit, so the model is the same however tables are
partitioned.

Labels that only say toxic or not are graded: 0 is not toxic, and toxic texts are 1 or 2 as
their density of words that no other text has is below the median or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lamina.llm import textmath as tm
from lamina.llm.shared import stage

TRAIN_ROWS = 20_000
FEATURES = 1_024
#: Expected severity from which a text is rejected, where no labels say otherwise.
REJECT = 0.5


def _features(raw: np.ndarray, offs: np.ndarray):
    """(row, feature hash) of each word and its first 4 and 5 bytes, distinct; words of each row."""
    start, end, row, count = tm.words(raw, offs)
    kinds = [tm.span_hashes(raw, start, np.minimum(end, start + n)) ^ np.uint64(n) for n in (4, 5, 1 << 40)]
    rows, g = np.concatenate([row] * 3), np.concatenate(kinds)
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])][: len(g)]
    return rows[new], g[new], count


class Model:
    """Features sorted by hash, their weights, and the ordered thresholds."""

    def __init__(self, keys, weights, thetas, reject: float = REJECT):
        self.keys, self.weights, self.thetas, self.reject = keys, weights, thetas, reject

    def hits(self, g: np.ndarray):
        if not len(self.keys):
            return np.zeros(len(g), bool), np.zeros(len(g), np.int64)
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        return self.keys[at] == g, at

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold, a row of them for each text."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - eta[:, None], -500, 500)))


#: Rows of the sparse matrix that the fit spreads out at a time.
ROWS = 1024


class Sparse:
    """A matrix of zeros and ones: sorted row numbers, and the column of each one."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, d: int):
        self.row, self.col, self.shape = row, col, (n, d)

    def rows(self, keep: np.ndarray) -> Sparse:
        own = keep[self.row]
        return Sparse((np.cumsum(keep) - 1)[self.row[own]], self.col[own], int(keep.sum()), self.shape[1])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.shape[0])

    def into(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times a vector."""
        return np.bincount(self.col, weights=v[self.row], minlength=self.shape[1])

    def gram(self, weight: np.ndarray) -> np.ndarray:
        """X' diag(weight) X, from ROWS rows at a time, so its memory doesn't grow with the rows."""
        n, d = self.shape
        root, out = np.sqrt(weight).astype(np.float32), np.zeros((d, d))
        cuts = np.searchsorted(self.row, np.r_[np.arange(0, n, ROWS), n])
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            x = np.zeros((min(ROWS, n - i * ROWS), d), np.float32)
            x[self.row[a:b] - i * ROWS, self.col[a:b]] = root[self.row[a:b]]
            out += x.T @ x
        return out


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int, ridge: float = 1.0, steps: int = 30):
    """Weights and thresholds of the penalised likelihood, by damped Newton steps."""
    n, d = x.shape
    share = np.clip(np.array([(y <= j).mean() for j in range(grades - 1)]), 1e-4, 1 - 1e-4)
    theta, w = np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1), np.zeros(d)

    def parts(theta, w):
        eta = x.times(w)
        f = np.c_[np.zeros(n), 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -35, 35))), np.ones(n)]
        return f, np.clip(f[np.arange(n), y + 1] - f[np.arange(n), y], 1e-12, None)

    def loss(theta, w):
        return -np.log(parts(theta, w)[1]).sum() + ridge / 2 * w @ w if np.all(np.diff(theta) > 0) else np.inf

    now = loss(theta, w)
    for _ in range(steps):
        f, p = parts(theta, w)
        s = f * (1 - f)  # slopes of each cumulative probability; 0 at both ends
        up, low = s[np.arange(n), y + 1], s[np.arange(n), y]
        grad = np.r_[np.zeros(grades - 1), x.into((up - low) / p) + ridge * w]
        h = np.zeros((d + grades - 1,) * 2)
        # up + low bounds the expected curvature of a row in eta.
        h[grades - 1 :, grades - 1 :] = x.gram(up + low) + ridge * np.eye(d)
        for j in range(grades - 1):
            at_up, at_low = y == j, y == j + 1
            grad[j] = -(s[at_up, j + 1] / p[at_up]).sum() + (s[at_low, j + 1] / p[at_low]).sum()
            c = s[:, j + 1] * (at_up | at_low)
            h[j, j] = c.sum() + 1e-6
            h[j, grades - 1 :] = h[grades - 1 :, j] = -x.into(c)
        try:
            step = np.linalg.solve(h + 1e-6 * np.eye(len(h)), grad)
        except np.linalg.LinAlgError:
            step = grad / np.diag(h)
        t = 1.0
        while t > 1e-6:
            a, b = theta - t * step[: grades - 1], w - t * step[grades - 1 :]
            if (new := loss(a, b)) < now:
                break
            t /= 2
        else:
            break
        theta, w, gain, now = a, b, now - new, new
        if gain < 1e-6 * abs(now):
            break
    return w, theta


def rejection_line(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that parts toxic from other rows best, midway to the next row below.

    Best by F 0.5, which counts a clean row that is rejected as more than a toxic one that is not.
    """
    order = np.argsort(-severity, kind="stable")
    s, hit = severity[order], np.cumsum(toxic[order])
    last = np.r_[s[1:] != s[:-1], True]  # a line can't part equal severities
    score = np.where(last, 1.25 * hit / (np.arange(1, len(s) + 1) + 0.25 * toxic.sum()), -1)
    k = int(np.argmax(score))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most about ``rows`` labelled documents.

    ``labels`` has ``doc_id`` and ``toxic``: 0 or 1, or ordered grades from 0.  Null labels are left
    out; of labels that repeat a doc_id the largest counts.  Without two classes the model
    has no features and finds nothing toxic.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > rows:
        labels = labels.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(n)) < rows)
    held = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(5)) == 0
    known = stage(docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("toxic", "text", "doc_id", held.alias("held")), "labelled")
    fitted = known.where("not held")

    def count(batches):
        toxic, clean = [], []
        for batch in batches:
            y = batch.column(0).to_numpy() > 0
            for first, raw, offs in tm.slices(batch.column(1)):
                r, g, _ = _features(raw, offs)
                hot = y[first + r]
                toxic.append(g[hot])
                clean.append(g[~hot])
        if toxic:
            toxic, clean = np.concatenate(toxic), np.concatenate(clean)
            keys, at = np.unique(np.r_[toxic, clean], return_inverse=True)
            t = np.bincount(at[: len(toxic)], minlength=len(keys))
            c = np.bincount(at[len(toxic) :], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["g", "t", "c"])

    n_t, n_c = fitted.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1))).first()
    if not n_t or not n_c:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 41.0]))
    p = (F.col("t") + F.col("c")) / float(n_t + n_c)
    z = (F.col("t") / float(n_t) - F.col("c") / float(n_c)) / F.sqrt(p * (1 - p) * (1 / n_t + 1 / n_c) + 1e-12)
    least = 3 if n_t < 200 else 5
    top = fitted.select("toxic", "text").mapInArrow(count, "g long, t long, c long").groupBy("g").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") + F.col("c") >= least)
    top = top.withColumn("z", z).orderBy(F.desc("z"), "g").limit(features).toArrow()
    keys = top["g"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, only = keys[order], (top["c"].to_numpy() == 0)[order]
    blank = Model(keys, None, None)

    def rows_of(batches):
        for batch in batches:
            for first, raw, offs in tm.slices(batch.column(1)):
                r, g, count = _features(raw, offs)
                hit, at = blank.hits(g)
                r, at, m = r[hit], np.sort(at[hit] + (r[hit] << 32)) & 0xFFFFFFFF, len(count)
                o = pa.array(np.searchsorted(r, np.arange(m + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, m) for i in (2, 3, 0)), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(o, pa.array(at.astype(np.int32)))], ["doc_id", "held", "y", "n", "f"])

    data = known.select("toxic", "text", "doc_id", "held").mapInArrow(rows_of, "doc_id long, held boolean, y int, n long, f array<int>").toArrow().combine_chunks()
    ids, size, flat = data["doc_id"].to_numpy(), data["n"].to_numpy(), data["f"].combine_chunks()
    order = np.lexsort((np.diff(flat.offsets.to_numpy()), size, ids))
    y, other, size, flat = data["y"].to_numpy()[order], data["held"].to_numpy()[order], size[order], flat.take(pa.array(order))
    del data
    x = Sparse(np.repeat(np.arange(len(y)), np.diff(flat.offsets.to_numpy())), flat.flatten().to_numpy(), len(y), len(keys))
    if y.max() == 1:
        density = x.times(only.astype(float)) / np.maximum(size, 1)
        y = np.where(y > 0, 1 + (density >= np.median(density[~other & (y > 0)])), 0)
    y = np.unique(y, return_inverse=True)[1]  # grades without rows would leave thresholds without a place
    grades = int(y.max()) + 1
    y = y.astype(np.int64)
    if min((y[other] > 0).sum(), (y[other] == 0).sum()) < 5 or len(np.unique(y[~other])) < grades:
        return Model(keys, *fit_ordinal(x, y, grades))
    model = Model(keys, *fit_ordinal(x.rows(~other), y[~other], grades))
    model.reject = rejection_line(model.above(x.rows(other).times(model.weights)).sum(1), y[other] > 0)
    return model


def score(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """``doc_id, severity, p_toxic`` doubles and ``rejected`` of every whole text.

    ``severity`` is the expected grade.  Null, empty and unknown texts score what the model
    says of no features.  Null and repeated doc_ids are kept.  With ``keep_columns`` the columns of
    ``docs`` are returned and ``severity`` added (one of that name in ``docs`` is replaced).
    """

    def judge(texts):
        severity, toxic = [], []
        for _, raw, offs in tm.slices(texts):
            r, g, count = _features(raw, offs)
            hit, at = model.hits(g)
            eta = np.bincount(r[hit], weights=model.weights[at[hit]], minlength=len(count)) if len(model.keys) else np.zeros(len(count))
            above = model.above(eta)
            severity.append(above.sum(1))
            toxic.append(above[:, 0])
        return (np.concatenate(v) if v else np.zeros(0) for v in (severity, toxic))

    if keep_columns:
        docs = docs.drop("severity")
        place = docs.columns.index("text")

        def whole(batches):
            for batch in batches:
                severity, _ = judge(batch.column(place))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity)], [*batch.schema.names, "severity"])
                pa.default_memory_pool().release_unused()

        return docs.mapInArrow(whole, StructType([*docs.schema.fields, StructField("severity", DoubleType())]))

    def run(batches):
        for batch in batches:
            severity, toxic = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(toxic), pa.array(severity >= model.reject)], ["doc_id", "severity", "p_toxic", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, rejected boolean")
