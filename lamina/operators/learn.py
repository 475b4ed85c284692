"""Learned models and their evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.series import average_rank


def roc_auc(df: DataFrame, on: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve from the rank sum of positives."""
    r = df.withColumn("_r", average_rank(score, on)).withColumn("_p", positive.cast("int"))
    g = r.groupBy(*on).agg(F.sum(F.col("_r") * F.col("_p")).alias("s"), F.sum("_p").alias("np"), F.sum(1 - F.col("_p")).alias("nn"))
    return g.select(*on, ((F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / F.nullif(F.col("np") * F.col("nn"), F.lit(0))).alias("auc"), "np", "nn")


def confusion(df: DataFrame, score: str, positive: Column, cuts: list[float]) -> DataFrame:
    """Counts at each threshold (score at or above it is called positive), in one pass."""
    x = df.withColumn("_p", positive).withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    called = F.col(score) >= F.col("cut")
    n = lambda c: F.sum(c.cast("int"))
    return x.groupBy("cut").agg(n(called & F.col("_p")).alias("tp"), n(called & ~F.col("_p")).alias("fp"), n(~called & F.col("_p")).alias("fn"), n(~called & ~F.col("_p")).alias("tn"))


def badness(df: DataFrame, key: str, group: str, features: dict[str, int]) -> DataFrame:
    """Mean of the three largest worse-direction robust z-scores, with medians of other groups.

    ``features``: name to +1 (higher is worse) or -1.  Scale is 1.4826 MAD, at least half an SD.
    Each row meets the statistics of its group's complement, computed a group at a time.
    """
    long = df.select(key, group, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) * s).cast("double").alias("v")) for f, s in features.items()])).alias("x")).select(key, group, "x.*").where("v is not null")
    groups = long.select(F.col(group).alias("_g")).distinct()
    rest = long.join(F.broadcast(groups), F.col(group) != F.col("_g"))
    med = rest.groupBy("_g", "feature").agg(F.median("v").alias("med"), F.stddev_pop("v").alias("sd"))
    mad = rest.join(med, ["_g", "feature"]).groupBy("_g", "feature").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("med")))).alias("mad"))
    s = med.join(mad, ["_g", "feature"]).withColumnRenamed("_g", group)
    z = long.join(s, [group, "feature"]).withColumn("z", (F.col("v") - F.col("med")) / F.nullif(F.greatest("mad", 0.5 * F.col("sd")), F.lit(0.0)))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("z", F.lit(0.0))).alias("m"), "feature"))), 1, 3)
    g = z.groupBy(key, group).agg(top.alias("t"))
    reasons = F.array_join(F.transform(F.filter("t", lambda x: -x["m"] > 2), lambda x: x["feature"]), ", ")
    return g.select(key, group, (-F.aggregate(F.transform("t", lambda x: x["m"]), F.lit(0.0), lambda a, b: a + b) / F.size("t")).alias("badness"), reasons.alias("reasons"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labellings from their contingency counts."""
    two = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cell = df.groupBy(a, b).agg(F.count("*").alias("n"))
    s = cell.agg(two("n").alias("ij"), F.sum("n").alias("n"))
    sa, sb = (cell.groupBy(c).agg(F.sum("n").alias("m")).agg(two("m").alias(k)) for c, k in ((a, "i"), (b, "j")))
    x = s.join(sa).join(sb).withColumn("e", F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2))
    return x.select(((F.col("ij") - F.col("e")) / F.nullif((F.col("i") + F.col("j")) / 2 - F.col("e"), F.lit(0.0))).alias("ari"))


def correlation_groups(df: DataFrame, on: list[str], unit: str, t: str, f: str, cut: float = 0.75) -> DataFrame:
    """Average-linkage groups of units whose mean correlation is at least ``cut``; one run of a few
    units a task: ``on, unit, cluster`` numbered by first unit."""
    schema = ", ".join(f"{n} {k}" for n, k in df.select(*on, unit).dtypes) + ", cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=t, columns=unit, values=f)
        r = m.corr().to_numpy()
        sets = [[i] for i in range(len(r))]
        while len(sets) > 1:
            best = max((np.mean(r[np.ix_(a, b)]), -i, -j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
            if not best[0] >= cut:
                break
            i, j = -best[1], -best[2]
            sets[i] = sorted(sets[i] + sets[j])
            del sets[j]
        sets.sort()
        out = pd.DataFrame([(m.columns[i], k + 1) for k, s in enumerate(sets) for i in s], columns=[unit, "cluster"])
        for o in on:
            out[o] = pdf[o].iloc[0]
        return out[[*on, unit, "cluster"]]

    return df.select(*on, unit, t, f).groupBy(*on).applyInPandas(run, schema)


def nmf_labels(df: DataFrame, on: list[str], unit: str, v: str, k: int = 6, steps: int = 200, seed: int = 0) -> DataFrame:
    """Argmax component of a non-negative factorisation of each key's unit x value matrix."""
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*on, unit).dtypes) + ", component int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(unit)
        x = np.maximum(np.stack(pdf[v].to_numpy()).astype(float), 0)
        rng = np.random.default_rng(seed)
        w, h = rng.random((len(x), k)) + 1e-3, rng.random((k, x.shape[1])) + 1e-3
        for _ in range(steps):
            h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
            w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
        out = pdf[[*on, unit]].copy()
        out["component"] = (w * h.sum(1)).argmax(1).astype(np.int32)
        return out

    return df.select(*on, unit, v).groupBy(*on).applyInPandas(run, schema)


def spectrum(df: DataFrame, on: list[str], t: str, f: str, rate: float, bands: dict[str, tuple[float, float]], size: int = 256) -> DataFrame:
    """Welch power (Hann, half overlap, constant detrend) in bands, of each series in one task."""
    schema = ", ".join(f"{n} {k}" for n, k in df.select(*on).dtypes) + "".join(f", {b} double" for b in bands)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        freq, p = welch(pdf.sort_values(t)[f].to_numpy(float), None, rate, size)
        row = {o: pdf[o].iloc[0] for o in on} | {b: float(p[(freq >= lo) & (freq < hi)].sum()) for b, (lo, hi) in bands.items()}
        return pd.DataFrame([row])

    return df.select(*on, t, f).groupBy(*on).applyInPandas(run, schema)


def welch(x: np.ndarray, y: np.ndarray | None, rate: float, size: int = 256):
    """Frequencies and power of x, or the coherence of x and y."""
    size = max(2, min(size, len(x) // 4 or len(x)))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    part = lambda v: np.array([np.fft.rfft((s := v[i : i + size]) * w - s.mean() * w) for i in range(0, len(v) - size + 1, size // 2)])
    freq, a = np.fft.rfftfreq(size, 1 / rate), part(x)
    power = (np.abs(a) ** 2).mean(0) / (rate * (w**2).sum())
    if y is None:
        return freq, power
    b = part(y)
    return freq, np.abs((a.conj() * b).mean(0)) ** 2 / np.maximum((np.abs(a) ** 2).mean(0) * (np.abs(b) ** 2).mean(0), 1e-300)


def coherence(df: DataFrame, on: list[str], t: str, a: str, b: str, rate: float, bands: dict[str, tuple[float, float]], size: int = 256) -> DataFrame:
    """Mean magnitude-squared coherence of two series in bands."""
    schema = ", ".join(f"{n} {k}" for n, k in df.select(*on).dtypes) + "".join(f", {k} double" for k in bands)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        freq, c = welch(pdf[a].to_numpy(float), pdf[b].to_numpy(float), rate, size)
        mean = lambda lo, hi: float(c[m].mean()) if (m := (freq >= lo) & (freq < hi)).any() else None
        return pd.DataFrame([{o: pdf[o].iloc[0] for o in on} | {k: mean(*v) for k, v in bands.items()}])

    return df.select(*on, t, a, b).groupBy(*on).applyInPandas(run, schema)


def phase_null(df: DataFrame, on: list[str], t: str, a: str, b: str, draws: int, seed: int = 0) -> DataFrame:
    """Correlation of a and b against phase-randomised b; draws are rows, so they spread over tasks."""
    x = df.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(t, a, b))).alias("s")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 50))))
    schema = ", ".join(f"{n} {k}" for n, k in df.select(*on).dtypes) + ", observed double, hits long, n long"

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                u, v = (np.array([r[c] for r in rec["s"]], float) for c in (a, b))
                rng = np.random.default_rng([seed, int(rec["block"])])
                obs, spec = np.corrcoef(u, v)[0, 1], np.fft.rfft(v - v.mean())
                m = min(50, draws - 50 * int(rec["block"]))
                turn = np.exp(2j * np.pi * rng.random((m, len(spec))))
                null = np.fft.irfft(spec * turn, len(v), axis=1)
                c = (null - null.mean(1)[:, None]) @ (u - u.mean()) / (len(u) * null.std(1) * u.std())
                rows.append({o: rec[o] for o in on} | {"observed": obs, "hits": int((c >= obs).sum()), "n": m})
            yield pd.DataFrame(rows, columns=[*on, "observed", "hits", "n"])

    g = x.select(*on, "s", "block").mapInPandas(run, schema).groupBy(*on).agg(F.first("observed").alias("observed"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return g.select(*on, "observed", ((1 + F.col("hits")) / (1 + F.col("n"))).alias("p"))


def top_features(df: DataFrame, label: str, features: list[str], k: int) -> DataFrame:
    """The k features of the best single-feature AUC, either direction."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(label, "x.*").where("v is not null")
    auc = roc_auc(long, ["feature"], "v", F.col(label) == 1)
    return auc.withColumn("strength", F.greatest("auc", 1 - F.col("auc"))).orderBy(F.desc("strength"), "feature").limit(k)


def leave_group_out(df: DataFrame, group: str, label: str, features: list[str], strength: float = 0.01) -> DataFrame:
    """Scores of an L1 logistic model fitted without the row's own group.

    Medians fill missing values and features are scaled; one Spark ML fit a group.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = [f"_{f}" for f in features]
    model = Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="features"),
        LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=strength, maxIter=50),
    ])
    x = df.select(group, label, *[F.col(f).cast("double").alias(f) for f in features])
    out = []
    for (g,) in x.select(group).distinct().orderBy(group).collect():  # a few groups, by contract
        own = x.where(F.col(group).eqNullSafe(F.lit(g)))
        out.append(model.fit(x.where(~F.col(group).eqNullSafe(F.lit(g)))).transform(own).select(group, label, vector_to_array("probability")[1].alias("score")))
    from lamina.operators.stats import union_all

    return union_all(out)


def column_rank(df: DataFrame, part: list[str], v: str) -> DataFrame:
    """Rank of a value in its column from 0 to 1, and its share of the column's maximum."""
    w = Window.partitionBy(*part)
    return df.withColumn("rank01", F.percent_rank().over(w.orderBy(v))).withColumn("of_max", F.col(v) / F.nullif(F.max(v).over(w), F.lit(0.0)))
