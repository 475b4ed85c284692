"""Peaks and point events: detection, network events, shapes, coincidence and responses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.relational import band_join
from lamina.operators.series import add_group, over, sessions


def peak_candidates(df: DataFrame, on: list[str], f: str = "f") -> DataFrame:
    """Local maxima in row order, plateaus at the middle row: ``i`` from 1, ``t, f``.

    Equal neighbours form an island; it is a peak if it is above the islands on both sides.
    """
    w = over(on)
    x = df.withColumn("i", F.row_number().over(w)).withColumn("_new", F.when(F.col(f) == F.lag(f).over(w), 0).otherwise(1))
    x = x.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isle = x.groupBy(*on, "_isle").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first(f).alias(f))
    v = Window.partitionBy(*on).orderBy("_isle")
    top = isle.where(F.col(f).isNotNull()).withColumn("_p", F.lag(f).over(v)).withColumn("_n", F.lead(f).over(v)).where((F.col(f) > F.col("_p")) & (F.col(f) > F.col("_n")))
    mid = top.select(*on, F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("i"))
    return x.join(mid, [*on, "i"]).select(*on, "i", "t", f)


def detect_peaks(df: DataFrame, on: list[str], f: str = "f", distance: int = 5, share: float | None = 0.2, prominence: str | None = None, height: str | None = None) -> DataFrame:
    """Peaks with a least height, a least distance and a least prominence, in this order.

    Of peaks closer than ``distance`` rows the higher stays (the later of equal ones).  Prominence
    is the height above the higher of the two lowest points between the peak and the next
    higher sample (or the end) on either side; the least is ``share`` of the group's range or the
    column ``prominence``.  ``height`` names a column of least heights.  One series of one key is
    handled in one task, as the greedy choice needs its order: ``on, i, t, f, prominence``.
    """
    extra = [c for c in (prominence, height) if c]
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*on, "t", f).dtypes) + ", i int, prominence double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        x = pdf[f].to_numpy(float)
        n = len(x)
        head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if n else np.zeros(0, int)
        tail = np.r_[head[1:] - 1, n - 1] if n else head
        y = x[head]
        top = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1 if len(y) > 2 else np.zeros(0, int)
        peaks = (head[top] + tail[top]) // 2
        if height:
            peaks = peaks[x[peaks] >= pdf[height].to_numpy(float)[peaks]]
        keep = np.ones(len(peaks), bool)
        for j in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[j]:
                near = np.abs(peaks - peaks[j]) < distance
                near[j] = False
                keep &= ~near
        peaks = peaks[keep]
        prom = []
        for p in peaks:
            left = np.flatnonzero(x[:p] > x[p])
            right = np.flatnonzero(x[p + 1 :] > x[p])
            a, b = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] if len(right) else n)
            prom.append(x[p] - max(x[a : p + 1].min(), x[p:b].min()))
        prom = np.array(prom, float)
        least = pdf[prominence].to_numpy(float)[peaks] if prominence else (share or 0.0) * (x.max() - x.min() if n else 0)
        ok = prom >= least
        out = pdf.loc[peaks[ok], [*on, "t", f]].copy()
        out["i"], out["prominence"] = (peaks[ok] + 1).astype(np.int32), prom[ok]
        return out

    return df.where(F.col(f).isNotNull()).select(*on, "t", f, *[c for c in extra if c not in (*on, "t", f)]).groupBy(*on).applyInPandas(run, schema)


def prominences(df: DataFrame, on: list[str], f: str = "f") -> DataFrame:
    """Candidates with their prominences by array functions, for series that fit in a row."""
    series = df.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", f))), lambda s: s[f]).alias("_x"))
    c = peak_candidates(df, on, f).join(series, on)
    x, v = F.col("_x"), F.col(f)
    n = F.size(x)
    idx = F.sequence(F.lit(1), n)
    left = F.coalesce(F.array_max(F.filter(idx, lambda k: (k < F.col("i")) & (F.get(x, k - 1) > v))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(idx, lambda k: (k > F.col("i")) & (F.get(x, k - 1) > v))), n + 1)
    c = c.withColumn("_l", left).withColumn("_r", right)
    low = lambda a, b: F.array_min(F.slice(x, a, b - a + 1))
    return c.withColumn("prominence", v - F.greatest(low(F.col("_l") + 1, F.col("i")), low(F.col("i"), F.col("_r") - 1))).drop("_x", "_l", "_r")


def network_events(events: DataFrame, on: list[str], region: str, t: str, gap: float, share: float = 0.8) -> DataFrame:
    """Events of all regions that gaps of at most ``gap`` link: onset, participants, leader and kind.

    The leader has the earliest event (the least name at a tie); an event is global if at least
    max(2, ceil(share * regions)) take part, isolated if one does, else partial.
    """
    n = events.groupBy(*on).agg(F.count_distinct(region).alias("n_regions"))
    s = sessions(events, on, t, gap, "net")
    per = s.groupBy(*on, "net", region).agg(F.min(t).alias("first"))
    e = per.groupBy(*on, "net").agg(F.min("first").alias("onset"), F.max("first").alias("last"), F.count("*").alias("n_participants"), F.min(F.struct("first", region)).alias("_m"), F.array_join(F.array_sort(F.collect_list(region)), ";").alias("participants"))
    need = F.greatest(F.lit(2), F.ceil(share * F.col("n_regions")))
    kind = F.when(F.col("n_participants") == 1, "isolated").when(F.col("n_participants") >= need, "global").otherwise("partial")
    return e.join(n, on).select(*on, "net", "onset", "n_participants", F.col(f"_m.{region}").alias("leader"), "participants", kind.alias("kind"), (F.col("last") - F.col("onset")).alias("spread"))


def onset_delta(events: DataFrame, on: list[str], region: str, t: str, gap: float, a: str, b: str) -> DataFrame:
    """In network events where both ends fire: first time of b minus that of a, and who leads."""
    s = sessions(events, on, t, gap, "net")
    d = s.groupBy(*on, "net").agg(F.min(F.when(F.col(region) == a, F.col(t))).alias("ta"), F.min(F.when(F.col(region) == b, F.col(t))).alias("tb")).where("ta is not null and tb is not null")
    delta = F.col("tb") - F.col("ta")
    return d.select(*on, "net", delta.alias("delta"), F.when(delta > 0, "a_first").when(delta < 0, "b_first").otherwise("tie").alias("order"))


def independent_fraction(a: DataFrame, b: DataFrame, on: list[str], t: str, window: float) -> DataFrame:
    """Share of a's events without an event of b within ``window``, by key."""
    x, y = a.select(*on, F.col(t).alias("_t")), b.select(*on, F.col(t).alias("_s")).distinct()
    lone = band_join(x.distinct(), y, on, "_t", "_s", -window, window, "left_anti").select(*on, "_t", F.lit(1).alias("_lone"))
    return x.join(lone, [*on, "_t"], "left").groupBy(*on).agg(F.count("*").alias("n"), F.avg(F.coalesce("_lone", F.lit(0))).alias("independent"))


def event_shapes(events: DataFrame, trace: DataFrame, on: list[str], f: str, before: int, after: int) -> DataFrame:
    """Amplitude over the least value before the peak, 10-90 rise, half decay, decay constant and area.

    ``events`` has ``on, t``.  Rise counts steps between the last samples at or below 10 and 90 % of
    the amplitude before the peak; half decay steps to the first sample at or below half of it
    after; the constant is -1 / slope of the log of the decay while it is above 10 %.
    """
    s = trace.select(*on, F.col("t").alias("s"), F.col(f).alias("y"))
    p = band_join(events.select(*on, "t"), s, on, "t", "s", -before, after)
    base = p.groupBy(*on, "t").agg(F.min(F.when(F.col("s") < F.col("t"), F.col("y"))).alias("base"), F.max(F.when(F.col("s") == F.col("t"), F.col("y"))).alias("peak")).where("base < peak")
    p = p.join(base, [*on, "t"]).withColumn("u", (F.col("y") - F.col("base")) / (F.col("peak") - F.col("base"))).withColumn("k", F.col("s") - F.col("t"))
    last = lambda q: F.max(F.when((F.col("k") < 0) & (F.col("u") <= q), F.col("k")))
    fall = F.when((F.col("k") >= 0) & (F.col("u") > 0.1), F.log("u"))
    g = p.groupBy(*on, "t").agg(
        F.first("peak").alias("_p"), F.first("base").alias("_b"), last(0.1).alias("k10"), last(0.9).alias("k90"),
        F.min(F.when((F.col("k") > 0) & (F.col("u") <= 0.5), F.col("k"))).alias("half_decay"), F.regr_slope(fall, F.when(fall.isNotNull(), F.col("k"))).alias("_s"),
        F.sum(F.when(F.col("k") >= 0, F.col("y") - F.col("base")).otherwise(0.0)).alias("area"), F.count("*").alias("samples"),
    )
    return g.select(*on, "t", (F.col("_p") - F.col("_b")).alias("amplitude"), (F.col("k90") - F.col("k10")).alias("rise"), "half_decay", F.when(F.col("_s") < 0, -1 / F.col("_s")).alias("tau"), "area", (F.col("samples") < before + after + 1).alias("truncated"))


def event_mask(trace: DataFrame, events: DataFrame, on: list[str], f: str, before: int, after: int, noise: float) -> DataFrame:
    """Samples in [t - before, t + after] of an event, or above median + 3 noise dilated by one row."""
    near = band_join(trace.select(*on, "t"), events.select(*on, F.col("t").alias("s")), on, "t", "s", -after, before, "left_semi").select(*on, "t", F.lit(True).alias("_near"))
    x = add_group(trace, on, m=F.median(f)).withColumn("_hot", (F.col(f) > F.col("m") + 3 * noise).cast("int"))
    x = x.withColumn("_hot", F.max("_hot").over(over(on).rowsBetween(-1, 1)))
    return x.join(near, [*on, "t"], "left").select(*on, "t", f, (F.coalesce("_near", F.lit(False)) | (F.col("_hot") == 1)).alias("masked"))


def responses(trace: DataFrame, frames: DataFrame, on: list[str], f: str, q: float = 0.95) -> DataFrame:
    """Response at frames: the largest value in [t - 2, t + 8] minus the median of [t - 16, t - 2], and
    whether it passes the q quantile of the same measure over all frames of the trace."""
    s = trace.select(*on, F.col("t").alias("s"), F.col(f).alias("y"))
    p = band_join(trace.select(*on, "t"), s, on, "t", "s", -16, 8)
    k = F.col("s") - F.col("t")
    m = p.groupBy(*on, "t").agg((F.max(F.when(k >= -2, F.col("y"))) - F.median(F.when(k <= -2, F.col("y")))).alias("response"))
    m = add_group(m, on, cut=F.percentile("response", q))
    return m.join(frames.select(*on, "t"), [*on, "t"], "left_semi").select(*on, "t", "response", (F.col("response") > F.col("cut")).alias("responds"))


def event_rate(events: DataFrame, on: list[str], minutes: float) -> DataFrame:
    return events.groupBy(*on).agg(F.count("*").alias("n"), (F.count("*") / F.lit(minutes)).alias("rate"))


def block_activity(events: DataFrame, on: list[str], t: str, size: float, blocks: int) -> DataFrame:
    """Share of blocks that hold an event."""
    return events.groupBy(*on).agg((F.count_distinct(F.floor(F.col(t) / size)) / float(blocks)).alias("share"))
