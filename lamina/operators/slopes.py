"""The median slope of all pairs of a group's rows, without a row for each pair of a large group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.readers import staged

#: Rows of a block; two blocks meet in one task.
BLOCK = 65_536
#: Pairs of a group, or of what is left of it, that become rows.
DIRECT = 1 << 18
#: Cuts of a bracket in one pass, and the first ones in units of the spread around the least-squares slope.
CUTS = 31
FIRST = sorted([0.0, *[sign * 10 ** (k / 2) for k in range(-9, 6) for sign in (-1.0, 1.0)]])
#: Rows below which pairs inside a block are compared one by one.
LEAF = 256


def _parts(x: np.ndarray, y: np.ndarray):
    """Pairs of parts of a block sorted by x that hold each of its pairs once; both None: a part with itself."""
    if len(x) <= LEAF:
        yield (x, y), None
        return
    m = len(x) // 2
    yield (x[:m], y[:m]), (x[m:], y[m:])
    yield from _parts(x[:m], y[:m])
    yield from _parts(x[m:], y[m:])


def _met(sides: pa.Table):
    """Pairs of parts of one or two blocks of a group, the one of lesser x first."""
    blocks = sorted(((np.frombuffer(r["xs"]), np.frombuffer(r["ys"])) for r in sides.select(["xs", "ys"]).to_pylist()), key=lambda b: (b[0][0], b[0][-1]))
    return [(blocks[0], blocks[1])] if len(blocks) == 2 else _parts(*blocks[0])


def _under(a, b, cut: float) -> int:
    """Pairs whose slope is below the cut: their residuals from a line of that slope are in falling order."""
    za = a[1] - cut * a[0]
    if b is None:
        return int(((za[None, :] < za[:, None]) & (a[0][None, :] > a[0][:, None])).sum())
    zb = b[1] - cut * b[0]
    n = int(np.searchsorted(np.sort(zb), za).sum())
    if a[0][-1] == b[0][0]:  # rows of equal x make no slope
        n -= int(np.searchsorted(np.sort(zb[b[0] == b[0][0]]), za[a[0] == a[0][-1]]).sum())
    return n


def _between(a, b, lo: float, hi: float) -> list[np.ndarray]:
    """The slopes of the pairs that ``_under`` counts for hi and not for lo."""
    z = lambda side, cut: side[1] - cut * side[0]
    rows = np.arange(len(a[0]))
    if b is not None:  # which rows have any: another place among b's residuals
        under = [np.searchsorted(np.sort(z(b, c)), z(a, c)) if np.isfinite(c) else np.full(len(rows), n) for c, n in ((lo, 0), (hi, len(b[0])))]
        rows = np.flatnonzero(under[0] != under[1])
    b, out = b or a, [np.zeros(0)]
    low, high = ((z(a, c), z(b, c)) if np.isfinite(c) else None for c in (lo, hi))
    for i in range(0, len(rows), 64):
        at = rows[i : i + 64]
        hit = b[0][None, :] > a[0][at, None]
        if low is not None:
            hit &= low[1][None, :] >= low[0][at, None]
        if high is not None:
            hit &= high[1][None, :] < high[0][at, None]
        p, q = np.nonzero(hit)
        out.append((b[1][q] - a[1][at][p]) / (b[0][q] - a[0][at][p]))
    return out


def _blocks(rows: DataFrame, on: list[str], size: int) -> DataFrame:
    """Rows ``on, block, xs, ys`` of at most ``size`` points of a group, neighbours in x."""
    def run(batches):
        no, key, held, n = TaskContext.get().partitionId() << 32, None, [], 0

        def out():
            t = pa.concat_tables(held).combine_chunks()
            cols = [t[c].combine_chunks().slice(0, 1) for c in on]
            return pa.RecordBatch.from_arrays([*cols, pa.array([no], pa.int64()), *[pa.array([t[c].to_numpy().tobytes()], pa.binary()) for c in ("_x", "_y")]], [*on, "block", "xs", "ys"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            turns = np.zeros(len(t), bool)
            for c in on:
                col = t[c].combine_chunks()
                turns[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *np.flatnonzero(turns).tolist(), len(t)]
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                own = [t[c][i].as_py() for c in on]
                while i < j:
                    if held and (own != key or n >= size):
                        yield out()
                        no, held, n = no + 1, [], 0
                    k = min(j, i + size - n)
                    held.append(t.slice(i, k - i))
                    key, n, i = own, n + k - i, k
        if held:
            yield out()

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in on)
    return rows.repartitionByRange(*on, "_x").sortWithinPartitions(*on, "_x").mapInArrow(run, f"{kinds}, block long, xs binary, ys binary")


def _pairs(blocks: DataFrame, on: list[str], told: DataFrame) -> DataFrame:
    """The blocks of ``told`` groups, once for each pair ``a, b`` of them; a pair of equal ones has one row."""
    a, b = blocks.select(*on, F.col("block").alias("a")), blocks.select(*on, F.col("block").alias("b"))
    both = a.join(b, on).where("a <= b").join(told, on)
    return both.withColumn("block", F.explode(F.array_distinct(F.array("a", "b")))).join(blocks.drop(*on), "block")


def theil_sen(df: DataFrame, on: list[str], x: str, y: str, direct: int = DIRECT, block: int = BLOCK) -> DataFrame:
    """The median slope of all pairs of a group's rows with different x: ``slope, pairs``.

    Pairs of a group of at most ``direct`` are rows.  Of larger groups, pairs with slopes below a few cuts are counted block against
    block, as pairs out of order by their distance from a line, and the bracket that holds the median is cut again until at most
    ``direct`` / 16 pairs are inside; these are rows.  Nothing is estimated.  If more pairs than that share one slope, the bracket ends at 1e-14 of the
    spread.  Slopes of rows without y are left out, and their pairs counted.  Values must be finite.
    """
    rows = df.select(*on, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=[*on, "_x"])
    rows = staged(rows, "points")
    whole = lambda c: F.shiftright(F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c)), 1)
    ties = rows.groupBy(*on, "_x").agg(F.count("*").alias("_n"), F.count("_y").alias("_m"))
    known = rows.where("_y is not null")
    fit = known.groupBy(*on).agg(F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("_b"), F.coalesce(F.stddev_pop("_y") / F.nullif(F.stddev_pop("_x"), F.lit(0.0)), F.lit(0.0)).alias("_s"))
    groups = ties.groupBy(*on).agg(whole("_n").alias("pairs"), whole("_m").alias("_all")).where("pairs > 0").join(fit, on, "left")
    groups = staged(groups.withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)), "groups")
    small = known.join(groups.where(F.col("_all") <= direct).select(*on), on, "left_semi")
    other = small.select(*on, F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    plain = small.join(other, on).where("_x2 > _x").groupBy(*on).agg(F.median((F.col("_y2") - F.col("_y")) / (F.col("_x2") - F.col("_x"))).alias("slope"))
    state = groups.where(F.col("_all") > direct).select(*on, "_all", "_b", "_s", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("_all").alias("inside"))
    if state.isEmpty():
        return groups.join(plain, on, "left").select(*on, "slope", "pairs")
    blocks = staged(_blocks(known.join(state.select(*on), on, "left_semi"), on, block), "blocks")
    inf, first, last = F.lit(float("inf")), F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    open_lo, open_hi, width = F.col("lo") == -inf, F.col("hi") == inf, F.col("hi") - F.col("lo")
    most = direct // 16
    more = (F.col("inside") > most) & (open_lo | open_hi | (width > 1e-14 * F.greatest(F.abs("lo"), F.abs("hi"), "_s")))
    steps = F.array(*[F.lit(float(i)) for i in range(1, CUTS + 1)])
    far = lambda i: F.col("_s") * F.pow(F.lit(4.0), i)
    cuts = F.when(open_lo & open_hi, F.transform(F.array(*map(F.lit, FIRST)), lambda g: F.col("_b") + F.col("_s") * g)) \
        .when(open_lo, F.array_sort(F.transform(steps, lambda i: F.col("hi") - far(i)))).when(open_hi, F.transform(steps, lambda i: F.col("lo") + far(i))) \
        .otherwise(F.transform(steps, lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * (i / (CUTS + 1))))

    def count(sides: pa.Table) -> pa.Table:
        at, parts = sides["cuts"][0].as_py(), list(_met(sides))
        n = [sum(_under(a, b, c) for a, b in parts) for c in at]
        return pa.table([*[pa.concat_arrays([sides[c].combine_chunks().slice(0, 1)] * len(at)) for c in on], pa.array(at, pa.float64()), pa.array(n, pa.int64())], [*on, "cut", "n"])

    def list_inside(sides: pa.Table) -> pa.Table:
        lo, hi = sides["lo"][0].as_py(), sides["hi"][0].as_py()
        found = np.concatenate([s for a, b in _met(sides) for s in _between(a, b, lo, hi)])
        return pa.table([*[pa.concat_arrays([sides[c].combine_chunks().slice(0, 1)] * len(found)) if len(found) else sides[c].combine_chunks().slice(0, 0) for c in on], pa.array(found, pa.float64())], [*on, "slope"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in on)
    while True:
        todo = state.where(more)
        if todo.isEmpty():
            break
        told = todo.select(*on, cuts.alias("cuts"))
        n = _pairs(blocks, on, told).groupBy("a", "b").applyInArrow(count, f"{kinds}, cut double, n long").groupBy(*on, "cut").agg(F.sum("n").alias("n"))
        x = n.join(todo, on)
        # Cuts below both middle slopes, and above both.
        lower = F.max(F.when(F.col("n") < first, F.struct("cut", "n")))
        upper = F.min(F.when(F.col("n") >= last, F.struct("cut", "n")))
        new = x.groupBy(*on, "_all", "_b", "_s", "lo", "hi", "below", "inside").agg(lower.alias("_l"), upper.alias("_u"))
        top = F.coalesce("_u.n", F.col("below") + F.col("inside"))
        new = new.select(*on, "_all", "_b", "_s", F.coalesce("_l.cut", "lo").alias("lo"), F.coalesce("_u.cut", "hi").alias("hi"), F.coalesce("_l.n", "below").alias("below"), (top - F.coalesce("_l.n", "below")).alias("inside"))
        state = staged(state.where(~more).unionByName(new), "brackets")
    tied = state.where(F.col("inside") > most).select(*on, ((F.col("lo") + F.col("hi")) / 2).alias("slope"))
    left = state.where(F.col("inside") <= most)
    slopes = _pairs(blocks, on, left.select(*on, "lo", "hi")).groupBy("a", "b").applyInArrow(list_inside, f"{kinds}, slope double")
    ranked = slopes.join(left.select(*on, "below", "_all"), on).withColumn("_i", F.row_number().over(Window.partitionBy(*on).orderBy("slope")) + F.col("below"))
    middle = ranked.where((F.col("_i") == first) | (F.col("_i") == last)).groupBy(*on).agg(F.avg("slope").alias("slope"))
    return groups.join(plain.unionByName(middle).unionByName(tied), on, "left").select(*on, "slope", "pairs")
