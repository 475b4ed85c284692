"""One row of metrics for each run: coupling, events, lead, lag, states and noise of its regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import events as ev
from lamina.operators import series
from lamina.sources.readers import staged

RUN = ["run"]
REGION = ["run", "region"]
#: Cells that a region's halves and its core must have.
LEAST_HALVES, LEAST_CORE = 8, 20
LAGS = 30


def region_traces(vox: DataFrame) -> DataFrame:
    """Mean traces of regions: ``run, region, kind, t, f``, kinds ``full``, ``core``, ``a`` and ``b``.

    ``vox``: ``run, region, cell, t, v`` and a boolean ``core``.  The core is the whole region where it has too few cells.  ``a`` and ``b`` are halves of the cells, dealt
    in turns in the order of a hash; regions of too few cells have none.
    """
    cells = vox.select(*REGION, "cell", "core").distinct()
    order = Window.partitionBy(*REGION).orderBy(F.xxhash64("cell"), "cell")
    each = Window.partitionBy(*REGION)
    dealt = cells.select(*REGION, "cell", "core", (F.row_number().over(order) % 2 == 1).alias("_a"), F.count("*").over(each).alias("_n"), F.sum(F.col("core").cast("int")).over(each).alias("_c"))
    x = vox.select(*REGION, "cell", "t", "v").join(dealt, [*REGION, "cell"])
    halves = F.col("_n") >= LEAST_HALVES
    use = {"full": F.lit(True), "core": F.col("core") | (F.col("_c") < LEAST_CORE), "a": halves & F.col("_a"), "b": halves & ~F.col("_a")}
    means = x.groupBy(*REGION, "t").agg(*[F.avg(F.when(c, F.col("v"))).alias(k) for k, c in use.items()])
    return means.select(*REGION, "t", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("f")) for k in use])).alias("_x")).select(*REGION, "_x.kind", "t", "_x.f").where("f is not null")


def near(a: DataFrame, b: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs ``run, t, s`` of frames of a and b at most the run's ``window`` apart.

    Each frame of a is spread over its window and meets b by equality, so only pairs that count are made.
    """
    spread = a.select(*RUN, "t").distinct().join(windows, RUN).select(*RUN, "t", F.explode(F.sequence(F.col("t") - F.col("window"), F.col("t") + F.col("window"))).alias("s"))
    return spread.join(b.select(*RUN, F.col("t").alias("s")).distinct(), [*RUN, "s"]).select(*RUN, "t", "s")


def draw_shifts(runs: DataFrame, draws: int, seed: int) -> DataFrame:
    """``run, draw, shift``: so many shifts from ``least`` to below ``n_frames - least``, the same on every run of the job."""
    room = F.col("n_frames") - 2 * F.col("least")
    some = runs.where((F.col("n_frames") >= 4) & (room >= 1)).select(*RUN, "least", room.alias("_room"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return some.select(*RUN, "draw", (F.col("least") + F.pmod(F.xxhash64(F.lit(seed), "run", "draw"), F.col("_room"))).alias("shift"))


def independence_null(src: DataFrame, ref: DataFrame, runs: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Chance of the share of src events without a ref event near: ``run, observed, null_mean, p``.

    ``runs``: ``run, n_frames, window, least``.  Ref events are moved around the recording by drawn shifts.  ``observed`` is the share as it is; p = (1 + draws with a share
    as low) / (1 + draws).  Each src event looks up one frame for each draw among the frames near a ref event, so work grows with events, not pairs.
    Runs without events of both kinds, or too short to shift, are left out.
    """
    s, r = src.select(*RUN, "t").distinct(), ref.select(*RUN, "t").distinct()
    n = s.groupBy(*RUN).agg(F.count("*").alias("_n")).join(r.select(*RUN).distinct(), RUN)
    hit = near(s, r, runs.select(*RUN, "window")).select(*RUN, "t").distinct().groupBy(*RUN).agg(F.count("*").alias("_hit"))
    around = r.join(runs, RUN).select(*RUN, "n_frames", F.explode(F.sequence(F.col("t") - F.col("window"), F.col("t") + F.col("window"))).alias("_s")).select(*RUN, F.pmod("_s", "n_frames").alias("at")).distinct()
    shifts = draw_shifts(runs, draws, seed).join(n, RUN)
    moved = s.join(shifts, RUN).join(runs.select(*RUN, "n_frames"), RUN).select(*RUN, "draw", F.pmod(F.col("t") - F.col("shift"), F.col("n_frames")).alias("at"))
    found = moved.join(around, [*RUN, "at"]).groupBy(*RUN, "draw").agg(F.count("*").alias("_c"))
    observed = 1 - F.coalesce("_hit", F.lit(0)) / F.col("_n")
    each = shifts.join(found, [*RUN, "draw"], "left").join(hit, RUN, "left").select(*RUN, observed.alias("observed"), (1 - F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("_share"))
    return each.groupBy(*RUN).agg(F.first("observed").alias("observed"), F.avg("_share").alias("null_mean"), ((1 + F.sum((F.col("_share") <= F.col("observed") + 1e-12).cast("int"))) / (1 + draws)).alias("p"))


def metric_rows(vox: DataFrame, regions: DataFrame, runs: DataFrame, states: DataFrame, window_s: float = 0.4, share: float = 0.2, draws: int = 1000, block: int = 30) -> DataFrame:
    """The metric row of each run.

    Args: ``vox``: ``run, region, cell, t, v, core``, frames counted from 0.  ``regions``: ``run, region, compartment`` (soma, trunk or branch) and ``place`` along the scan.  ``runs``: ``run, rate`` (frames
    a second, null if unknown) and ``deep_first``.  ``states``: ``run, t`` and boolean ``active``, without rows where unknown.
    The reference is the first soma region, else the trunk region nearest the soma's end (least place if ``deep_first``, else largest), which then is no trunk region.
    Traces are dF/F over the tenth percentile.  Events are peaks of a least prominence of ``share`` of the range and 5 frames apart; they coincide within ``window_s``
    seconds (2 frames if the rate is unknown).  Chance levels move events by at least 20 s, or 5 windows.  The state counts if it is active in over 0.1 and
    under 0.9 of the frames.

    A run without soma or trunk has a ``note`` and nulls but for its state, as has one without branches for its branch metrics.  Runs without frames are left out.
    """
    compartments = regions.select(*REGION, "compartment", "place")
    soma = compartments.where("compartment = 'soma'").groupBy(*RUN).agg(F.min("region").alias("_soma"))
    ends = compartments.where("compartment = 'trunk'").groupBy(*RUN).agg(F.min_by("region", F.struct("place", "region")).alias("_first"), F.max_by("region", F.struct("place", -F.col("region"))).alias("_last"))
    ref = runs.join(soma, RUN, "left").join(ends, RUN, "left").select(*RUN, "rate", F.coalesce("_soma", F.when(F.col("deep_first"), F.col("_first")).otherwise(F.col("_last"))).alias("ref"), F.when(F.col("_soma").isNotNull(), "soma").when(F.col("_first").isNotNull(), "proximal_trunk").alias("reference"))
    raw = staged(region_traces(vox), "traces")
    size = raw.where("kind = 'full'").groupBy(*RUN).agg((F.max("t") + 1).alias("n_frames"), F.count_distinct("region").alias("n_regions"))
    known = F.col("rate") > 0
    per_run = ref.join(size, RUN).withColumn("window", F.when(known, F.greatest(F.lit(1), F.round(window_s * F.col("rate")).cast("int"))).otherwise(2))
    per_run = staged(per_run.withColumn("least", F.when(known, F.floor(20 * F.col("rate")).cast("int")).otherwise(F.greatest(5 * F.col("window"), F.lit(1)))), "runs")
    dff = series.dff(raw, [*REGION, "kind"]).select(*REGION, "kind", "t", "f", "dff")
    role = compartments.join(per_run.select(*RUN, "ref"), RUN).select(*REGION, F.when(F.col("region") == F.col("ref"), "ref").otherwise(F.col("compartment")).alias("role"))
    x = staged(dff.join(role, REGION), "dff")

    halves = x.where("kind in ('a', 'b')").groupBy(*REGION, "t").agg(F.max(F.when(F.col("kind") == "a", F.col("dff"))).alias("_a"), F.max(F.when(F.col("kind") == "b", F.col("dff"))).alias("_b")).groupBy(*REGION).agg(F.corr("_a", "_b").alias("_r"))
    reliability = staged(halves.select(*REGION, F.when(F.col("_r") > -0.99, 2 * F.col("_r") / (1 + F.col("_r"))).alias("rel")), "reliability")

    def against_ref(kind: str, name: str) -> DataFrame:
        own = x.where(F.col("kind") == kind)
        return own.where("role <> 'ref'").join(own.where("role = 'ref'").select(*RUN, "t", F.col("dff").alias("_ref")), [*RUN, "t"]).groupBy(*REGION, "role").agg(F.corr("dff", "_ref").alias(name))

    rel_of_ref = reliability.join(role.where("role = 'ref'"), REGION).select(*RUN, F.col("rel").alias("_rel"))
    pairs = against_ref("full", "r").join(against_ref("core", "r_core").drop("role"), REGION).join(reliability, REGION, "left").join(rel_of_ref, RUN, "left")
    pairs = pairs.withColumn("r_true", F.when((F.col("rel") > 0) & (F.col("_rel") > 0), F.least(F.lit(1.0), F.col("r") / F.sqrt(F.col("rel") * F.col("_rel")))))
    of = lambda role, c: F.avg(F.when(F.col("role") == role, F.col(c)))
    coupling = pairs.groupBy(*RUN).agg(of("branch", "r").alias("r_soma_branch"), of("branch", "r_core").alias("r_soma_branch_core"), of("branch", "r_true").alias("r_soma_branch_corr"), of("trunk", "r_true").alias("r_soma_trunk_corr"))

    full = x.where("kind = 'full'")
    wide = staged(full.groupBy(*RUN, "t").agg(of("ref", "dff").alias("ref"), of("trunk", "dff").alias("trunk"), of("branch", "dff").alias("branch")), "wide")
    means = wide.groupBy(*RUN).agg(F.corr("ref", "trunk").alias("r_soma_trunk"), F.corr("trunk", "branch").alias("r_trunk_branch"), F.avg("ref").alias("_mr"), F.avg("branch").alias("_mb"))
    centred = wide.join(means, RUN).select(*RUN, "t", (F.col("ref") - F.col("_mr")).alias("a"), (F.col("branch") - F.col("_mb")).alias("b"))
    lag = series.best_lag(series.cross_correlation(centred, RUN, "a", "b", LAGS), RUN).select(*RUN, F.col("lag").alias("lag_frames"))

    gate = wide.join(states, [*RUN, "t"]).withColumn("_on", F.col("active"))
    split = gate.groupBy(*RUN).agg(F.avg(F.col("_on").cast("int")).alias("frac_active"), *[F.corr(F.when(c, F.col("ref")), F.when(c, F.col("branch"))).alias(k) for k, c in (("r_active", F.col("_on")), ("r_quiet", ~F.col("_on")))])
    gated = (F.col("frac_active") > 0.1) & (F.col("frac_active") < 0.9)
    split = split.select(*RUN, "frac_active", *[F.when(gated, F.col(c)).alias(c) for c in ("r_active", "r_quiet")])

    events = staged(ev.detect_peaks(full.select(*REGION, "t", "dff"), REGION, "dff", 5, share).select(*REGION, "t").join(role, REGION), "events")
    counts = role.join(events.groupBy(*REGION).agg(F.count("*").alias("_n")), REGION, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    minutes = F.when(known, F.col("n_frames") / F.col("rate") / 60)
    rates = counts.groupBy(*RUN).agg(*[of(k, "_n").alias(f"_e_{k}") for k in ("ref", "trunk", "branch")]).join(per_run, RUN).select(*RUN, *[(F.col(f"_e_{k}") / minutes).alias(f"rate_{k}_per_min") for k in ("ref", "trunk", "branch")])
    a, b = (events.where(F.col("role") == k).select(*RUN, "t").distinct() for k in ("ref", "branch"))
    number = lambda e, name: e.groupBy(*RUN).agg(F.count("*").alias(name))
    chance = per_run.select(*RUN, "n_frames", "window", "least")
    meet = staged(near(a, b, per_run.select(*RUN, "window")), "near")
    shared = meet.groupBy(*RUN).agg(F.count_distinct("t").alias("_a_near"), F.count_distinct("s").alias("_b_near"))
    null = lambda e, o, seed, k: independence_null(e, o, chance, draws, seed).select(*RUN, F.col("null_mean").alias(f"frac_{k}_independent_null"), F.col("p").alias(f"p_{k}_coupled"))
    nearest = meet.groupBy(*RUN, "t").agg(F.min(F.struct(F.abs(F.col("s") - F.col("t")).alias("d"), "s")).alias("_m")).select(*RUN, (F.col("_m.s") - F.col("t")).alias("_d")).where("_d <> 0")
    lead = nearest.groupBy(*RUN).agg(F.count("*").alias("n_paired_events"), F.avg((F.col("_d") < 0).cast("int")).alias("branch_first_frac"))

    base = raw.where("kind = 'full'").join(role, REGION)
    each = base.groupBy(*REGION, "role").agg(F.avg("f").alias("_f")).groupBy(*RUN).agg(of("ref", "_f").alias("ref_f_raw"), of("branch", "_f").alias("branch_f_raw"))
    noise = series.robust_noise(full.where("role = 'ref'").select(*RUN, "t", "dff"), RUN, "dff")
    snr = full.where("role = 'ref'").groupBy(*RUN).agg(F.percentile("dff", 0.99).alias("_top")).join(noise, RUN).select(*RUN, (F.col("_top") / F.nullif(F.col("noise"), F.lit(0.0))).alias("ref_snr"))
    fading = series.block_trend(base.where("role = 'ref'").select(*RUN, "t", "f"), RUN, "f", block).select(*RUN, F.col("trend").alias("bleaching"))
    parts = [coupling, means.drop("_mr", "_mb"), lag, split, rates, number(a, "n_ref_events"), number(b, "n_branch_events"), shared, null(b, a, 0, "branch"), null(a, b, 1, "ref"), lead, each, snr, fading]
    row = reduce(lambda l, r: l.join(r, RUN, "left"), parts, per_run)
    branches = counts.where("role = 'branch'").select(*RUN).distinct().withColumn("_has", F.lit(True))
    row = row.join(branches, RUN, "left")
    note = F.when(F.col("ref").isNull(), "needs a soma or trunk region as the reference").when(F.col("_has").isNull(), "no branch region")
    without = lambda n, m: 1 - F.coalesce(F.col(m), F.lit(0)) / F.col(n)
    met = F.col("_has") & F.col("ref").isNotNull()
    n = lambda c: F.when(met, F.coalesce(c, F.lit(0))).alias(c)
    return row.select(
        *RUN, "n_frames", "n_regions", "rate", "window", "reference", note.alias("note"), "r_soma_branch", "r_soma_branch_core", "r_soma_branch_corr", "r_soma_trunk", "r_soma_trunk_corr", "r_trunk_branch",
        *[F.when(F.col("ref").isNotNull(), F.col(c)).alias(c) for c in ("rate_ref_per_min", "rate_trunk_per_min", "rate_branch_per_min")], n("n_ref_events"), n("n_branch_events"),
        F.when(met, without("n_branch_events", "_b_near")).alias("frac_branch_independent"), F.when(met, without("n_ref_events", "_a_near")).alias("frac_ref_independent"), F.when(met, F.coalesce("_a_near", F.lit(0)) / F.col("n_ref_events")).alias("frac_global"),
        "frac_branch_independent_null", "p_branch_coupled", "frac_ref_independent_null", "p_ref_coupled", n("n_paired_events"), "branch_first_frac", "lag_frames", "frac_active", "r_active", "r_quiet",
        "ref_f_raw", F.when(F.col("ref").isNotNull(), F.col("branch_f_raw")).alias("branch_f_raw"), "ref_snr", "bleaching")


def state_of(signals: DataFrame, names: list[str]) -> DataFrame:
    """``run, t, active``: any of the signals above its median of the run; null signals don't count."""
    cuts = signals.groupBy(*RUN).agg(*[F.median(c).alias(f"_{c}") for c in names])
    above: Column = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > F.col(f"_{c}"), F.lit(False)) for c in names])
    return signals.join(cuts, RUN).select(*RUN, "t", above.alias("active"))
