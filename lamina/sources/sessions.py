"""Recording sessions: unit attributes, names of runs, triggers, behaviour arrays and reviewed masks."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import columns as fc
from lamina.operators.catalog import name_channels

#: Attributes of a unit, the documents inside them, and device names.
ATTRIBUTES = """MethodTypeDebugString string, SectionTypeDebugString string, TechnologyTypeDebugString string, MeasurementDatePosix double,
MeasurementLengthInMs double, Comment string, TStepInMs double, Slices int, MinZ double, MaxZ double, DwellTime double, Pixelclock double,
DisplayAverage double, FrameLoop double, ZModeDebugString string, VersionInfoJSON string, DeviceJSON string, AOSettingsJSON string,
ModalityJSON string, MultiROIProtocolJSON string"""
DOCUMENTS = {
    "VersionInfoJSON": "mesVersion string",
    "DeviceJSON": "devices array<struct<name string, position double>>",
    "AOSettingsJSON": "pixelAverage double",
    "ModalityJSON": "modalities array<struct<name string, currentState string>>",
    "MultiROIProtocolJSON": "scanPatterns struct<patterns array<struct<pixelSizeL double, pixelSizeX double, pixelSizeT double, pixelSizeY double, "
    "voxelSizeZ double, zSize double, transverseSize double>>>, protocol struct<mainPatternIndex int>",
}
STAGES = {"stage_x_um": "FemtoStageX", "stage_y_um": "FemtoStageY", "stage_z_um": "ObjectiveArm"}
LASERS = ["wavelength_LP1", "power_LP1", "wavelength_LP2", "power_LP2", "UG", "UR", "AO", "GDD2"]

#: Samples of a series that one task smooths or compares at once.
CHUNK = 65_536


def unit_channels(units: DataFrame) -> DataFrame:
    """One row of 47 columns a channel from ``units(file, session, unit, attributes, channels)``.

    ``attributes`` is the JSON text of the unit's attributes, some of them JSON texts again; ``channels`` an
    array of structs ``name, shape``, shape being frames, rows and columns.  What is missing, broken or not a
    number is null.  A z-stack's frames are planes of one time; elsewhere whole volumes of ``Slices`` planes
    count as times, and frames that don't divide stay single times.
    """
    a = F.col("a")
    docs = units.select("file", "session", "unit", "channels", F.from_json("attributes", ATTRIBUTES).alias("a"))
    x = docs.select("*", *[F.from_json(a[k], schema).alias(k) for k, schema in DOCUMENTS.items()]).withColumn("c", F.explode("channels"))
    patterns, main = F.col("MultiROIProtocolJSON.scanPatterns.patterns"), F.col("MultiROIProtocolJSON.protocol.mainPatternIndex")
    position = lambda name: F.try_element_at(F.filter("DeviceJSON.devices", lambda e: e["name"] == name), F.lit(-1))["position"]
    named = F.when((main >= 0) & (main < F.size(patterns)), F.get(patterns, main))
    measured = F.get(F.filter(patterns, lambda p: p["pixelSizeL"].isNotNull()), F.lit(0))
    frames, slices, method = F.get("c.shape", F.lit(0)), a["Slices"], F.coalesce(a["MethodTypeDebugString"], F.lit(""))
    stack, cut = F.contains(F.lower(method), F.lit("zstack")), slices.isNotNull() & (frames > 1)
    x = x.withColumn("p", F.coalesce(named, measured, F.get(patterns, F.lit(0))))
    x = x.withColumn("n_z", F.when(stack, frames).when(cut, slices).otherwise(1))
    x = x.withColumn("n_t", F.when(stack, 1).when(cut & (frames % F.nullif(slices, F.lit(0)) == 0), F.floor(frames / slices).cast("int")).otherwise(frames))
    p, n_t, n_z = F.col("p"), F.col("n_t"), F.col("n_z")
    x = x.withColumn("kind", fc.scan_type(method, a["TechnologyTypeDebugString"], n_t))
    snake, step = F.col("kind") == "snake", F.nullif(a["TStepInMs"], F.lit(0.0))
    rate, some = 1000 / step, lambda c: F.nullif(c, F.lit(""))
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    when = F.concat(F.date_format(F.timestamp_add("SECOND", F.floor(a["MeasurementDatePosix"]).cast("int"), zero), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    objective = F.try_element_at(F.filter("ModalityJSON.modalities", lambda m: m["name"] == "Objective"), F.lit(-1))["currentState"]
    out = {
        "channel": F.col("c.name"),
        "scan_type": F.col("kind"),
        "type": F.coalesce(some(method), some(a["SectionTypeDebugString"]), a["TechnologyTypeDebugString"]),
        "comment": F.trim(F.coalesce(a["Comment"], F.lit(""))),
        "timestamp": F.coalesce(when, F.lit("unknown")),
        "duration_s": F.round(a["MeasurementLengthInMs"] / 1000, 2),
        "duration_calc_s": F.round(F.when(~stack, n_t * step / 1000), 2),
        "frame_rate_hz": F.round(rate, 3),
        "volume_rate_hz": F.round(F.when(snake, rate), 3),
        "slice_rate_hz": F.round(F.when(snake & (n_z > 1), rate * n_z), 2),
        "t_step_ms": F.round(a["TStepInMs"], 4),
        "snake_n_slices": F.when(snake, n_z),
        "zstack_n_planes": F.when(stack, n_z),
        "pixel_average": F.col("AOSettingsJSON.pixelAverage"),
        "display_average": a["DisplayAverage"].cast("int"),
        "frame_loop": a["FrameLoop"].cast("int"),
        "z_mode": a["ZModeDebugString"],
        "pixel_dwell_us": F.round(F.nullif(a["DwellTime"], F.lit(0.0)) * 1000, 4),
        "pixel_clock_hz": F.round(F.nullif(a["Pixelclock"], F.lit(0.0)), 1),
        "n_t": n_t,
        "n_z": n_z,
        "n_y": F.get("c.shape", F.lit(1)),
        "n_x": F.get("c.shape", F.lit(2)),
        "pixel_x_um": F.round(F.coalesce(p["pixelSizeL"], p["pixelSizeX"]), 4),
        "pixel_y_um": F.round(F.coalesce(p["pixelSizeT"], p["pixelSizeY"]), 4),
        "voxel_z_um": F.round(p["voxelSizeZ"], 4),
        "z_extent_um": F.round(p["zSize"], 2),
        "transverse_um": F.round(p["transverseSize"], 2),
        "min_z_um": a["MinZ"],
        "max_z_um": a["MaxZ"],
        "z_step_um": F.round(F.when(n_z > 1, (a["MaxZ"] - a["MinZ"]) / (n_z - 1)), 4),
        **{k: F.round(position(v), 1) for k, v in STAGES.items()},
        **{k: position(k) for k in LASERS},
        "objective": objective,
        "software": F.col("VersionInfoJSON.mesVersion"),
    }
    return x.select("file", "session", "unit", *[c.alias(k) for k, c in out.items()])


def run_identity(path: Column) -> Column:
    """``mouse, date, number, folder`` of a path <mouse>/<MM-DD-YYYY>/.../run<N> or munit<N>/..., else null.

    The last run folder counts, before any munit folder; the date is the first part in that form.
    """
    parts = F.split(path, "/")
    like = lambda form: F.filter(parts, lambda x: F.rlike(x, F.lit(form)))
    last = lambda form: F.try_element_at(like(form), F.lit(-1))
    folder, date = F.coalesce(last("^run[0-9]+$"), last("^munit[0-9]+$")), F.get(like("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), F.lit(0))
    mouse = F.get(parts, (F.array_position(parts, date) - 2).cast("int"))
    return F.when(folder.isNotNull() & date.isNotNull(), F.struct(mouse.alias("mouse"), date.alias("date"), F.regexp_extract(folder, "[0-9]+", 0).cast("long").alias("number"), folder.alias("folder")))


def rename_plan(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Renames ``kind, src, dst`` that give each folder and its files the run number of ``folders(folder, number)``.

    ``files(folder, name)`` begin with a run token of a closed set or are left alone; the longest token
    counts and what follows it stays.  Tokens meet files by equality on their prefixes, so a folder with many
    files and tokens makes no pairs.  Folders without a number give kind "skip".  A bare stack is marked _4d.
    """
    own = F.regexp_extract("folder", "([^/]*)$", 1)
    known = folders.select("folder", "number", own.alias("own"), F.concat(F.lit("run"), F.when(F.length(F.col("number").cast("string")) < 2, F.lpad(F.col("number").cast("string"), 2, "0")).otherwise(F.col("number").cast("string"))).alias("stem"))
    digits = F.regexp_extract("own", "[0-9]+", 0)
    fixed = F.array("own", F.concat("own", F.lit("3d")), F.lower("own"), F.lit("3dstack"), F.concat(F.lit("munit"), digits), F.concat(F.lit("munit_"), digits))
    f = files.select("folder", "name").distinct().withColumn("ext", F.regexp_extract("name", r"[^.](\.[^.]*)$", 1))
    f = f.withColumn("base", F.substring("name", F.lit(1), F.length("name") - F.length("ext")))
    long = F.array_compact(F.array(*[F.nullif(F.regexp_extract("base", form, 1), F.lit("")) for form in (r"^(.*?_(?:[Rr]un\d+|MUnit_\d+)(?:_[A-Za-z0-9]+)*?_4[Dd])$", r"^(MSession_\d+_MUnit_\d+)$")]))
    tokens = known.select("folder", F.explode(fixed).alias("token")).unionByName(f.select("folder", F.explode(long).alias("token"))).where("token <> ''").distinct()
    starts = f.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("base"), F.lit(1))), lambda n: F.substring("base", F.lit(1), n))).alias("token"))
    met = starts.join(tokens, ["folder", "token"]).groupBy("folder", "name", "ext", "base").agg(F.max_by("token", F.length("token")).alias("token"))
    named = met.join(known.where("number is not null"), "folder").withColumn("to", F.concat("stem", F.substring("base", F.length("token") + 1, F.length("base")))).where("to <> base")
    to = F.regexp_replace(F.regexp_replace("to", r"^(run\d{2})3d$", "$1_4d"), r"^(run\d{2})_4[Dd]$", "$1_4d")
    to = F.when((to == F.col("stem")) & F.lower("ext").isin(".tif", ".tiff"), F.concat("stem", F.lit("_4d"))).otherwise(to)
    moved = named.select(F.lit("file").alias("kind"), F.concat_ws("/", "folder", "name").alias("src"), F.concat(F.col("folder"), F.lit("/"), to, F.col("ext")).alias("dst"))
    whole = known.where("number is null or own <> stem").select(
        F.when(F.col("number").isNull(), "skip").otherwise("dir").alias("kind"), F.col("folder").alias("src"), F.when(F.col("number").isNotNull(), F.concat(F.regexp_extract("folder", "^(.*/)?", 0), F.col("stem"))).alias("dst"))
    return moved.unionByName(whole)


def in_chunks(df: DataFrame, i: str, before: int, after: int) -> DataFrame:
    """Rows with a ``_chunk`` of CHUNK places of ``i``, copied into each chunk that reads them from at most
    ``before`` places later or ``after`` earlier; ``_mine`` in the chunk that answers for the row."""
    at = lambda c: F.floor(c / CHUNK)
    x = df.withColumn("_chunk", F.explode(F.sequence(at(F.col(i) - after), at(F.col(i) + before))))
    return x.withColumn("_mine", F.col("_chunk") == at(F.col(i)))


def trigger_edges(samples: DataFrame, on: list[str], i: str, v: str) -> DataFrame:
    """``on, size, edges``: the samples of each array and its steps from at most to above half its range.

    Arrays of a range under 1e-9 have no edges.  Places ``i`` are whole numbers from 0 without gaps; an array
    of any length is compared in chunks.  A null or NaN sample is below.
    """
    value = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    x = samples.select(*on, F.col(i).alias("_i"), value.alias("_v"))
    ends = x.groupBy(*on).agg(F.count("*").alias("size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    high = x.join(ends, on).select(*on, "_i", F.coalesce((F.col("_hi") - F.col("_lo") >= 1e-9) & (F.col("_v") > F.col("_lo") + 0.5 * (F.col("_hi") - F.col("_lo"))), F.lit(False)).alias("_up"))
    w = Window.partitionBy(*on, "_chunk").orderBy("_i")
    steps = in_chunks(high, "_i", 1, 0).withColumn("_step", F.col("_up") & ~F.lag("_up").over(w)).where("_mine")
    return ends.select(*on, "size").join(steps.groupBy(*on).agg(F.count_if("_step").alias("edges")), on)


def trigger_channels(samples: DataFrame, file: str, table: str, column: str, own: str, i: str, v: str, lists: list[list[str]]) -> DataFrame:
    """``file, channel, size, edges`` of the longest array of each named channel, the first of several."""
    counted = trigger_edges(samples, [file, table, column, own], i, v)
    return name_channels(counted, file, table, column, own, "size", lists, ["edges"])


def mirrored_gaussian(df: DataFrame, on: list[str], i: str, sigma: dict[str, float]) -> DataFrame:
    """Columns smoothed by Gaussians of their ``sigma`` in samples: ``on, i`` and the columns.

    Weights reach 4 sigma, ends are mirrored (also where a series is shorter than the reach).  Places ``i``
    are whole numbers from 0 without gaps.  A null within reach gives null.  Series are smoothed in chunks.
    """
    reach = {c: int(4 * s + 0.5) for c, s in sigma.items()}
    r = max(reach.values())
    x = df.select(*on, F.col(i).cast("long").alias(i), *[F.col(c).cast("double").alias(c) for c in sigma])
    x = x.join(x.groupBy(*on).agg((F.max(i) + 1).alias("_n")), on)
    two, turns = 2 * F.col("_n"), F.ceil(F.lit(r) / (2 * F.col("_n"))) + 1
    images = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(F.col(i) + two * k, -1 - F.col(i) + two * k)))
    x = x.withColumn("_p", F.explode(F.filter(images, lambda p: p.between(-r, F.col("_n") + r - 1))))
    w = Window.partitionBy(*on, "_chunk").orderBy("_p")

    def smooth(c):
        weight = [exp(-k * k / (2 * sigma[c] ** 2)) for k in range(reach[c] + 1)]
        total = weight[0] + 2 * sum(weight[1:])
        near = [weight[k] / total * (F.lag(c, k).over(w) + F.lead(c, k).over(w)) for k in range(1, reach[c] + 1)]
        return sum(near, weight[0] / total * F.col(c))

    out = in_chunks(x, "_p", r, r).select(*on, "_p", "_n", "_mine", *[smooth(c).alias(c) for c in sigma])
    return out.where(F.col("_mine") & F.col("_p").between(0, F.col("_n") - 1)).select(*on, F.col("_p").alias(i), *sigma)


def behaviour(samples: DataFrame, settings: DataFrame, on: list[str], i: str, sigma: dict[str, float], signed: list[str], rate: float, crop: float) -> DataFrame:
    """Behaviour arrays on the clock of the imaging: ``on, time`` and the columns, from ``crop`` seconds on.

    ``samples(on, i, columns)`` are on a camera's clock at ``rate``; ``settings(on, aligned_time_s)`` holds the
    camera's first time on the imaging's clock (none, null: 0), so imaging starts at minus that time.  Columns
    are smoothed and divided by their largest value (of ``signed`` ones, magnitude) between that start and the
    crop, or over the whole series where nothing lies between.
    """
    first = settings.groupBy(*on).agg(F.min("aligned_time_s").alias("_first"))
    x = mirrored_gaussian(samples, on, i, sigma).join(first, on, "left").withColumn("_t", F.col(i) / rate).withColumn("_start", -F.coalesce("_first", F.lit(0.0)))
    size = lambda c: F.abs(c) if c in signed else F.col(c)
    early = (F.col("_t") >= F.col("_start")) & (F.col("_t") < F.col("_start") + crop)
    tops = x.groupBy(*on).agg(*[F.coalesce(F.max(F.when(early, size(c))), F.max(size(c))).alias(f"_{c}") for c in sigma])
    kept = x.where(F.col("_t") >= F.col("_start") + crop).join(tops, on)
    return kept.select(*on, (F.col("_t") - F.col("_start") - crop).alias("time"), *[(F.col(c) / (F.col(f"_{c}") + 1e-6)).alias(c) for c in sigma])


def with_companions(stems: DataFrame, paths: DataFrame, stem: str, suffixes: list[str]) -> DataFrame:
    """Rows of ``stems`` whose files ``stem`` + suffix are all among ``paths(path)``; a null stem has none."""
    need = stems.select(stem).distinct().select(stem, F.explode(F.array(*map(F.lit, suffixes))).alias("_s"))
    met = need.withColumn("path", F.concat(stem, "_s")).join(paths.select("path").distinct(), "path")
    whole = met.groupBy(stem).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(suffixes)))
    return stems.join(whole, stem, "left_semi")


def hand_masks(reviews: DataFrame, paths: DataFrame, stem: str, order: list[str], tool: str, hand: str, auto: str, suffixes: list[str], last: bool = False) -> DataFrame:
    """Stems with masks made by hand and all files at hand: ``stem, n_reviews``.

    Either the ``hand`` tool is among the reviews and ``auto`` isn't, or (``last``) the latest review by
    ``order`` is by ``hand``.
    """
    by = lambda t: F.coalesce(F.col(tool) == t, F.lit(False))
    facts = reviews.groupBy(stem).agg(F.count("*").alias("n_reviews"), F.bool_or(by(hand)).alias("_hand"), F.bool_or(by(auto)).alias("_auto"), F.max_by(by(hand), F.struct(*order)).alias("_last"))
    return with_companions(facts.where("_last" if last else "_hand and not _auto").select(stem, "n_reviews"), paths, stem, suffixes)


def pick_channel(names: Column, *wanted: str) -> Column:
    """The first wanted name that is there, else the second name, else the first."""
    there = [F.when(F.array_contains(names, w), w) for w in wanted]
    return F.coalesce(*there, F.get(names, F.lit(1)), F.get(names, F.lit(0)))


def reference_channel(vox: DataFrame, on: list[str], v: str) -> DataFrame:
    """A reference volume between its exact 1st and 99.9th percentiles, clipped to 0..1."""
    ends = vox.groupBy(*on).agg(F.percentile(v, [0.01, 0.999]).alias("_e"))
    lo, hi = F.get("_e", F.lit(0)), F.get("_e", F.lit(1))
    return vox.join(ends, on).withColumn(v, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(v) - lo) / (hi - lo + 1e-9)))).drop("_e")


def chunk_peak(vox: DataFrame, on: list[str], t: str, v: str, size: int, p: float = 0.995, first: int | None = None) -> DataFrame:
    """The largest of a voxel's percentiles ``p`` over chunks of ``size`` frames, and its mean: ``on, peak, mean``.

    ``first``: only frames below it are read, a filter that reaches the scan.
    """
    read = vox if first is None else vox.where(F.col(t) < first)
    part = read.groupBy(*on, F.floor(F.col(t) / size).alias("_chunk")).agg(F.percentile(v, p).alias("_p"), F.sum(v).alias("_s"), F.count(v).alias("_n"))
    return part.groupBy(*on).agg(F.max("_p").alias("peak"), (F.sum("_s") / F.sum("_n")).alias("mean"))
