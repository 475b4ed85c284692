"""Column expressions: text classifiers, rules, parsing, formats and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that grade a free-text comment, the aliases of ratings, the steps of
# readable numbers and the stages of a run.  Results depend on them as they stand.
STRONG_NEGATIVE = ["bad", "crap", "not good", "subpar", "mediocre", "not the best", "not great", "no soma", "missed camera", "too many cells"]
MILD_NEGATIVE = ["multiple cells", "2 cells", "two cells", "neighbor cells", "misalignment", "no pupil", "cropped pupil", "motion", "not active", "water ran out", "meh", "another cell close"]
STRONG_POSITIVE = ["very good"]
POSITIVE = ["good", "ok"]
WEAK_POSITIVE = ["maybe", "might be useful", "first time"]
HEDGES = ["maybe", "might be", "possible", "possibly"]
RATINGS = {"very_good": "very_good", "very-good": "very_good", "verygood": "very_good", "very good": "very_good", "vg": "very_good", "good": "good", "questionable": "questionable", "q": "questionable", "clear": None, "none": None, "": None}
NICE_STEPS = [1, 1.2, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10]
STAGES = ["not_local", "stack", "reference", "auto_segmented", "mask_reviewed", "segments_located", "coherence_built", "behavior_added", "complete"]


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def robust_denominator(f0: Column, how: str = "floor") -> Column:
    """The four denominators of dF/F: floor, or_one, abs_floor, abs_plus."""
    return {
        "floor": F.greatest(f0, F.lit(1e-6)),
        "or_one": F.when(f0 == 0, F.lit(1.0)).otherwise(f0),
        "abs_floor": F.greatest(F.abs(f0), F.lit(1e-6)),
        "abs_plus": F.abs(f0) + 1e-6,
    }[how]


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def hits(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def comment_grade(comment: Column) -> Column:
    """struct(quality, score, notes) of a free-text comment; null or empty: unknown, 0, ''.

    Positive words add, negative ones subtract; a strong negative decides for "bad", and
    hedged or mildly negative comments are never "good".
    """
    c = F.lower(F.coalesce(comment, F.lit("")))
    strong = any_of(c, STRONG_POSITIVE)
    first = lambda words, test: F.coalesce(*[F.when(test(w), F.lit(w)) for w in words])
    plain = F.when(~strong, first(POSITIVE, lambda w: F.rlike(c, F.lit(rf"\b{w}"))))
    weak = first(WEAK_POSITIVE, lambda w: F.contains(c, F.lit(w)))
    n_strong, n_mild = hits(c, STRONG_NEGATIVE), hits(c, MILD_NEGATIVE)
    hedged = any_of(c, HEDGES)
    score = F.when(strong, 3).otherwise(0) + F.when(plain.isNotNull(), 2).otherwise(0) + F.when(weak.isNotNull(), 1).otherwise(0) - 3 * n_strong - n_mild
    notes = F.array_compact(F.array(
        *[F.when(F.contains(c, F.lit(w)), F.lit("+" + w)) for w in STRONG_POSITIVE], F.concat(F.lit("+"), plain), F.concat(F.lit("?"), weak),
        *[F.when(F.contains(c, F.lit(w)), F.lit("-" + w)) for w in STRONG_NEGATIVE], *[F.when(F.contains(c, F.lit(w)), F.lit("~" + w)) for w in MILD_NEGATIVE],
        F.when(hedged, F.lit("?hedged")),
    ))
    quality = (
        F.when(c == "", "unknown").when(n_strong > 0, "bad").when((score >= 2) & (n_mild == 0) & ~hedged, "good")
        .when(score >= 1, "ok").when(score <= -1, "caution").otherwise("unknown")
    )
    return F.struct(quality.alias("quality"), F.when(c == "", 0).otherwise(score).alias("score"), F.when(c == "", "").otherwise(F.array_join(notes, ";")).alias("notes"))


def run_number(text: Column) -> Column:
    """The number after the word "run" in a text, or null."""
    return F.regexp_extract(F.lower(text), r"\brun\s*#?\s*(\d{1,2})\b", 1).try_cast("int")


def compartment(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.startswith(low, F.lit("soma")), "soma").when(F.startswith(low, F.lit("trunk")), "trunk").otherwise("branch")


def scan_type(method: Column, tech: Column, n_t: Column) -> Column:
    """The kind of acquisition; orientation-qualified ribbon names go before the bare one."""
    m = F.lower(F.coalesce(method, F.lit("")))
    has = lambda w: F.contains(m, F.lit(w))
    return (
        F.when(has("snake"), "snake").when(has("transverse") & has("ribbon"), "ribbon_transverse").when(has("longitudinal"), "ribbon_longitudinal")
        .when(has("ribbon"), "ribbon").when(has("zstack"), "zstack")
        .when(F.lower(F.coalesce(tech, F.lit(""))) == "camera", F.when(n_t == 1, "camera_snapshot").otherwise("camera_series"))
        .when(n_t == 1, "snapshot").otherwise(F.coalesce(F.nullif(method, F.lit("")), F.lit("timeseries")))
    )


def rating(value: Column) -> Column:
    """A rating by its aliases; null and clearing words give null, unknown ones fail."""
    key = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for k, v in RATINGS.items() for x in (k, v if v else "-")])
    found = known[key]
    return F.when(value.isNull(), None).when(found.isNull(), F.raise_error(F.concat(F.lit("unknown rating "), value)).cast("string")).otherwise(F.nullif(found, F.lit("-")))


def nice_ceil(x: Column) -> Column:
    """The least readable number not below x; null unless x > 0."""
    k = F.floor(F.log10(x))
    m = x / F.pow(F.lit(10.0), k)
    step = F.array_min(F.filter(F.array(*[F.lit(float(s)) for s in NICE_STEPS]), lambda s: m <= s + 1e-9))
    return F.when(x > 0, F.round(F.coalesce(step, F.lit(10.0)) * F.pow(F.lit(10.0), k), 6))


def nice_bar(lane: Column) -> Column:
    """A round scale-bar length of about a third of a lane."""
    t = lane / 3.0
    k = F.floor(F.log10(t))
    m = t / F.pow(F.lit(10.0), k)
    return F.round(F.when(m < 1.5, 1.0).when(m < 3.5, 2.0).when(m < 7.5, 5.0).otherwise(10.0) * F.pow(F.lit(10.0), k), 6)


def anatomy_key(label: Column) -> Column:
    """struct(group, -number, -far, name) that sorts region names from distal to proximal."""
    low = F.lower(label)
    has = lambda w: F.contains(low, F.lit(w))
    g = F.when(has("dend"), 0).when(has("branch"), 1).when(has("nexus") | has("bifurc"), 2).when(has("trunk"), 3).when(has("soma"), 4).otherwise(2)
    number = F.coalesce(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(g.alias("g"), F.when(g == 1, -number).otherwise(0).alias("number"), F.when((g == 1) & has("far"), -1).otherwise(0).alias("far"), low.alias("name"))


def p_text(p: Column, n_perm: Column | None = None) -> Column:
    """A p-value with its resolution floor 1 / (n + 1); null: NaN; never a bare 0."""
    plain = F.when(p == 0, "< 1e-300").otherwise(F.format_string("%.3e", p))
    if n_perm is not None:
        plain = F.when(p <= 1.0 / (n_perm + 1) + 1e-15, F.format_string("< 1/%d", n_perm + 1)).otherwise(plain)
    return F.when(p.isNull(), "NaN").otherwise(plain)


def verdict(p: Column, q: Column, estimate: Column, null: Column, predicted: Column, n_same: Column, n: Column) -> Column:
    """The verdict on a test: significance after correction, direction, and group agreement."""
    up = estimate > null
    right = F.when(predicted == "greater", up).otherwise(~up)
    told = F.coalesce(q < 0.05, F.lit(False))
    every = ((predicted == "greater") & (n_same == n)) | ((predicted == "less") & (n_same == 0))
    one = (
        F.when(told & right, "SUPPORTED").when(told, "CONTRADICTED (significant, opposite direction)")
        .when(every & (n > 0), "consistent in every group but not significant").when(right, "trend in the predicted direction, not significant")
        .otherwise("not supported (estimate in the opposite direction)")
    )
    two = F.when(told, F.when(up, "difference detected (higher)").otherwise("difference detected (lower)")).when((n >= 4) & ((n_same == 0) | (n_same == n)), "same direction in all groups, not significant").otherwise("no detectable difference")
    return F.when(estimate.isNull() | p.isNull(), "not testable").when(predicted.isin("greater", "less"), one).otherwise(two)


def all_words_in(query: Column, hay: Column) -> Column:
    """Every word of a query occurs in a text."""
    return F.forall(F.split(F.lower(query), " "), lambda w: F.contains(F.lower(hay), w))


def range_numbers(spec: Column) -> Column:
    """The numbers of a spec like "1-3,7", sorted and distinct."""
    part = lambda x, i: F.get(F.split(x, "-"), F.lit(i)).cast("int")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), lambda x: F.sequence(part(x, 0), F.coalesce(part(x, 1), part(x, 0)))))))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common start of two strings."""
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), F.lit(0),
        lambda s, i: F.when((s == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (i <= F.length(a)) & (i <= F.length(b)), i).otherwise(s),
    )
    return F.substr(a, F.lit(1), n)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def furthest_stage(*flags: Column) -> Column:
    """The name of the last stage whose flag holds; flags are of stages 1, 2, ..."""
    idx = F.greatest(F.lit(0), *[F.when(f, i + 1).otherwise(0) for i, f in enumerate(flags)])
    return F.get(F.array(*[F.lit(s) for s in STAGES]), idx)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(lo, hi) of the Wilson interval of k of n."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct((mid - half).alias("lo"), (mid + half).alias("hi"))


def priority(present: Column, paired: Column, unit: Column, quality: Column, comment: Column, confidence: Column, conflict: Column, warnings: Column, loss_pct: Column, mismatch_s: Column, notes: Column) -> Column:
    """struct(priority, reason): P1 best to P4, from match confidence, quality and problems."""
    problems = F.array_distinct(F.array_compact(F.array(
        F.when(confidence == "fingerprint+order", "match by order inside a same-fingerprint group").when(confidence == "duration_order_fallback", "no trigger-count match; paired by duration+order"),
        F.when(conflict, "comment run number disagrees with the pairing"), F.when(warnings > 0, "behavior warning"),
        F.when(loss_pct >= 5, "large behavior frame loss"), F.when(F.abs(mismatch_s) > 1, "duration mismatch"),
        F.when(quality == "caution", "comment caveat"), F.when(F.contains(F.coalesce(notes, F.lit("")), F.lit("~")), "comment caveat"),
    )))
    n, joined = F.size(problems), F.array_join(problems, "; ")
    salvage = any_of(F.lower(F.coalesce(comment, F.lit(""))), ["might be useful", "maybe useful", "but might"])
    made = lambda p, why: F.struct(F.lit(p).alias("priority"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    return (
        F.when(~present, made("P4", "imaging .mesc file missing")).when(~paired, made("P4", "no matching behavior recording")).when(~unit, made("P4", "no matching imaging run"))
        .when((quality == "bad") & salvage, made("P3", "comment marks run as bad but possibly salvageable")).when(quality == "bad", made("P4", "comment marks run as bad"))
        .when((n == 0) & quality.isin("good", "ok"), made("P1", F.concat(F.lit("clean unique match, comment "), quality)))
        .when(n == 0, made("P2", "clean unique match, no quality comment")).when((quality == "good") & (n == 1), made("P2", joined))
        .when((n == 1) & confidence.isin("fingerprint_exact", "fingerprint+comment_run"), made("P2", joined)).otherwise(made("P3", joined))
    )
