"""Decision trees and boosted trees as aggregates: every level of every tree is one pass over the rows.

What comes back from a pass are sums by node, feature and value or bin; splits are found on these sums and go back to the rows by a join on the node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ranking import ROW_BITS
from lamina.sources.readers import staged


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """``df`` with ``_to_<name>``, the sum of each of ``sums`` over the key's rows up to this one in order, and ``_next``, the next row's
    ``order``.  (key, order) must be unique.

    Rows are dealt by ranges of key and order, so a key may span many tasks; only sums by key and partition meet in one.
    """
    at = F.shiftright("_at", ROW_BITS)
    x = staged(df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("_at", F.monotonically_increasing_id()), "ranged").withColumn("_part", at)
    local = Window.partitionBy(*keys, "_part").orderBy(order)
    parts = x.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_of_{s}") for s in sums], F.min(order).alias("_least"))
    over = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.select(*keys, "_part", *[(F.sum(f"_of_{s}").over(over) - F.col(f"_of_{s}")).alias(f"_before_{s}") for s in sums], F.lead("_least").over(over).alias("_after"))
    x = x.withColumn("_next", F.lead(order).over(local)).select("*", *[F.sum(s).over(local).alias(f"_own_{s}") for s in sums]).join(parts, [*keys, "_part"])
    return x.select(*df.columns, *[(F.col(f"_own_{s}") + F.col(f"_before_{s}")).alias(f"_to_{s}") for s in sums], F.coalesce("_next", "_after").alias("_next"))


def _long(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return df.select(*keep, cells.alias("_x")).select(*keep, "_x.*").where("value is not null and not isnan(value)")


def _gini(a: Column, b: Column) -> Column:
    """The sum of weights times the Gini impurity of two classes."""
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def decision_tree(df: DataFrame, features: list[str], positive: str, depth: int = 2, least: int = 3) -> DataFrame:
    """A tree that parts two classes of equal total weight, by the Gini impurity: one row for each node.

    Args: a boolean ``positive``; ``least``: rows of a leaf.  A split at a node is the feature and the place half way between two
    neighbouring values with the largest fall of impurity (compared to 9 digits; ties: the feature first in the alphabet, then the lesser place).  Rows
    up to the place go left; null and NaN values go right and don't count for that feature's splits.
    Returns ``node`` (1; 2n and 2n + 1 below n), ``depth, feature, threshold`` (null at leaves), ``n``, ``n_positive`` and ``p``, the weighted share.

    Rows of a null class are left out.  One class alone gives a tree of one leaf, no rows none.
    """
    held = df.where(F.col(positive).isNotNull())
    total = held.agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("int")).alias("a")).first()
    n, a = total["n"], total["a"] or 0
    weight = F.when(F.col(positive), n / (2.0 * max(a, 1))).otherwise(n / (2.0 * max(n - a, 1)))
    rows = staged(held.select(*features, F.col(positive).alias("_y"), weight.alias("_w"), F.lit(1).alias("node")), "tree-rows")
    splits = None
    for level in range(depth):
        open_rows = rows.where(F.col("node") >= 1 << level)
        values = _long(open_rows, ["node", "_y", "_w"], features).groupBy("node", "feature", "value").agg(
            F.count("*").alias("n"), F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("_y"), 0.0).otherwise(F.col("_w"))).alias("b"))
        along = running_sums(values, ["node", "feature"], "value", ["n", "a", "b"])
        whole = values.groupBy("node", "feature").agg(*[F.sum(c).alias(f"_all_{c}") for c in ("n", "a", "b")])
        at = along.join(whole, ["node", "feature"]).where(f"_to_n >= {least} and _all_n - _to_n >= {least} and _next is not null")
        fall = _gini(F.col("_all_a"), F.col("_all_b")) - _gini(F.col("_to_a"), F.col("_to_b")) - _gini(F.col("_all_a") - F.col("_to_a"), F.col("_all_b") - F.col("_to_b"))
        best = at.select("node", "feature", ((F.col("value") + F.col("_next")) / 2).alias("threshold"), F.round(fall, 9).alias("_fall")).where("_fall > 0")
        best = staged(best.groupBy("node").agg(F.min(F.struct((-F.col("_fall")).alias("f"), "feature", "threshold")).alias("_s")).select("node", "_s.feature", "_s.threshold"), "splits")
        splits = best if splits is None else splits.unionByName(best)
        value = reduce(lambda c, f: c.when(F.col("feature") == f, F.col(f).cast("double")), features, F.when(F.lit(False), 0.0))
        left = F.coalesce(value <= F.col("threshold"), F.lit(False)) & ~F.isnan(F.coalesce(value, F.lit(0.0)))
        deeper = F.when(F.col("threshold").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        rows = staged(rows.join(best, "node", "left").select(*features, "_y", "_w", deeper.cast("int").alias("node")), "tree-rows")
    # A node's rows are those of the leaves below it.
    levels = F.length(F.bin(F.col("node").cast("long"))) - 1
    above = F.explode(F.transform(F.sequence(F.lit(0), levels), lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)).cast("int")))
    leaf = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.col("_y").cast("long")).alias("n_positive"), F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(0.0)).alias("_a"), F.sum("_w").alias("_t"))
    nodes = leaf.withColumn("node", above).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "n_positive", "_a", "_t")])
    return nodes.join(splits, "node", "left").select("node", levels.alias("depth"), "feature", "threshold", "n", "n_positive", (F.col("_a") / F.col("_t")).alias("p"))


def tree_text(tree: DataFrame) -> DataFrame:
    """A tree as lines of text in the order to be read: ``line`` from 1 and ``text``; one line for each condition and each leaf."""
    t = tree.select("node", "depth", "feature", "threshold", "p")
    parent = t.select(F.col("node").alias("_up"), F.col("feature").alias("_f"), F.col("threshold").alias("_t"))
    t = t.join(parent, F.floor(F.col("node") / 2) == F.col("_up"), "left")
    # Sorting the bits below the first puts each node before its children and the left ones first.
    path = F.substring(F.bin(F.col("node").cast("long")), 2, 64)
    sign = F.when(F.col("node") % 2 == 0, "<=").otherwise("> ")
    bars = lambda d: F.repeat(F.lit("|   "), d)
    condition = F.when(F.col("_f").isNotNull(), F.concat(bars(F.col("depth") - 1), F.lit("|--- "), F.col("_f"), F.lit(" "), sign, F.lit(" "), F.format_string("%.2f", F.col("_t"))))
    leaf = F.when(F.col("feature").isNull(), F.concat(bars(F.col("depth")), F.lit("|--- class: "), F.when(F.col("p") > 0.5, "1").otherwise("0")))
    lines = t.select(path.alias("_p"), F.posexplode(F.array(condition, leaf)).alias("_i", "text")).where("text is not null")
    from lamina.operators.ranking import place

    return place(lines, "_p", "_i", name="line").select("line", "text")


class Bins:
    """Cuts of each feature at approximate quantiles; a value's bin is how many cuts lie below it, the last is for nulls."""

    def __init__(self, df: DataFrame, features: list[str], bins: int = 32):
        shares = [i / bins for i in range(1, bins)]
        found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
        self.features, self.missing = features, bins
        self.cuts = [sorted(set(found[f] or [])) for f in features]

    def column(self) -> Column:
        def of(f: str, cuts: list[float]) -> Column:
            x = F.col(f).cast("double")
            below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x)) if cuts else F.lit(0)
            return F.when(x.isNull() | F.isnan(x), self.missing).otherwise(below).cast("int")

        return F.array(*[of(f, c) for f, c in zip(self.features, self.cuts, strict=True)])


def boost(rows: DataFrame, trees: int = 30, depth: int = 3, rate: float = 0.1, ridge: float = 1.0, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Gradient-boosted trees of the logistic loss on binned features, for many folds at once.

    Args: ``rows`` with ``fold``, ``bins`` (``Bins.column``), boolean ``y`` (null where unknown), ``weight`` and boolean ``train``.  Each tree has
    ``depth`` levels; a level is one aggregate of gradients by fold, node, feature and bin.  A leaf has ``least`` training rows.  Ties of gain (to 9
    digits) go to the first feature and the lowest bin.
    Returns the rows with ``raw``, the log odds, and the trees: ``tree, fold, node`` (1; 2n and 2n + 1 below n), ``feature`` (its number), ``bin``
    (up to it: left), ``value`` (at leaves).
    """
    base = rows.where("train and y is not null").groupBy("fold").agg((F.sum(F.when(F.col("y"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("_p"))
    base = base.select("fold", F.log(F.greatest("_p", F.lit(1e-6)) / F.greatest(1 - F.col("_p"), F.lit(1e-6))).alias("raw"))
    now = staged(rows.join(base, "fold", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))), "boosted")
    model = None
    for tree in range(trees):
        p = 1 / (1 + F.exp(-F.col("raw")))
        slopes = now.withColumn("_g", F.col("weight") * (p - F.col("y").cast("int"))).withColumn("_h", F.col("weight") * p * (1 - p)).withColumn("node", F.lit(1))
        used = F.col("train") & F.col("y").isNotNull()
        every = None
        for level in range(depth):
            cells = slopes.where(used & (F.col("node") >= 1 << level)).select("fold", "node", "_g", "_h", F.posexplode("bins").alias("feature", "bin"))
            sums = cells.groupBy("fold", "node", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count("*").alias("n"))
            # At most bins rows for each fold, node and feature.
            along, whole = Window.partitionBy("fold", "node", "feature").orderBy("bin"), Window.partitionBy("fold", "node", "feature")
            at = sums.select("fold", "node", "feature", "bin", *[F.sum(c).over(w).alias(f"{k}{c}") for c in "ghn" for k, w in (("l", along), ("t", whole))])
            score = lambda g, h: g * g / (h + ridge)
            gain = score(F.col("lg"), F.col("lh")) + score(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")) - score(F.col("tg"), F.col("th"))
            good = at.withColumn("_gain", F.round(gain, 9)).where(f"ln >= {least} and tn - ln >= {least} and _gain > 0")
            best = staged(good.groupBy("fold", "node").agg(F.min(F.struct((-F.col("_gain")).alias("g"), "feature", "bin")).alias("_s")).select("fold", "node", "_s.feature", "_s.bin"), "splits")
            own = F.get("bins", F.col("feature"))
            deeper = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + (own > F.col("bin")).cast("int")).cast("int")
            slopes = slopes.join(best, ["fold", "node"], "left").withColumn("_to", deeper).drop("feature", "bin", "node").withColumnRenamed("_to", "node")
            every = best if every is None else every.unionByName(best)
        leaves = staged(slopes.where(used).groupBy("fold", "node").agg((-rate * F.sum("_g") / (F.sum("_h") + ridge)).alias("value")), "leaves")
        now = staged(slopes.join(leaves, ["fold", "node"], "left").withColumn("raw", F.col("raw") + F.coalesce("value", F.lit(0.0))).select(*now.columns), "boosted")
        part = every.join(leaves, ["fold", "node"], "full_outer").select(F.lit(tree).alias("tree"), "fold", "node", "feature", "bin", "value")
        model = part if model is None else model.unionByName(part)
    return now, model


def leave_one_out(df: DataFrame, group: str, features: list[str], positive: str, cuts: list[float], most: int = 40_000, bins: int = 32, **how) -> DataFrame:
    """Boosted trees that leave each group out in turn, and the threshold on the left-out group that gives the best Dice.

    Training takes about ``most`` rows of each class of each group, by a hash of the row, with classes of equal total weight.  All folds are fitted in
    the same passes.  Returns ``group, n, n_positive, dice_half, precision_half, recall_half`` (at 0.5), ``best_dice, best_cut`` (ties: the lowest cut).

    Rows of a null group or class are left out.  Ratios of nothing are null.
    """
    made = Bins(df, features, bins)
    known = df.where(F.col(group).isNotNull() & F.col(positive).isNotNull()).select(F.col(group).alias("_group"), made.column().alias("bins"), F.col(positive).alias("y"), F.xxhash64(*features).alias("_h"))
    size = known.groupBy("_group", "y").agg(F.count("*").alias("_n"))
    known = staged(known.join(size, ["_group", "y"]).withColumn("_in", (F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)) * F.col("_n") < most).drop("_n", "_h"), "known")
    folds = known.select(F.col("_group").alias("fold")).distinct()
    listed = F.broadcast(folds.agg(F.collect_set("fold").alias("_folds")))  # one row: groups are cells of a study
    rows = known.join(listed).select("_group", "bins", "y", "_in", F.explode("_folds").alias("fold")).withColumn("train", F.col("_in") & (F.col("fold") != F.col("_group"))).where("train or fold = _group")
    share = rows.where("train").groupBy("fold", "y").agg(F.count("*").alias("_m"))
    whole = share.groupBy("fold").agg(F.sum("_m").alias("_t"))
    weight = share.join(whole, "fold").select("fold", "y", (F.col("_t") / (2 * F.col("_m"))).alias("weight"))
    fitted, _ = boost(rows.join(weight, ["fold", "y"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))), **how)
    out = fitted.where(F.col("fold") == F.col("_group")).select(F.col("_group").alias(group), "y", (1 / (1 + F.exp(-F.col("raw")))).alias("p"), F.explode(F.array(*[F.lit(float(c)) for c in sorted({0.5, *cuts})])).alias("cut"))
    called = F.col("p") >= F.col("cut")
    count = lambda c: F.sum(c.cast("long"))
    g = out.groupBy(group, "cut").agg(F.count("*").alias("n"), count(F.col("y")).alias("n_positive"), count(called & F.col("y")).alias("tp"), count(called & ~F.col("y")).alias("fp"))
    dice = 2 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("n_positive"), F.lit(0))
    g = g.withColumn("dice", dice).withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("n_positive"), F.lit(0)))
    half = lambda c: F.max(F.when(F.col("cut") == 0.5, F.col(c))).alias(f"{c}_half")
    tried = F.when(F.col("cut").isin([float(c) for c in cuts]), F.struct(F.coalesce("dice", F.lit(0.0)).alias("d"), (-F.col("cut")).alias("c")))
    return g.groupBy(group).agg(F.max("n").alias("n"), F.max("n_positive").alias("n_positive"), half("dice"), half("precision"), half("recall"), F.max(tried).alias("_b")).select(
        group, "n", "n_positive", "dice_half", "precision_half", "recall_half", F.col("_b.d").alias("best_dice"), (-F.col("_b.c")).alias("best_cut"))
