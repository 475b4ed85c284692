"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

``LineRuns`` keeps what is known of lines as immutable runs sorted by hash.  Each new batch
merge-anti-joins the settled lines (frequent already, their keeper known) and the rest of
it becomes a run of its own.  When a level has ``fanout`` runs they are compacted into one
run of the next level, so a line is rewritten once a level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.shared import stage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() is the same on ASCII and much faster than translate().
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> Column:
    """96 bits of a key: two keys share them with a chance of 1e-29."""
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Counts and last documents of lines, in levels of sorted runs."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None

    def _write(self, rows: DataFrame) -> DataFrame:
        return stage(rows.sortWithinPartitions(*HASH), "run")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, runs)
        return every.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """Take in ``doc_id, h1, h2`` (distinct) of documents that all precede earlier batches'.

        Lines that are settled are left out by a merge anti-join; their count is known to
        suffice and no document of this batch can be their keeper.
        """
        # Summed first, so that a line of many documents is one row of the merge.
        run = batch.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        if self.settled is not None:
            run = run.join(self.settled.hint("merge"), HASH, "left_anti")
        self.levels[0].append(self._write(run))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            run = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            self.settled = run.where(F.col("n") >= self.min_docs).select(*HASH)

    def frequent(self) -> DataFrame:
        """``h1, h2, n, last`` of the lines seen in ``min_docs`` documents or more."""
        return self._merged([r for level in self.levels for r in level]).where(F.col("n") >= self.min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """Drop repeated lines except in the document of the largest doc_id that holds them.

    Args: ``docs`` with ``doc_id`` long and ``text``; other columns stay as they are.  ``batches``
    doc_id ranges of like numbers of lines are taken in, largest ids first.
    Returns the columns of ``docs`` with the kept lines as ``kept_text`` and ``n_lines``,
    ``n_dropped`` longs added (of the same names in ``docs``, ours replace them).

    A null or empty text is one empty line.  A null doc_id counts as no document: its lines
    all stay.  Rows that repeat a doc_id count once and lose the same lines; a line that
    repeats inside its keeper stays there each time.  An empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    keys = F.transform(lines_of(F.col("text")), line_key)
    long = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    held = stage(
        docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(F.transform(long, _hashes))).alias("h")).select("doc_id", "h.*").distinct(),
        "lines",
    )
    # Batches of like numbers of rows, whatever ids the documents have.
    edges = held.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches + 1)], 10_000)).first()[0]
    if edges is None:
        lines = lines_of(F.col("text"))
        return docs.select("*", F.coalesce("text", F.lit("")).alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    runs = LineRuns(spark, min_docs)
    edges = [-(1 << 63), *edges[1:-1], None]
    for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        if b is None or a < b:
            runs.add(held.where((F.col("doc_id") >= a) & (F.lit(True) if b is None else F.col("doc_id") < b)))
    frequent = stage(runs.frequent(), "frequent")

    # Fewer than 1024 lines can each hold over a 1024th of all entries: these are broadcast,
    # so that no task gets all the entries of a common line.  The others join by hash.
    heavy = max(min_docs, held.count() // 1024)
    hot = frequent.where(F.col("n") > heavy).select(*HASH, F.col("last").alias("hot_last"))
    cold = frequent.where(F.col("n") <= heavy).select(*HASH, "last", F.lit(False).alias("is_hot"))
    seen = held.join(F.broadcast(hot), HASH, "left").withColumn("is_hot", F.col("hot_last").isNotNull())
    seen = seen.select("doc_id", "hot_last", "is_hot", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.when(F.col("is_hot"), F.xxhash64("doc_id", "h1")).otherwise(F.col("h1")).alias("h1"), "h2")
    drops = (
        seen.join(cold, [*HASH, "is_hot"], "left").withColumn("last", F.coalesce("hot_last", "last")).where("doc_id <> last")
        .groupBy("doc_id").agg(F.collect_list(F.struct(F.col("o1").alias("h1"), F.col("o2").alias("h2"))).alias("_gone"))
    )
    lines = lines_of(F.col("text"))
    stays = F.filter(lines, lambda x: (F.char_length(x) < min_chars) | ~F.array_contains(F.col("_gone"), _hashes(line_key(x))) | (F.char_length(line_key(x)) < min_chars))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    out = rows.join(drops.hint("shuffle_hash"), "doc_id", "left").select("row", F.size(lines).alias("n_lines"), F.when(F.col("_gone").isNull(), lines).otherwise(stays).alias("kept"))
    return out.select("row.*", F.array_join("kept", "\n").alias("kept_text"), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))
