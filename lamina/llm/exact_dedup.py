"""Exact dedup with an extendible-hash index of contents on shared files.

A content's key is a 64-bit hash.  The directory lists buckets by leading key bits: it starts with
one bit string for each capacity of contents and doubles wherever a bucket is overfull, so each
bucket is a key range of its own depth.  Equal copies merge in the task that reads them, byte by
byte; what is left goes to the tasks that own its bucket.  An owner takes its keys in order, chains
the different contents of one key, compares bytes along the chain and writes the
bucket.  The index is a Parquet table sorted by bucket and key, and can take later batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.shared import fresh_path, partitions, stage, stage_at

#: Contents of one bucket, about.
CAPACITY = 4096
#: The directory, which all tasks get, starts with at most 2**16 buckets; beyond that, buckets hold more.
MOST_BITS = 16
#: Leading bits of a key that the directory goes by.  Keys that agree in all of them share a bucket of any size,
#: which costs its owner time but no memory, as it takes one key at a time.
DEEPEST = 24
#: Bytes of contents that a reading task holds to merge their copies.
HELD_BYTES = 16 << 20
BATCH_BYTES = 2 << 20
ENTRY = "bucket long, key long, keep_id long, n long, sha binary, content binary"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    # Single spaces stay as they are and match nothing.
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def default_key(content: Column) -> Column:
    return F.xxhash64(content)


def _literal(numbers) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _merge_copies(batches):
    """Contents of equal key and bytes as one row with the least id, as long as they fit in memory."""
    held: dict[int, list[list]] = {}
    size = 0

    def flush():
        rows, room = [], 0
        for key, chain in held.items():
            for bucket, keep, n, sha, content in chain:
                rows.append((bucket, key, keep, n, sha, content))
                room += len(content)
                if room > BATCH_BYTES:
                    yield _batch(rows)
                    rows, room = [], 0
        if rows:
            yield _batch(rows)

    for batch in batches:
        for bucket, key, keep, n, sha, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chain = held.setdefault(key, [])
            for entry in chain:
                if entry[4] == content:
                    entry[1], entry[2] = _least(entry[1], keep), entry[2] + n
                    break
            else:
                chain.append([bucket, keep, n, sha, content])
                size += len(content)
        if size > HELD_BYTES:
            yield from flush()
            held, size = {}, 0
            pa.default_memory_pool().release_unused()
    yield from flush()


def _batch(rows):
    cols = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bucket", "key", "keep_id", "n", "sha", "content"])


def _own(batches):
    """Entries of the keys of an owner, which come in order of bucket and key, one chain at a time."""
    at, chain, out, room = None, [], [], 0
    for batch in batches:
        for bucket, key, keep, n, sha, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (bucket, key):
                out += [(*at, *entry) for entry in chain] if at else []
                at, chain = (bucket, key), []
                if room > BATCH_BYTES:
                    yield _batch(out)
                    out, room = [], 0
            for entry in chain:
                if entry[3] == content:
                    entry[0], entry[1] = _least(entry[0], keep), entry[1] + n
                    break
                if entry[2] == sha:
                    raise ValueError("two different contents have one SHA-256")
            else:
                chain.append([keep, n, sha, content])
                room += len(content)
    out += [(*at, *entry) for entry in chain] if at else []
    if out:
        yield _batch(out)


class HashIndex:
    """An extendible-hash index of contents in a folder that driver and executors share.

    ``add`` takes ``doc_id, key, sha, content`` rows in.  ``entries`` are the contents so far, one
    row for each: ``bucket, key, keep_id, n, sha, content``.  ``directory`` is ``depth, prefix``: a
    bucket holds the keys whose first ``depth`` bits, as a number, are ``prefix``.
    """

    def __init__(self, spark: SparkSession, capacity: int = CAPACITY, path: str | None = None, deepest: int = DEEPEST):
        self.spark, self.capacity, self.deepest = spark, capacity, deepest
        self.path = path or fresh_path(spark, "hash-index")
        self.version = 0
        self.entries: DataFrame | None = None
        self.directory: list[tuple[int, int]] = [(0, 0)]

    def _split(self, keys: DataFrame) -> None:
        """Doubles the directory until no bucket has more keys than the capacity.

        ``keys``: distinct keys as ``key``, counted by bucket.
        """
        total = keys.count()
        bits = min(MOST_BITS, self.deepest, max(0, -(-total // self.capacity) - 1).bit_length())
        # Where the directory would be too large, buckets hold more.
        capacity = max(self.capacity, total >> (MOST_BITS - 1))
        depths = dict.fromkeys(self.directory, True)
        while any(d < bits for d, _ in depths):
            depths = {(d + 1, 2 * p + b) if d < bits else (d, p): True for d, p in depths for b in ((0, 1) if d < bits else (0,))}
        while True:
            self.directory = sorted(depths, key=lambda b: (b[1] << (64 - b[0]), b[0]))
            counts = keys.groupBy(self.bucket(F.col("key")).alias("bucket")).agg(F.count("*").alias("n"))
            # Fewer than 2**17 buckets, of which only the overfull ones come back.
            full = [self.directory[r["bucket"]] for r in counts.where(F.col("n") > capacity).collect()]
            full = [(d, p) for d, p in full if d < self.deepest]
            if not full:
                return
            for d, p in full:
                del depths[d, p]
                depths |= {(d + 1, 2 * p): True, (d + 1, 2 * p + 1): True}

    def bucket(self, key: Column) -> Column:
        """The place in the directory of the bucket that owns a key."""
        # Buckets are key ranges in order of their first key, so a literal array by depth finds them.
        by_depth: dict[int, dict[int, int]] = {}
        for i, (d, p) in enumerate(self.directory):
            by_depth.setdefault(d, {})[p] = i
        found = None
        for d, places in sorted(by_depth.items()):
            prefix = F.shiftrightunsigned(key, 64 - d) if d else F.lit(0).cast("long")
            lo, hi = min(places), max(places)
            if hi - lo < 4 * len(places):
                listed, inside = _literal(places.get(p, -1) for p in range(lo, hi + 1)), prefix.between(lo, hi)
                place = F.when(inside, F.element_at(listed, F.when(inside, (prefix - lo + 1).cast("int")).otherwise(1)))
            else:
                # The few buckets that were split deeper than the others.
                at = F.array_position(_literal(places), prefix)
                place = F.when(at > 0, F.element_at(_literal(places.values()), F.greatest(at, F.lit(1)).cast("int")))
            place = F.when(place >= 0, place)
            found = place if found is None else F.coalesce(found, place)
        return found

    def add(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Take a batch in: ``doc_id`` (null: unnamed), long ``key``, binary ``sha`` and ``content``.

        ``keys``: the batch's ``key`` column, where it is at hand without the contents.
        """
        old = self.entries
        keys = (rows if keys is None else keys).select("key")
        keys = keys if old is None else keys.union(old.select("key"))
        self._split(stage(keys.distinct(), "index-keys"))
        fresh = rows.select(self.bucket(F.col("key")).alias("bucket"), "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), "sha", "content")
        merged = fresh.mapInArrow(_merge_copies, ENTRY)
        if old is not None:
            merged = merged.unionByName(old.withColumn("bucket", self.bucket(F.col("key"))))
        owned = merged.repartition(partitions(self.spark), "bucket").sortWithinPartitions("bucket", "key")
        self.version += 1
        self.entries = stage_at(owned.mapInArrow(_own, ENTRY), f"{self.path}/v{self.version}", BATCH_BYTES)


def dedup(docs: DataFrame, key: Callable[[Column], Column] = default_key, capacity: int = CAPACITY, index: HashIndex | None = None) -> DataFrame:
    """Groups of equal texts, white space apart, and the row of each that stays.

    Args: ``docs`` with ``doc_id`` and ``text``; other columns are ignored.  ``key`` hashes a content to a
    long; whatever it gives, results are right.  ``index``: one that earlier batches went into; their documents
    count, and rows of this batch stay only if none of them has the text and a smaller doc_id.
    Returns ``doc_id, keep_id, group_size`` longs, ``kept`` and ``text_sha256`` of the normalised text.

    Null and empty texts are one content.  A null doc_id is larger than all others; ``keep_id`` is null where
    all of a group are.  Of rows that repeat the doc_id which stays, with its text, one stays, the
    first in a fixed order of the rows.  An empty table gives none.
    """
    spark = docs.sparkSession
    index = index or HashIndex(spark, capacity)
    content = normalised(F.col("text"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("content")).select("doc_id", "content", F.unhex(F.sha2("content", 256)).alias("sha"), key(F.col("content")).alias("key"))
    rows = stage(read.select("doc_id", "key", "sha", F.monotonically_increasing_id().alias("row")), "contents")
    index.add(read.select("doc_id", "key", "sha", F.col("content").cast("binary").alias("content")), rows)
    groups = index.entries.where("n > 1").select("key", "sha", "keep_id", "n")
    # Written by itself, so that the join can split the rows of a very large group.
    ties = stage(rows.groupBy("doc_id", "key", "sha").agg(F.min("row").alias("first_row"), F.count("*").alias("m")).where("m > 1").drop("m"), "content-ties").withColumnsRenamed({"doc_id": "its_id", "key": "its_key", "sha": "its_sha"})
    found = rows.join(groups, ["key", "sha"], "left")
    found = found.join(ties, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")) & (F.col("sha") == F.col("its_sha")), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("first_row").isNull() | (F.col("first_row") == F.col("row")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
