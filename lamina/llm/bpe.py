"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Texts are split into words by the vocabulary's pattern once.  Each task numbers the distinct words
of a chunk of texts (some MB), writes the texts as numbers and the words as rows.  The distinct
words of all chunks are encoded once each: bytes are Latin-1 characters, the rank map is one
constant array of small maps, found by a token's hash, and a fold merges the adjacent pair of the
least rank, leftmost first, until no pair has one; only the pairs beside a merge are looked up
again.  The ids go back to the chunks by equality of words, and each chunk's texts take theirs by
number.  Decoding concatenates the bytes of the ids.

A word is first cut between two bytes that stand together inside no token, as no merge crosses
there; so long blobs become short pieces.  A piece that is still longer than LONG bytes is merged by
a heap instead of the fold, in the same order, as a fold would copy it at every merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from lamina.llm.shared import discard, fresh_path, packed, partitions, stage, stage_at, unpacked

SLOTS = 1 << 16
#: Bytes from which a piece without a cut is merged by a heap.
LONG = 256
#: Bytes of words in one chunk, about.
CHUNK_BYTES = 32 << 20
#: Effort that packs a chunk's texts, which lie on disk twice while ids go back to them.
EFFORT = 9
#: Numbers of words that are exchanged for ids at once, about.
TAKE = 1 << 18
#: Encoded words that one task packs for their chunks at a time.
PACK = 1 << 20
#: Words that are sent to all tasks with their ids, those of most chunks, and bytes of the longest such word.
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
#: White space of the pattern language that vocabularies are made with, for Java.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def java_pattern(pattern: str) -> str:
    """The splitting pattern with Unicode white space spelled out, as Java's \\s is ASCII."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out += WHITE if inside else f"[{WHITE}]"
        elif two == "\\S":
            if inside:
                raise ValueError("\\S inside a class isn't supported")
            out += f"[^{WHITE}]"
        elif two[0] == "\\":
            out += two
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out += two[0]
            i -= 1
        i += 2
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def latin(b: Column) -> Column:
    """Bytes as a string of one character a byte."""
    return F.decode(b.cast("binary"), "ISO-8859-1")


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _constant(rows: DataFrame, name: str) -> Column:
    """The one value of a frame of one row as a constant: a session variable, whose value
    the optimizer puts into each expression that names it."""
    spark, kind = rows.sparkSession, rows.schema[0].dataType.simpleString()
    stage(rows.coalesce(1), name).createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"system.session.{name}")


def _table(rows: DataFrame, slots: int, name: str) -> Column:
    """Rows ``key, value`` as one constant: an array of small maps by the key's hash."""
    spark = rows.sparkSession
    own = rows.groupBy(_slot(F.col("key"), slots).alias("id")).agg(F.collect_list(F.struct("key", "value")).alias("m"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("id")).join(own, "id", "left")
    return _constant(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: F.map_from_entries(x["m"])).alias("t")), name)


def _find(table: Column, key: Column, slots: int) -> Column:
    return F.get(table, _slot(key, slots))[key]


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long piece: the merges of the fold, the next one taken from a heap."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts here; -1 end: none does
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i:e]] for i, e in enumerate(end) if e > 0]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A column of the byte runs between the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _numbered(words: pa.ListArray, inside: np.ndarray):
    """The pieces of each row's words as numbers, their offsets by row, and the distinct pieces.

    ``inside`` tells for each pair of bytes whether a token holds it; common pieces get low numbers.
    """
    bounds = np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))].astype(np.int64)
    coded = words.flatten().cast(pa.binary()).dictionary_encode()
    which, held = coded.indices.to_numpy(), coded.dictionary
    at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    raw = np.frombuffer(held.buffers()[2], np.uint8)[at[0] : at[-1]] if len(held) else np.zeros(0, np.uint8)
    at = at - at[0]
    cut = np.ones(len(raw) + 1, bool)
    cut[1:-1] = ~inside[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    cut[at] = True
    edges = np.flatnonzero(cut)
    first = np.searchsorted(edges, at)
    pieces = _binary(raw, edges).dictionary_encode() if len(raw) else pa.array([], pa.binary()).dictionary_encode()
    number = pieces.indices.to_numpy()
    # A batch has less than 2 ** 31 bytes, so all counts fit in 32 bits, which halves what a task holds.
    first = first.astype(np.int32)
    many = np.diff(first)[which]
    ends = np.zeros(len(many) + 1, np.int32)
    np.cumsum(many, out=ends[1:])
    flat = np.repeat(first[which] - ends[:-1], many)
    flat += np.arange(ends[-1], dtype=np.int32)
    flat = number[flat]
    order = np.argsort(-np.bincount(flat, minlength=len(pieces.dictionary)), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    return place[flat], ends[bounds].astype(np.int64), pieces.dictionary.take(pa.array(order))


def _exchanged(flat: np.ndarray, of: np.ndarray, size: np.ndarray, begin: np.ndarray, values: np.ndarray):
    """The ids of rows of numbers (row i has those from of[i] to of[i + 1]): ids and their offsets, some rows at a time.

    Number k stands for size[k] values from begin[k] on.
    """
    a = 0
    while a < len(of) - 1:
        b = max(a + 1, int(np.searchsorted(of, of[a] + TAKE, "right")) - 1)
        part = flat[of[a] : of[b]]
        long = size[part]
        ends = np.r_[0, np.cumsum(long)]
        yield values[np.repeat(begin[part] - ends[:-1], long) + np.arange(ends[-1])], ends[of[a : b + 1] - of[a]]
        a = b


class Bpe:
    """A vocabulary of ranks: ``encode`` texts to ids, ``decode`` ids to bytes.

    The vocabulary is a file of fixed size; its ranks go into the plan as constants.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.spark, self.pattern = spark, java_pattern(pattern)
        self.name = hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]
        self.inside = np.zeros(1 << 16, bool)
        for t in self.ranks:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            self.inside[b[:-1] * 256 + b[1:]] = True
        pieces: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            pieces[r] = t.hex().upper()
        self.pieces = _constant(spark.createDataFrame([(pieces,)], "p array<string>"), f"lamina_bpe_pieces_{self.name}")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(self.pattern), F.lit(0))

    def rank_of(self):
        """The literal rank map, as a function of a token's column, and its name."""
        table = self.spark.createDataFrame([(t.decode("latin-1"), r) for t, r in self.ranks.items()], "key string, value int")
        name = f"lamina_bpe_ranks_{self.name}"
        ranks = _table(table, SLOTS, name)
        return (lambda token: _find(ranks, token, SLOTS)), name

    @staticmethod
    def word_ids(word: Column, rank) -> Column:
        """Ids of one word of the pattern or a piece of one, by folding merges over its bytes."""
        none = F.lit(2**31 - 1)
        ranked = lambda t: F.coalesce(rank(t), none)

        def merge(s, _):
            p, r = s["p"], s["r"]

            def at(q):
                def put(m):
                    left = F.when(q > 0, ranked(F.concat(F.get(p, q - 1), m))).otherwise(none)
                    right = F.when(q + 2 < F.size(p), ranked(F.concat(m, F.get(p, q + 2)))).otherwise(none)
                    # Null marks what the merge takes away.
                    tokens = F.transform(p, lambda x, i: F.when(i == q, m).when(i != q + 1, x))
                    ranks = F.transform(r, lambda x, i: F.when(i == q - 1, left).when(i == q + 1, right).when(i != q, x))
                    return F.struct(F.filter(tokens, lambda x: x.isNotNull()).alias("p"), F.filter(ranks, lambda x: x.isNotNull()).alias("r"))

                return _let(F.concat(F.get(p, q), F.get(p, q + 1)), put)

            return _let(F.array_min(r), lambda best: F.when(F.coalesce(best, none) == none, s).otherwise(_let((F.array_position(r, best) - 1).cast("int"), at)))

        def fold(b):
            start = F.struct(
                F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substr(b, i, F.lit(1))).alias("p"),
                F.transform(F.sequence(F.lit(1), F.length(b) - 1), lambda i: ranked(F.substr(b, i, F.lit(2)))).alias("r"),
            )
            return F.aggregate(F.sequence(F.lit(2), F.length(b)), start, merge, lambda s: F.transform(s["p"], rank))

        return _let(latin(word), lambda b: _let(rank(b), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(b))))

    def _word_table(self, words: DataFrame, path: str) -> DataFrame:
        """``word, chunks, ids`` of the distinct words, each encoded once, and how many chunks hold it."""
        distinct = words.select("word").repartition(partitions(self.spark), "word").groupBy("word").agg(F.count("*").alias("chunks"))
        rank, name = self.rank_of()
        ranks = self.spark.sparkContext.broadcast(self.ranks)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([merged(w, ranks.value) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "chunks", "ids"])

        short = distinct.where(F.octet_length("word") <= LONG).select("word", "chunks", self.word_ids(F.col("word"), rank).alias("ids"))
        long = distinct.where(F.octet_length("word") > LONG).mapInArrow(run, "word binary, chunks long, ids array<int>")
        out = stage_at(short.unionByName(long), path)
        self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
        return out

    @staticmethod
    def _with_ids(words: DataFrame, known: DataFrame) -> DataFrame:
        """``chunk, slot, ids`` of the words of all chunks.

        At most FREQUENT words, those of most chunks, are broadcast, so that their many rows stay
        where they are; all others are joined by a shuffle.
        """
        bin_of, small = F.floor(8 * F.log2("chunks")), F.octet_length("word") <= FREQUENT_BYTES
        # One row for each eighth of a power of two.
        bins = sorted(known.where(small).groupBy(bin_of.alias("bin")).count().collect(), reverse=True)
        least, total = 1 << 16, 0
        for b, n in bins:
            total += n
            if total > FREQUENT:
                break
            least = b
        frequent = F.broadcast(known.where(small & (bin_of >= least)).select("word", "ids"))
        rest = words.join(frequent.select("word"), "word", "left_anti").join(known.where(~(small & (bin_of >= least))), "word")
        return words.join(frequent, "word").select("chunk", "slot", "ids").unionByName(rest.select("chunk", "slot", "ids"))

    def encode(self, docs: DataFrame) -> DataFrame:
        """The ids of each whole ``text``, words split by the pattern.

        Returns the columns of ``docs`` but ``text``, and ``ids`` array<int> and ``packed`` binary, the
        ids as little-endian unsigned 32-bit integers (of these names in ``docs``, ours replace them).
        A null or empty text has no ids.  Null and repeated doc_ids are kept, each row with its ids.
        An empty table gives none.
        """
        docs = docs.drop("ids", "packed")
        row = docs.select(F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("row"), self.words(F.col("text")).alias("words"))
        inside = self.inside

        def number(batches):
            chunk = TaskContext.get().partitionId() << 32
            for batch in batches:
                flat, bounds, pieces = _numbered(batch.column(1), inside)
                m, rows = len(pieces), batch.column(0)
                one = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), one, pa.array([packed(np.diff(bounds))]), pa.array([len(flat)]), pa.array([packed(flat, EFFORT)]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)
                for i in range(0, m, 1 << 16):
                    part = pieces.slice(i, 1 << 16)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.nulls(n, one.type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(i, i + n, dtype=np.int32)), part], names)
                chunk += 1

        names = ["chunk", "rows", "sizes", "n", "numbers", "slot", "word"]
        kind = row.schema["row"].dataType
        path, known_path = fresh_path(self.spark, "coded"), fresh_path(self.spark, "words")
        coded = row.mapInArrow(number, StructType([
            StructField("chunk", LongType()), StructField("rows", ArrayType(kind)), StructField("sizes", BinaryType()), StructField("n", LongType()), StructField("numbers", BinaryType()), StructField("slot", IntegerType()), StructField("word", BinaryType()),
        ])).withColumn("part", F.when(F.col("word").isNull(), "texts").otherwise("words"))
        coded = stage_at(coded, path, CHUNK_BYTES, ("part",))
        words = coded.where("part = 'words'").select("chunk", "slot", "word")
        known = self._word_table(words, known_path)

        def pack(batches):
            held, size = [], 0

            def out():
                t = pa.concat_tables(held).combine_chunks()
                chunk, slot = t["of"].to_numpy(), t["slot"].to_numpy()
                order = np.lexsort((slot, chunk))
                chunk, slot, ids = chunk[order], slot[order], t["ids"].combine_chunks().take(pa.array(order))
                many, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
                ends, edges = np.r_[0, np.cumsum(many)], np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)]
                for part in range(0, len(edges) - 1, 256):
                    cuts = list(zip(edges[part : part + 256], edges[part + 1 : part + 257], strict=False))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(chunk[a]) for a, _ in cuts], pa.int64()), pa.array([[int(b - a), int(ends[b] - ends[a])] for a, b in cuts], pa.list_(pa.int64())),
                        *(pa.array([packed(x) for x in xs], pa.binary()) for xs in ([np.diff(slot[a:b], prepend=np.int32(0)) for a, b in cuts], [many[a:b].astype(np.int32) for a, b in cuts], [flat[ends[a] : ends[b]] for a, b in cuts])),
                    ], ["of", "n", "slots", "many", "ids"])

            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                size += len(batch)
                if size >= PACK:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

        found = self._with_ids(words, known).withColumnRenamed("chunk", "of").mapInArrow(pack, "of long, n array<long>, slots binary, many binary, ids binary")
        found = stage(found, "found")
        # The texts and the packed ids are all that is read from here on.
        discard(self.spark, f"{path}/part=words")
        discard(self.spark, known_path)

        def take(texts: pa.Table, parts: pa.Table) -> pa.Table:
            slots, many, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for n, a, b, c in zip(parts["n"].to_pylist(), parts["slots"], parts["many"], parts["ids"], strict=True):
                slots.append(np.cumsum(unpacked(a.as_py(), n[0], np.int32)))
                many.append(unpacked(b.as_py(), n[0], np.int32))
                ids.append(unpacked(c.as_py(), n[1], np.int32))
            slots, many, values = (np.concatenate(x) for x in (slots, many, ids))
            size, begin = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
            size[slots], begin[slots] = many, np.r_[0, np.cumsum(many)][:-1]
            rows = texts["rows"].combine_chunks().flatten()
            flat = unpacked(texts["numbers"][0].as_py(), texts["n"][0].as_py(), np.uint32)
            of = np.r_[0, np.cumsum(unpacked(texts["sizes"][0].as_py(), len(rows), np.int64))]
            # Batches of some texts each, so that neither side of the exchange holds a chunk's ids at once.
            out, done = [], 0
            for got, bounds in _exchanged(flat, of, size, begin, values):
                row = rows.slice(done, len(bounds) - 1)
                out.append(pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(got)), _binary(got.astype("<u4", copy=False).view(np.uint8), 4 * bounds)], ["row", "ids", "packed"]))
                done += len(row)
            return pa.Table.from_batches(out)

        kinds = StructType([StructField("row", coded.schema["rows"].dataType.elementType), *StructType.fromDDL("ids array<int>, packed binary").fields])
        texts = coded.where("part = 'texts'").select("chunk", "rows", "sizes", "n", "numbers")
        return texts.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(take, kinds).select("row.*", "ids", "packed").drop("_")

    def decode(self, ids: Column) -> Column:
        """The bytes of ids; null for null."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))
