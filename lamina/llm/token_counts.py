"""Token counts through a digest cache.

Counts are kept as Parquet by the digest of the content and of the tokenizer's version.  New
contents are the digests the cache doesn't hold; each distinct one is encoded once and its
count appended.

Where the tokenizer itself always cuts before a space with a solid character behind it, texts are cut
there, and each distinct piece of some MB of texts goes through the tokenizer once.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import textmath as tm
from lamina.llm.shared import stage, write_tidily

SCHEMA = "digest binary, version string, n_tokens long"
#: Bytes of texts whose pieces are told apart at once, and pieces that the tokenizer gets at once.
BATCH_BYTES, PIECES = 16_000_000, 1 << 15
#: Bytes that surely begin a character that isn't white space in Unicode.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3, 0xEF]] = False
#: At most so many digests of misses are sent to all tasks.
FEW = 1 << 16


def content(text: Column) -> Column:
    """The content that is counted: null reads as empty; nothing else may change the count."""
    return F.coalesce(text.cast("string"), F.lit(""))


def version_of(tokenizer_path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    return hashlib.sha256(Path(tokenizer_path).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def cuts_at_spaces(tokenizer_path: str) -> bool:
    """Whether a text has the tokens of its pieces, cut before each space with a solid character behind it.

    The byte-level pattern ends a match there, whatever stands before; nothing else may look across the cut.
    """
    t = json.loads(Path(tokenizer_path).read_text("utf-8"))
    pre, added = t.get("pre_tokenizer") or {}, t.get("added_tokens") or []
    whole = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not any(c.isspace() for c in x["content"]) for x in added)
    return whole and t.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not t["model"].get("dropout")


def _pieces(raw: np.ndarray, offs: np.ndarray, cut: bool):
    """The distinct pieces of rows of bytes, the number of each piece in order, and each row's first piece (and the end)."""
    edge = np.zeros(len(raw) + 1, bool)
    if cut and len(raw):
        edge[:-2] = (raw[:-1] == 0x20) & SOLID[raw[1:]]
        # A row's last space has nothing behind it.
        edge[np.maximum(offs[1:] - 1, 0)] = False
    edge[offs] = True
    at = np.flatnonzero(edge)
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return pieces.dictionary.cast(pa.string()), pieces.indices.to_numpy(), np.searchsorted(at, offs)


def _encode(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    cut = cuts_at_spaces(tokenizer_path)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.no_truncation()
        tok.no_padding()
        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            for _, raw, offs in tm.slices(batch.column(1), BATCH_BYTES):
                pieces, number, first = _pieces(raw, offs, cut)
                of = np.array([len(e) for i in range(0, len(pieces), PIECES) for e in tok.encode_batch_fast(pieces.slice(i, PIECES).to_pylist(), add_special_tokens=False)], np.int64)
                total = np.r_[0, np.cumsum(of[number])]
                counts.append(total[first[1:]] - total[first[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts), pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, batches: int = 1) -> DataFrame:
    """Tokens of every whole text, encoding only contents that the cache lacks.

    Args: ``docs`` with ``doc_id`` and ``text``; other columns are ignored.  ``tokenizer_path``: a
    ``tokenizers`` JSON file that executors can open; ``cache_path``: a Parquet folder that all
    can reach, made if it doesn't exist and appended to.  ``batches``: rows go through the cache in
    so many turns, dealt by a hash of doc_id, so that later ones find the contents of earlier ones.
    Returns ``doc_id, n_bytes, n_tokens`` longs and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and the tokens of an empty text.  Null and repeated doc_ids
    are kept.  An empty table gives none.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    text, turn = content(F.col("text")), F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache_path)
    stored = lambda: spark.read.schema(SCHEMA).parquet(cache_path).where(F.col("version") == version)
    digests = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest, turn.alias("turn")), "digests")
    for i in range(batches):
        # Misses are decided on digests; texts move afterwards.
        misses = stage(digests.where(F.col("turn") == i).select("digest").distinct().join(stored().select("digest"), "digest", "left_anti"), "misses")
        texts = docs.where(turn == i).select(digest, text.alias("content"))
        once = lambda x: x.groupBy("digest").agg(F.any_value("content").alias("content"))
        # Few misses go to all tasks, and no other text moves.  With many, copies meet first in each task.
        new = once(texts.join(F.broadcast(misses), "digest", "left_semi")) if misses.count() <= FEW else once(texts).join(misses, "digest", "left_semi")
        write_tidily(_encode(new, tokenizer_path).select("digest", F.lit(version).alias("version"), "n_tokens"), cache_path, mode="append")
    # Two writers may have stored one digest; they stored the same count.
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
