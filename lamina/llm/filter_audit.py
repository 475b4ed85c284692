"""How quality filters interact: who removes what in every order of a chain of filters.

Each document gets one bit for each filter that it fails.  What any order of the filters removes at
any step follows from how many documents have each set of bits, so the corpus is read once
into 2**n conditional counts for each part and the n! orders are worked out on these counts.

Word statistics come from a relational pipeline: words are exploded and counted by
(document, word), then by document.  No task needs a document's words together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import stage

#: Orders of n filters are listed in the plan, n! of them.
MOST_FILTERS = 6
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _content() -> Column:
    """The digest of a whole text, which tells rows of one doc_id apart and finds identical texts."""
    return F.unhex(F.sha2(_text(), 256))


def word_totals(docs: DataFrame) -> DataFrame:
    """Words and distinct words of each text: ``doc_id, content, n_words, n_distinct``.

    ``docs``: ``doc_id``, ``text``.  ``content`` is the text's SHA-256.  Rows that repeat a doc_id with one
    text come out once; of another text, by themselves.  Texts without words are left out.
    """
    # Rows, not words, are dealt out, each by itself, so that copies of one document can't meet in a task; both counts
    # then need no further shuffle.  The digest is taken before words are exploded, once for each text.
    rows = docs.select("doc_id", F.substring(_content(), 1, 16).alias("content"), _text().alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    words = rows.select("row", "doc_id", "content", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("row", "doc_id", "content", "word").agg(F.count("*").alias("n"))
    totals = counted.groupBy("row", "doc_id", "content").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))
    return totals.groupBy("doc_id", "content").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """Rows and the five failed filters of each document: ``doc_id, part, n_rows, A, B, C, D, E``.

    A: under 200 words; B: less than half of the words distinct; C: over 3 of 100 code points in
    A-Z; D: a symbol of ``#$%&*|``; E: the text of a smaller doc_id.  ``part`` is ``lang``, empty if null.
    Rows of one doc_id, text and part come out once, with their number.
    """
    text = _text()
    kept = stage(
        docs.select(
            "doc_id", _content().alias("digest"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            (100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text)).alias("C"), text.rlike(SYMBOLS).alias("D"),
        ).groupBy("doc_id", "digest", "part", "C", "D").agg(F.count("*").alias("n_rows")),
        "audit-documents",
    )
    # Written by itself, so that the join can split the rows of a text with very many copies.
    first = stage(
        kept.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id"),
        "audit-first",
    )
    totals = stage(word_totals(docs), "audit-words").withColumnsRenamed({"doc_id": "its_id", "content": "its_content"})
    own = kept.join(first, "digest", "left")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.substring("digest", 1, 16) == F.col("its_content"))
    return own.join(totals, same, "full_outer").select(
        "doc_id", "part", "n_rows", (F.coalesce("n_words", F.lit(0)) < 200).alias("A"), F.coalesce(100 * F.col("n_distinct") < 50 * F.col("n_words"), F.lit(False)).alias("B"), "C", "D",
        F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("E"),
    )


def interactions(flagged: DataFrame, filters: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Counts of every step of every order of the filters.

    Args: ``flagged`` with ``part``, a long ``n_rows`` and a boolean column for each name of ``filters``
    (true: it fails; at most 6, named by one letter each) and of ``values`` (a property whose losses count).
    Returns for each part, ``filter_order`` and ``step``: ``kept, removed, redundant, unique_fails``, a
    ``<value>_lost`` for each value, and ``shapley`` (the step's filter's removals over all orders).

    A null flag is false.  An empty table gives no row.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters) or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters of one letter")
    n, lost = len(filters), ["n", *(f"{v}_lost" for v in values)]
    bit = {f: 1 << i for i, f in enumerate(filters)}
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f), b).otherwise(0) for f, b in bit.items()])
    weights = [F.col("n_rows"), *(F.when(F.col(v), F.col("n_rows")).otherwise(0) for v in values)]
    cells = flagged.select("part", mask.alias("mask"), *(w.alias(x) for w, x in zip(weights, lost, strict=True))).groupBy("part").agg(
        *(F.sum(F.when(F.col("mask") == m, F.col(x)).otherwise(0)).alias(f"{x}_{m}") for m in range(1 << n) for x in lost)
    )
    steps = [(order, i) for order in permutations(filters) for i in range(n)]
    step = "struct<filter_order:string,step:int,bit:int,before:int>"
    listed = F.from_json(F.lit("[" + ",".join(
        f'{{"filter_order":"{"".join(o)}","step":{i + 1},"bit":{bit[o[i]]},"before":{sum(bit[f] for f in o[:i])}}}' for o, i in steps
    ) + "]"), f"array<{step}>")
    cell = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(factorial(n) // max(1, m.bit_count())).alias("share"), *(F.col(f"{x}_{m}").alias(x) for x in lost)) for m in range(1 << n)))
    rows = cells.select("part", cell.alias("cells")).select("part", "cells", F.inline(listed))

    def total(value, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda s, c: s + value(c))

    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    here = lambda c: has(c, F.col("bit")) & ~has(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda c: ~has(c, F.col("before").bitwiseOR(F.col("bit")))).alias("kept"),
        total(lambda c: c["n"], here).alias("removed"),
        total(lambda c: c["n"], lambda c: has(c, F.col("bit")) & has(c, F.col("before"))).alias("redundant"),
        total(lambda c: c["n"], lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        *(total(lambda c, x=x: c[x], here).alias(x) for x in lost[1:]),
        # Of all orders, a failing filter comes before the others that fail in its share.
        total(lambda c: c["n"] * c["share"], lambda c: has(c, F.col("bit"))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of five filters, by language.

    Args: ``docs`` with ``doc_id``, ``text`` and ``lang``; ``labels`` with ``doc_id``, ``quality`` and ``toxic``.
    Other columns are ignored.
    Returns ``part, filter_order, step`` and long counts ``kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``: 600 rows for each part, zeros included.

    A null text is empty, a null lang the part of the empty string.  A null doc_id has no labels, no
    smaller id and is none.  Repeated rows count each; rows that repeat a doc_id are no copies of
    each other.  A document is good (toxic) if any of its label rows says 1; null says nothing.  An empty
    table of documents gives no row.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = stage(marks, "audit-labels")
    return interactions(failures(docs).join(marks, "doc_id", "left"), ascii_uppercase[:5], ("good", "toxic"))
