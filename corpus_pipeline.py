"""A corpus pipeline of five stages, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import line_dedup, mixing, ngram_join, toxicity
from lamina.llm.queries import encoded
from lamina.llm.shared import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection line."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs, model, keep_columns=True).where(F.col("severity") < model.reject)
    # Whole texts pass through the tasks' Python here, so in small batches.
    return stage(kept.select(*docs.columns), "clean", 4 << 20)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Of rows that repeat this doc_id the one with the least hash stays.  A null doc_id names no
    group, so all rows with one stay.
    """
    groups = ngram_join.similar_groups(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows_of_id"))
    found = docs.join(kept.hint("shuffle_hash"), "doc_id")
    row = F.struct(*docs.columns)
    repeated = found.where("rows_of_id > 1").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64(*docs.columns), "text")).alias("row")).select("row.*")
    return found.where("rows_of_id = 1").select(*docs.columns).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of each copy."""
    return encoded(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_bytes),
]

#: Regression, Newton steps and BPE merges have no SQL form.  Tests hold the stages and the rows of
#: run() against brute force on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
