"""The contract queries opN_<name> over the whole tables of a data folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, centroids, exact_dedup, filter_audit, line_dedup, licenses, lm, mixing, ngram_join, token_counts, toxicity, vector_dedup, vector_search
from lamina.llm.shared import fresh_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), 0.98)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_texts(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of this call's own, so that each call encodes all its distinct contents, the second half
    # of the rows only those that the first half lacks.
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-counts"), batches=2)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Token numbers and digests of the ids and of the bytes they decode to."""
    code = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return code.encode(docs.select("doc_id", "text")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(code.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, vec_id = _read(spark, sf_dir, "embeddings"), F.col("vec_id").cast("string")
    return centroids.cluster(vectors, 16, 3, width=64, scale=64, seed_order=F.sha2(F.concat(F.lit("1:"), vec_id), 256)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_line_dedup, op3_license_scan, op4_source_mixing, op5_embedding_dedup, op6_toxicity,
    op7_lm_scores, op8_nearest_vectors, op9_token_counts, op10_byte_bpe,
    op11_centroid_clustering, op12_filter_audit, op13_exact_dedup,
)}

_COMPONENTS = """
, bidir AS (SELECT a, b FROM links UNION SELECT b, a FROM links)
, reach(id, least) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT bidir.b, reach.least FROM reach JOIN bidir ON bidir.a = reach.id WHERE reach.least < bidir.b
)
, roots AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)
"""

def _lloyd(k: int, rounds: int) -> str:
    """Lloyd's rounds in SQL, a pair of common table expressions for each."""
    steps = ["""
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda z: floor(64 * z::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda z: z IS NOT NULL AND isfinite(z)))
), c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1)::INT AS c, x AS cx FROM v QUALIFY c < %d)
""" % k]
    for i in range(rounds + 1):
        steps.append(f"""
, a{i} AS MATERIALIZED (
    SELECT vec_id, x, min(d * {k} + c) AS best
    FROM (SELECT vec_id, x, c, list_sum(list_transform(range(1, 65), lambda j: (x[j] - cx[j]) * (x[j] - cx[j])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY vec_id, x
)""")
        if i < rounds:
            steps.append(f"""
, s{i} AS (SELECT best % {k} AS c, j, sum(z)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(x) AS z, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY ALL)
, m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS mx FROM s{i} GROUP BY c)
, c{i + 1} AS MATERIALIZED (SELECT c, coalesce(mx, cx) AS cx FROM c{i} LEFT JOIN m{i} USING (c))""")
    return "".join(steps) + f"""
SELECT vec_id, (best % {k})::INT AS cluster, best // {k} AS distance, (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia,
    (sum(best // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(cx, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best % {k}
"""


ORACLES = {
    "op1_ngram_jaccard_join": """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, nodes AS (SELECT doc_id AS id FROM documents)
, common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
, links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c))
""" + _COMPONENTS + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN roots r ON r.id = d.doc_id
""",
    "op2_line_dedup": """
WITH l AS (
    SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
, m AS (SELECT l.*, f.last IS NOT NULL AND l.doc_id <> f.last AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), nodes AS (SELECT vec_id AS id FROM embeddings)
, links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98)
""" + _COMPONENTS + """
SELECT e.vec_id, (SELECT count(*) FROM bidir WHERE bidir.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.id = e.vec_id
""",
    "op11_centroid_clustering": _lloyd(16, 3),
    "op12_filter_audit": """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id)
, f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        ['A', 'B', 'C', 'D', 'E'] AS letters,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS fails
    FROM d LEFT JOIN l USING (doc_id)
), fa AS (SELECT part, good, toxic, list_filter(letters, lambda x, i: fails[i]) AS failed FROM f)
, x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c)
, o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5)
, s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1 : step - 1] AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step))
, g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fa GROUP BY ALL)
, r AS (
    SELECT part, filter_order, step, letter, n, n_good, n_toxic, failed, list_contains(failed, letter) AS fails, len(list_filter(failed, lambda y: contains(before, y))) > 0 AS gone FROM g, s
), t AS (
    SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails AND len(failed) = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
""",
    "op13_exact_dedup": """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
}
