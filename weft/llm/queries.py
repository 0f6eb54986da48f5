"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.stages import table


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.phrases import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.sharding import external_shuffle, shard_of, size_of

    shards = 16
    out = external_shuffle(table(spark, sf_dir, "documents"), shards)
    return out.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        shard_of(F.col("doc_id"), shards + 1).cast("int").alias("grown_shard"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _held_out(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~_held_out(5, 0))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~_held_out(4, 2))
    return quality.score(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_phrase_dedup": op3_phrase_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_licenses": op8_licenses,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {
    "op3_phrase_dedup": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
             g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
             late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
             kept AS (SELECT a.doc_id, a.p, a.word, gone.p IS NOT NULL AS removed FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) a
                      LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.p = gone.p),
             sums AS (SELECT doc_id, count(*) FILTER (removed) AS n, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT removed), '') AS body FROM kept GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM w LEFT JOIN sums ON w.doc_id = sums.doc_id
    """,
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w)),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
             link AS MATERIALIZED (
                 SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
                 JOIN n p1 ON p.a = p1.doc_id JOIN n p2 ON p.b = p2.doc_id WHERE 100 * shared >= 80 * (p1.size + p2.size - shared)),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT d.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, least AS component_id
        FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON d.doc_id = r.a
    """,
    "op9_suffix_dedup": """
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, md5_number_upper(substr(h, 2 * i - 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 398)) AS i FROM d)),
             again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
             marked AS (SELECT doc_id, i, sum(CASE WHEN i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
                        FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM again)),
             spans AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM marked GROUP BY doc_id, run),
             kept AS (SELECT s.doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS body, max(z) AS last
                      FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans) s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN last IS NULL THEN h ELSE body || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
}
