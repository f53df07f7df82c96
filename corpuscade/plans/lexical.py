"""Queries of the lexical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import vectors
from ..operators import lexical
from .common import CHUNKS, asked, chunk_table, table, tokens_sql


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term frequencies of every document."""
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text")


def bm25_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.doc_freqs(lexical.postings(table(spark, d, "documents"), "doc_id", "text"))


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = lexical.corpus_stats(lexical.lengths(table(spark, d, "documents"), "doc_id", "text"))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    stats = lexical.corpus_stats(lexical.lengths(docs, "doc_id", "text"))
    return lexical.idf(lexical.doc_freqs(lexical.postings(docs, "doc_id", "text")), stats).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight best chunks of every question."""
    return lexical.best_scores(chunk_table(spark, d), asked(spark, d), "chunk_id", "text", "query_id", "query_text", 8, 6)


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of the chunks, as components."""
    return vectors.hashed_components(chunk_table(spark, d), "chunk_id", "text").select("chunk_id", "dim", F.round("value", 6).alias("value"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.token_estimate_col(F.col("text")).alias("tokens"))


def heuristic_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The heuristic score of every result's chunk."""
    results = table(spark, d, "search_results").select("query_id", "query_text", "chunk_id").distinct()
    joined = results.join(chunk_table(spark, d).select("chunk_id", "heading", "text"), "chunk_id")
    return joined.select("query_id", "chunk_id", F.round(fn.heuristic_rerank_col(F.col("query_text"), F.coalesce("text", F.lit("")), F.col("heading")), 6).alias("rerank"))


def process_intent(spark: SparkSession, d: str) -> DataFrame:
    """Is a question about a process, and what its lexical side is asked as."""
    return asked(spark, d).select("query_id", fn.process_question_col(F.col("query_text")).alias("process"), fn.expanded_question_col(F.col("query_text")).alias("expanded"))


def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What an embedder reads: heading trail and text, with the digest a cache knows it by."""
    chunks = table(spark, d, "chunks").select("chunk_id", "heading_trail", "text").where("text IS NOT NULL").distinct()
    return chunks.select("chunk_id", F.sha2(fn.embedding_input_col(F.col("heading_trail"), F.col("text")), 256).alias("content_hash"))


def weighted_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of headings (weight 1) and texts (weight 0.4) of the chunks."""
    return lexical.weighted_postings(chunk_table(spark, d), "chunk_id", {"heading": 1.0, "text": 0.4}).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (weighted_terms, tokenize_terms, bm25_doc_freq, bm25_corpus_stats, bm25_idf, bm25_search_topk, hash_embedding, token_estimate, heuristic_rerank, process_intent, embedding_inputs)}

_POSTINGS = f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS t FROM documents) GROUP BY ALL"
_STATS = f"SELECT count(*) AS n, coalesce(avg(len({tokens_sql('text')})), 0) AS avgdl FROM documents"

SQL = {
    "weighted_terms": f"""WITH c AS ({CHUNKS}), p AS (SELECT chunk_id, unnest({tokens_sql('heading')}) AS term, 1.0 AS w FROM c UNION ALL SELECT chunk_id, unnest({tokens_sql('text')}), 0.4 FROM c)
        SELECT chunk_id, term, round(sum(w)::DOUBLE, 6) AS weight FROM p GROUP BY ALL""",
    "tokenize_terms": _POSTINGS,
    "bm25_doc_freq": f"SELECT term, count(*) AS df FROM ({_POSTINGS}) GROUP BY term",
    "bm25_corpus_stats": f"SELECT n, round(avgdl, 6) AS avgdl FROM ({_STATS})",
    "bm25_idf": f"SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM ({_POSTINGS}) GROUP BY term), ({_STATS})",
    "bm25_search_topk": f"""
        WITH c AS (SELECT chunk_id, {tokens_sql('text')} AS w FROM ({CHUNKS})),
        st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM c),
        p AS (SELECT chunk_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM c) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query_text')}) AS term FROM (SELECT DISTINCT query_id, query_text FROM search_results)) GROUP BY ALL),
        s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
              FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)
        SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) WHERE k <= 8""",
    "hash_embedding": f"""
        WITH t AS (SELECT chunk_id, t, 1 + ln(count(*)) AS w FROM (SELECT chunk_id, unnest({tokens_sql('text')}) AS t FROM ({CHUNKS})) GROUP BY ALL),
        h AS (SELECT chunk_id, (('0x' || substr(sha256(t), 1, 8))::BIGINT % 256)::INT AS dim,
              CASE WHEN ('0x' || substr(sha256(t), 9, 2))::INT % 2 = 1 THEN -w ELSE w END AS w FROM t),
        v AS (SELECT chunk_id, dim, sum(w) AS v FROM h GROUP BY ALL HAVING abs(sum(w)) > 1e-12)
        SELECT chunk_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)), 6) AS value FROM v""",
    "token_estimate": r"SELECT doc_id, floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\pZ\x{85}\x{0B}\x{1c}-\x{1f}]+'), lambda w: w <> '')) * 1.3::DOUBLE)::INT AS tokens FROM documents",
    "heuristic_rerank": f"""
        WITH r AS (SELECT DISTINCT query_id, query_text, chunk_id FROM search_results),
        j AS (SELECT query_id, chunk_id, query_text, coalesce(text, '') AS text, list_distinct({tokens_sql('query_text')}) AS q, {tokens_sql('text')} AS b, list_distinct({tokens_sql('heading')}) AS h
              FROM r JOIN ({CHUNKS}) c USING (chunk_id))
        SELECT query_id, chunk_id, round(CASE WHEN len(q) = 0 OR len(b) = 0 THEN 0 ELSE least(1.0,
          len(list_filter(b, lambda t: list_contains(q, t))) * 4.0::DOUBLE / len(b) + len(list_intersect(q, h)) * 0.4::DOUBLE / len(q)
          + CASE WHEN contains(lower(text), lower(trim(query_text))) THEN 0.2::DOUBLE ELSE 0 END) END, 6) AS rerank FROM j""",
    "process_intent": r"""
        SELECT query_id, process, CASE WHEN process THEN query_text || ' steps stage process application guide how to apply' ELSE query_text END AS expanded
        FROM (SELECT DISTINCT query_id, query_text, coalesce(regexp_matches(query_text, '(?i)\b(step|steps|stage|stages|process|how\s+to\s+apply|application\s+guide|application\s+process|guide)\b'), false) AS process FROM search_results)""",
    "embedding_inputs": "SELECT DISTINCT chunk_id, sha256(CASE WHEN len(heading_trail) > 0 THEN array_to_string(heading_trail, ' > ') || chr(10) || chr(10) || text ELSE text END) AS content_hash FROM chunks WHERE text IS NOT NULL",
}
