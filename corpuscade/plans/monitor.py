"""Queries of the quality, monitoring and upkeep operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.ranking import top_k_per_group
from .answers import _EVIDENCE, _RESULTS, _SPACES, _TOLD
from .common import table

NOW = "TIMESTAMP '2025-09-01 00:00:00+00:00'"


def _best(spark: SparkSession, d: str, score: str) -> DataFrame:
    found = table(spark, d, "search_results").groupBy("query_id", F.col("chunk_id").alias("item")).agg(F.max(F.when(~F.isnan(score), F.col(score))).alias("score"))
    return found.where("score IS NOT NULL")


def eval_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The dense ranking of every question measured by the three chunks the reranker prefers."""
    gold = top_k_per_group(_best(spark, d, "rerank_score"), ["query_id"], [F.desc("score"), F.asc("item")], 3).select("query_id", "item")
    return metrics.retrieval_metrics(_best(spark, d, "dense_score"), gold).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.percentile_report(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "events", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour."""
    out = metrics.throughput(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", group="event_type")
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "events")


def autoscaler_trace(spark: SparkSession, d: str) -> DataFrame:
    """A pool's size as it follows the hourly throughput of every event type."""
    hourly = metrics.throughput(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", group="event_type")
    return metrics.hill_climb(hourly, "event_type", "window_start", "events")


def never_retrieved(spark: SparkSession, d: str) -> DataFrame:
    return metrics.never_retrieved(table(spark, d, "chunks"), table(spark, d, "search_results"))


def stale_content(spark: SparkSession, d: str) -> DataFrame:
    """Active documents last crawled more than ninety days before a fixed day."""
    docs = table(spark, d, "indexed_documents").where("status = 'active'").select("document_id", "url", "last_crawled").distinct()
    return metrics.stale(docs, F.expr(NOW), 90).select("document_id", "url").distinct()


def stalest_content(spark: SparkSession, d: str) -> DataFrame:
    """The twenty documents not crawled for longest (a report)."""
    docs = table(spark, d, "indexed_documents").groupBy("document_id").agg(F.max("last_crawled").alias("seen"))
    return docs.orderBy("seen", "document_id").limit(20).select("document_id", F.unix_micros("seen").alias("seen_us"))


def tenant_isolation(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_id", "document_id", "university_id").distinct()
    return metrics.tenant_mismatches(chunks, table(spark, d, "indexed_documents"), "document_id", "university_id")


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of active documents of given page types: filters that reach both scans."""
    docs = table(spark, d, "indexed_documents").where("status = 'active'").where(F.col("page_type").isin("faculty", "program", "news")).select("document_id").distinct()
    return table(spark, d, "chunks").select("chunk_id", "document_id", "university_id").distinct().join(docs, "document_id", "left_semi")


def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left after documents unseen for 120 days were purged with all theirs, counted by university."""
    gone = table(spark, d, "indexed_documents").groupBy("document_id").agg(F.max("last_crawled").alias("seen")).where(F.datediff(F.expr(NOW), "seen") > 120).select("document_id")
    left = table(spark, d, "chunks").select("chunk_id", "document_id", "university_id").distinct().join(gone, "document_id", "left_anti")
    return left.groupBy("university_id").agg(F.count("*").alias("chunks"))


def recrawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each document is due again, by the days its page type is given."""
    days = F.when(F.col("page_type") == "news", 7).when(F.col("page_type").isin("program", "admissions"), 30).otherwise(90)
    docs = table(spark, d, "indexed_documents").groupBy("document_id").agg(F.max_by(F.struct("page_type", "last_crawled"), F.struct("last_crawled", "page_type")).alias("n")).select("document_id", "n.*")
    return docs.select("document_id", F.date_add(F.col("last_crawled").cast("date"), days).cast("string").alias("due"))


def slow_events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.slow_events(table(spark, d, "events"), "value", 100.0).select("event_id", "value")


def top_queries(spark: SparkSession, d: str) -> DataFrame:
    """The twenty questions with most results (a report)."""
    asked = table(spark, d, "search_results").select("query_id", "query_text", "chunk_id").distinct().groupBy("query_text").agg(F.countDistinct("query_id").alias("asked"), F.count("*").alias("results"))
    return asked.orderBy(F.desc("asked"), F.desc("results"), F.asc("query_text")).limit(20)


def citation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Of the extractive answers: sentences cited and those found in the evidence of the same number."""
    from ..operators import answers
    from .answers import _results

    results = _results(spark, d)
    return metrics.citation_accuracy(answers.extractive_answers(results), answers.evidence(results))


QUERIES = {f.__name__: f for f in (slow_events, top_queries, citation_accuracy, eval_retrieval_metrics, latency_percentiles, throughput, autoscaler_trace, never_retrieved, stale_content, stalest_content, tenant_isolation, metadata_filter, purge_expired, recrawl_schedule)}

_HOURLY = "h AS (SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS events FROM events GROUP BY ALL)"

SQL = {
    "citation_accuracy": rf"""WITH {_RESULTS}, {_EVIDENCE}, {_TOLD}
        SELECT t.query_id, count(*) AS cited, count(*) FILTER (coalesce(contains(lower(snippet), lower(trim(regexp_replace(sentence, '{_SPACES}', ' ', 'g')))), false)) AS supported
        FROM told t LEFT JOIN ev ON ev.query_id = t.query_id AND ev.source = t.source GROUP BY t.query_id""",
    "slow_events": "SELECT event_id, value FROM events WHERE value > 100.0",
    "top_queries": "SELECT query_text, count(DISTINCT query_id) AS asked, count(*) AS results FROM (SELECT DISTINCT query_id, query_text, chunk_id FROM search_results) GROUP BY query_text ORDER BY asked DESC, results DESC, query_text LIMIT 20",
    "eval_retrieval_metrics": """
        WITH s AS (SELECT query_id, chunk_id, max(CASE WHEN NOT isnan(dense_score) THEN dense_score END) AS d, max(CASE WHEN NOT isnan(rerank_score) THEN rerank_score END) AS r FROM search_results GROUP BY ALL),
        gold AS (SELECT query_id, chunk_id FROM s WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, chunk_id) <= 3),
        run AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, chunk_id) AS rank FROM s WHERE d IS NOT NULL QUALIFY rank <= 10),
        hit AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM run JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
        tot AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id)
        SELECT query_id, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
          round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda k: 1 / log2(k + 1))), 6) AS ndcg FROM tot LEFT JOIN hit USING (query_id)""",
    "latency_percentiles": "SELECT event_type, count(*) AS events, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "throughput": f"WITH {_HOURLY} SELECT epoch_us(w) AS start_us, event_type, events FROM h",
    "autoscaler_trace": f"""
        WITH RECURSIVE {_HOURLY}, n AS (SELECT event_type, events, row_number() OVER (PARTITION BY event_type ORDER BY w) AS seq FROM h),
        f AS (SELECT event_type, 0::BIGINT AS seq, 32 AS size, 1 AS move, -1::BIGINT AS last FROM (SELECT DISTINCT event_type FROM h)
          UNION ALL SELECT f.event_type, n.seq, greatest(1, f.size + CASE WHEN n.events >= f.last THEN f.move ELSE -f.move END), CASE WHEN n.events >= f.last THEN f.move ELSE -f.move END, n.events
          FROM f JOIN n ON n.event_type = f.event_type AND n.seq = f.seq + 1)
        SELECT event_type, seq::INT AS seq, size FROM f WHERE seq > 0""",
    "never_retrieved": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM search_results WHERE chunk_id IS NOT NULL)",
    "stale_content": "SELECT DISTINCT document_id, url FROM (SELECT DISTINCT document_id, url, last_crawled FROM indexed_documents WHERE status = 'active') WHERE date_diff('day', last_crawled::TIMESTAMP::DATE, DATE '2025-09-01') > 90",
    "stalest_content": "SELECT document_id, epoch_us(max(last_crawled)) AS seen_us FROM indexed_documents GROUP BY document_id ORDER BY seen_us, document_id LIMIT 20",
    "tenant_isolation": "SELECT DISTINCT chunk_id, document_id, university_id FROM chunks c WHERE EXISTS (SELECT 1 FROM indexed_documents d WHERE d.document_id = c.document_id) AND NOT EXISTS (SELECT 1 FROM indexed_documents d WHERE d.document_id = c.document_id AND d.university_id = c.university_id)",
    "metadata_filter": "SELECT DISTINCT chunk_id, document_id, university_id FROM chunks WHERE document_id IN (SELECT document_id FROM indexed_documents WHERE status = 'active' AND page_type IN ('faculty', 'program', 'news'))",
    "purge_expired": "WITH gone AS (SELECT document_id FROM indexed_documents GROUP BY document_id HAVING date_diff('day', max(last_crawled)::TIMESTAMP::DATE, DATE '2025-09-01') > 120) SELECT university_id, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, document_id, university_id FROM chunks) WHERE document_id NOT IN (SELECT document_id FROM gone) GROUP BY university_id",
    "recrawl_schedule": "SELECT document_id, (last_crawled::TIMESTAMP::DATE + CASE WHEN page_type = 'news' THEN 7 WHEN page_type IN ('program', 'admissions') THEN 30 ELSE 90 END)::VARCHAR AS due FROM indexed_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY last_crawled DESC, page_type DESC NULLS LAST) = 1",
}
