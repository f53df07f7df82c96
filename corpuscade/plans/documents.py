"""Queries over pages, addresses and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, html, urls
from ..operators import metrics
from ..operators.ranking import grouped_rank
from ..session import scalars
from .common import CHUNKS, chunk_table, table


def normalize_url_v1(spark: SparkSession, d: str) -> DataFrame:
    """Canonical addresses of the stored records."""
    return table(spark, d, "page_records").select("record_id", urls.canonical_url_col(F.col("url")).alias("canonical"))


def normalize_url_v2(spark: SparkSession, d: str) -> DataFrame:
    """The lighter form, which keeps query and port."""
    return table(spark, d, "page_records").select("record_id", urls.light_url_col(F.col("url")).alias("canonical"))


def url_keys(spark: SparkSession, d: str) -> DataFrame:
    """Document id, page key, tenant slug and first path segment of every stored url."""
    u = F.col("url")
    return table(spark, d, "documents").select("doc_id", urls.document_id_col(u).alias("document_id"), urls.page_key_col(u).alias("page_key"), urls.tenant_slug_col(u).alias("slug"), urls.first_segment_col(u).alias("segment"))


def page_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(urls.page_type_col(F.col("url")).alias("page_type")).agg(F.count("*").alias("pages"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_pages").where("status_code = 200").select("page_id", "html").distinct()
    return pages.select("page_id", html.simple_title_col(F.col("html")).alias("title"))


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every page: position, heading, text."""
    pages = table(spark, d, "raw_pages").where("status_code = 200").select("page_id", "html").distinct()
    return pages.select("page_id", F.posexplode(html.sections_udf("html")).alias("position", "s")).select("page_id", "position", "s.heading", "s.text")


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Structural chunks of every page, by page type."""
    pages = table(spark, d, "raw_pages").where("status_code = 200").select("page_id", "url", "html").distinct()
    return pages.select("page_id", F.explode(html.structural_chunks_udf()("html", urls.page_type_col(F.col("url")))).alias("c")).select("page_id", "c.*")


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document by sentences, with overlap."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(chunking.sentence_chunks_udf()("text")).alias("position", "chunk"))


def chunk_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Number, mean, median, ninth decile and extremes of the chunks' lengths."""
    sized = chunk_table(spark, d).where("text IS NOT NULL").select(F.length("text").alias("n"))
    points = scalars(metrics.percentile_report(sized.withColumn("all", F.lit(0)), "all", "n", (0.5, 0.9)))
    return sized.agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 4).alias("avg_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars")).withColumns({"p50": points["p50"], "p90": points["p90"]})


def shortest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The thirty shortest chunks (a report)."""
    sized = chunk_table(spark, d).where("text IS NOT NULL").select("chunk_id", F.length("text").alias("chars"))
    return sized.orderBy("chars", "chunk_id").limit(30)


def chunks_per_document(spark: SparkSession, d: str) -> DataFrame:
    """The thirty documents with most chunks (a report)."""
    sized = chunk_table(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"))
    return sized.orderBy(F.desc("chunks"), F.asc("document_id")).limit(30)


def chunks_of_new_pages(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the documents crawled in the last two months before a fixed day, numbered anew without blank ones."""
    new = table(spark, d, "indexed_documents").where("last_crawled >= TIMESTAMP '2025-07-01 00:00:00+00:00'").select("document_id").distinct()
    whole = chunk_table(spark, d).where(F.trim(F.coalesce("text", F.lit(""))) != "").join(new, "document_id", "left_semi")
    numbered = grouped_rank(whole.select("document_id", "position", "chunk_id"), ["document_id"], ["position", "chunk_id"], "n")
    return numbered.select("document_id", "chunk_id", (F.col("n") - 1).cast("int").alias("position"))


def list_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("domain IS NOT NULL AND domain <> ''").select("domain").distinct()


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, chunks and whether both are there."""
    docs = table(spark, d, "indexed_documents").agg(F.countDistinct("document_id").alias("documents"))
    chunks = table(spark, d, "chunks").agg(F.countDistinct("chunk_id").alias("chunks"))
    return docs.withColumn("chunks", scalars(chunks)["chunks"]).withColumn("status", F.when((F.col("documents") > 0) & (F.col("chunks") > 0), "ok").otherwise("degraded"))


QUERIES = {f.__name__: f for f in (normalize_url_v1, normalize_url_v2, url_keys, page_type_counts, html_title, html_sections, sentence_chunks, chunk_size_distribution, shortest_chunks, chunks_per_document, chunks_of_new_pages, list_domains, health_counts)} | {"structural_chunks": html_text}

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '')"
_PATH = r"regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"

SQL = {
    "normalize_url_v1": r"""
        WITH p AS (SELECT record_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS net,
            regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM page_records),
        r AS (SELECT record_id, scheme, CASE WHEN scheme = 'https' THEN regexp_replace(net, ':443$', '') WHEN scheme = 'http' THEN regexp_replace(net, ':80$', '') ELSE net END AS net,
            regexp_replace(regexp_replace(path, '/[^/]+/\.\./', '/', 'g'), '/\./', '/', 'g') AS path,
            array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&') AS q FROM p)
        SELECT record_id, scheme || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM r""",
    "normalize_url_v2": r"""
        WITH p AS (SELECT record_id, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1)) AS net,
            regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(trim(url), '(\?[^#]*)', 1) AS q FROM page_records)
        SELECT record_id, CASE WHEN scheme IN ('http', 'https') AND net <> '' THEN scheme || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || q END AS canonical FROM p""",
    "url_keys": f"""SELECT doc_id, substr(sha1(url), 1, 12) AS document_id, substr(sha256(url), 1, 16) AS page_key, replace({_HOST}, '.', '-') AS slug,
        coalesce(nullif(split_part(ltrim({_PATH}, '/'), '/', 1), ''), 'general') AS segment FROM documents""",
    "page_type_counts": f"""SELECT CASE WHEN regexp_matches(p, '/facult|/staff|/people|/professor|/researcher') THEN 'faculty' WHEN regexp_matches(p, '/program|/degree|/major|/minor|/course|/curriculum') THEN 'programs'
        WHEN regexp_matches(p, '/scholar|/financial|/funding|/award|/bursary|/fellowship') THEN 'scholarships' WHEN regexp_matches(p, '/admiss|/apply|/requirement|/deadline|/enrol') THEN 'admissions' ELSE 'general' END AS page_type,
        count(*) AS pages FROM (SELECT lower({_PATH}) AS p FROM documents) GROUP BY ALL""",
    "html_title": r"""SELECT page_id, nullif(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '') AS title
        FROM (SELECT DISTINCT page_id, html FROM raw_pages WHERE status_code = 200)""",
    "chunk_size_distribution": f"SELECT count(*) AS chunks, round(avg(n), 4) AS avg_chars, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90, min(n)::INT AS min_chars, max(n)::INT AS max_chars FROM (SELECT length(text) AS n FROM ({CHUNKS}) WHERE text IS NOT NULL)",
    "shortest_chunks": f"SELECT chunk_id, length(text)::INT AS chars FROM ({CHUNKS}) WHERE text IS NOT NULL ORDER BY chars, chunk_id LIMIT 30",
    "chunks_per_document": f"SELECT document_id, count(*) AS chunks, round(avg(length(text)), 4) AS avg_chars FROM ({CHUNKS}) GROUP BY document_id ORDER BY chunks DESC, document_id LIMIT 30",
    "chunks_of_new_pages": f"SELECT document_id, chunk_id, (row_number() OVER (PARTITION BY document_id ORDER BY position, chunk_id) - 1)::INT AS position FROM ({CHUNKS}) WHERE trim(coalesce(text, '')) <> '' AND document_id IN (SELECT document_id FROM indexed_documents WHERE last_crawled >= TIMESTAMPTZ '2025-07-01 00:00:00+00')",
    "list_domains": "SELECT DISTINCT domain FROM chunks WHERE domain IS NOT NULL AND domain <> ''",
    "health_counts": "SELECT d AS documents, c AS chunks, CASE WHEN d > 0 AND c > 0 THEN 'ok' ELSE 'degraded' END AS status FROM (SELECT count(DISTINCT document_id) AS d FROM indexed_documents), (SELECT count(DISTINCT chunk_id) AS c FROM chunks)",
}
