"""Queries of the mutations, of admission and audits, and of state kept over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl, tables
from ..operators.frontier import Frontier
from ..operators.ranking import grouped_lag, grouped_running_sum
from ..session import scalars
from .common import table


def _stored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "indexed_documents")
    return tables.latest(docs, ["university_id", "url"], [F.col("last_crawled"), F.col("status"), F.col("content_hash"), F.col("document_id")])


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """The last good fetch of every tenant's url, in the shape of a stored document."""
    pages = table(spark, d, "raw_pages").where("status_code = 200").select("university_id", "url", "page_id", "fetched_at", "ingested_at", F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash"))
    last = tables.latest(pages, ["university_id", "url"], [F.col("fetched_at"), F.col("ingested_at"), F.col("page_id")])
    return last.select(F.substring(F.sha2("url", 256), 1, 16).alias("document_id"), "university_id", "url", F.lit(None).cast("string").alias("title"), "content_hash", urls.page_type_col(F.col("url")).alias("page_type"), F.lit(None).cast("string").alias("raw_html_path"), F.col("fetched_at").alias("last_crawled"), F.lit(None).cast("timestamp").alias("last_modified"), F.lit("active").alias("status"))


def change_detect(spark: SparkSession, d: str) -> DataFrame:
    """Fetched pages whose content isn't stored as active: an anti join on tenant, url and digest."""
    known = _stored(spark, d).where("status = 'active'").select("university_id", "url", F.lower("content_hash").alias("content_hash"))
    return _fetched(spark, d).join(known, ["university_id", "url", "content_hash"], "left_anti").select("university_id", "url", "content_hash")


def upsert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert of the fetched pages does to each."""
    return tables.classify(_stored(spark, d), _fetched(spark, d), ["university_id", "url"])


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """The stored documents after the upsert."""
    after = tables.upsert_documents(_stored(spark, d), _fetched(spark, d), ["university_id", "url"])
    return after.select("university_id", "url", F.lower("content_hash").alias("content_hash"), F.unix_micros("last_crawled").alias("crawled_us"), "status")


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a crawl's ingestion."""
    outcome = tables.classify(_stored(spark, d), _fetched(spark, d), ["university_id", "url"])
    return outcome.agg(F.count("*").alias("pages"), F.count_if(F.col("outcome") == "new").alias("pages_new"), F.count_if(F.col("outcome") == "changed").alias("pages_changed"), F.count_if(F.col("outcome") == "unchanged").alias("pages_unchanged"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "document_id", "position", "text").distinct()


def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after documents with a chunk about handbooks were ingested again with their first chunk only."""
    chunks = _chunks(spark, d)
    again = chunks.join(chunks.where("contains(text, 'handbook')").select("document_id").distinct(), "document_id", "left_semi").where("position = 0")
    return tables.replace_children(chunks, again, "document_id").select("chunk_id", "document_id", "position")


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a digest, upserted by the longer texts of every third position: text and
    digest change, document and position stay."""
    stored = _chunks(spark, d).select("chunk_id", "document_id", "position", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    incoming = _chunks(spark, d).where("position % 3 = 0").select("chunk_id", F.lit("other").alias("document_id"), F.lit(-1).alias("position"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("+")), 256).alias("digest"))
    return tables.merge(stored, incoming, ["chunk_id"], ["digest"])


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of documents, chunks and results after the documents in error were deleted."""
    docs = table(spark, d, "indexed_documents").distinct()
    results = table(spark, d, "search_results").select("query_id", "chunk_id").distinct()
    gone = docs.where("status = 'error'").select("document_id").distinct()
    left = tables.delete_cascade({"documents": docs, "chunks": _chunks(spark, d), "results": results}, gone, [("chunks", "document_id", "document_id"), ("results", "chunk_id", "chunk_id")], "documents", "document_id")
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def embedding_cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Texts with and without an entry in a cache of the texts of active documents."""
    chunks = table(spark, d, "chunks").where("text IS NOT NULL").select("document_id", F.sha2("text", 256).alias("content_hash")).distinct()
    active = table(spark, d, "indexed_documents").where("status = 'active'").select("document_id").distinct()
    cache = chunks.join(active, "document_id", "left_semi").select("content_hash").distinct().withColumn("model", F.lit("hash"))
    hits, misses = tables.cache_split(chunks.select("content_hash").distinct(), cache, ["content_hash"])
    return hits.select("content_hash", F.lit(True).alias("cached")).unionByName(misses.select("content_hash", F.lit(False).alias("cached")))


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why records aren't taken up, counted by the first reason that holds."""
    records = table(spark, d, "page_records")
    known = table(spark, d, "universities").select(F.lower("domain").alias("known")).distinct()
    host = urls.host_col(F.col("url"))
    # of the host and the domains above it, those that are known
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    inside = records.select("record_id", F.explode(above).alias("known")).join(known, "known", "left_semi").select("record_id").distinct().withColumn("inside", F.lit(True))
    checks = [("max_depth", F.col("depth") > 3), ("out_of_domain", F.col("inside").isNull()), ("policy", urls.skipped_url_col(F.col("url"))), ("status", F.col("status_code") >= 400), ("non_html", ~F.contains(F.lower("content_type"), F.lit("html"))), ("empty", F.col("size_bytes") == 0)]
    return records.join(inside, "record_id", "left").select(F.coalesce(crawl.first_reason(checks), F.lit("taken")).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each university below its domain and, of those, below its course paths."""
    pages = table(spark, d, "raw_pages").select("university_id", "page_id", "url").distinct()
    joined = pages.join(table(spark, d, "universities").select("university_id", "domain"), "university_id")
    paths = F.array(F.lit("/courses"), F.lit("/programs"))
    return joined.select("page_id", crawl.scope_col(F.col("url"), F.col("domain")).alias("in_domain"), crawl.scope_col(F.col("url"), F.col("domain"), allowed_paths=paths).alias("in_scope"))


def subtree_urls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stored addresses in the news subtree of their own host."""
    records = table(spark, d, "page_records").where("normalized_url IS NOT NULL")
    root = F.concat(F.regexp_extract("normalized_url", r"^([a-z]+://[^/?#]+)", 1), F.lit("/news/"))
    return records.where(urls.in_subtree_col(F.col("normalized_url"), root)).select(F.col("normalized_url").alias("url")).distinct()


def audit_requeue(spark: SparkSession, d: str) -> DataFrame:
    """Records with status 404, put back into a queue that holds those of depth 2 already."""
    records = table(spark, d, "page_records")
    matches, counts = crawl.status_scan(records, 404)
    queue = records.where("depth = 2 AND normalized_url IS NOT NULL").select(F.col("normalized_url").alias("url"), "depth").distinct()
    _, done = crawl.requeue(matches, queue)
    return done.withColumns(scalars(counts))


def min_depth(spark: SparkSession, d: str) -> DataFrame:
    """Smallest depth of every address."""
    return table(spark, d, "page_records").where("normalized_url IS NOT NULL").groupBy(F.col("normalized_url").alias("url")).agg(F.min("depth").alias("depth"))


def domain_roots(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "documents").select("doc_id", "url", F.lit(None).cast("string").alias("final_url"))
    return crawl.domain_roots(entries, "doc_id")


def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    """Saved, skipped and failed fetches of every run."""
    return table(spark, d, "raw_pages").select("run_id", "page_id", "status_code").distinct().groupBy("run_id").agg(F.count_if(F.col("status_code") == 200).alias("saved"), F.count_if(F.col("status_code") == 304).alias("skipped"), F.count_if(F.col("status_code") >= 400).alias("errors"))


def rolling_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user that end after a day without an event."""
    events = grouped_lag(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "ts", "before")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    fresh = events.withColumn("fresh", F.when(gap.isNull() | (gap >= 86_400_000_000), 1).otherwise(0))
    numbered = grouped_running_sum(fresh, ["user_id"], ["ts", "event_id"], "fresh", "session")
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").cast("string").alias("first_seen"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).cast("string").alias("expires_at"))


def scope_config(spark: SparkSession, d: str) -> DataFrame:
    """Settings of every university, and the same with one of them set."""
    scoped = crawl.scopes_of(table(spark, d, "universities"))
    return scoped.select("university_id", F.col("scope.max_depth").alias("max_depth"), F.col("scope.outside_depth").alias("outside_depth"), F.from_json(crawl.patched_config_col(F.col("config"), {"max_depth": "9"}), "max_depth string")["max_depth"].cast("int").alias("patched"))


def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of the link graph from every fetched page below /news, three levels deep, html only."""
    from ..session import work_path
    from .graph import page_edges

    edges = page_edges(spark, d).select("source", "target")
    roots = edges.where(urls.path_col(F.col("source")).startswith("/news")).select(F.col("source").alias("url")).distinct()
    return Frontier(spark, work_path(spark, "frontier")).run(roots, edges, lambda c: c.where(~urls.skipped_url_col(F.col("url"))), max_depth=3)


QUERIES = {f.__name__: f for f in (scope_config, crawl_frontier, change_detect, upsert_outcomes, upsert_documents, ingest_report, replace_chunks, vector_upsert, cascade_delete, embedding_cache_split, skip_reasons, scope_filter, subtree_urls, audit_requeue, min_depth, domain_roots, crawl_counters, rolling_sessions)}

_STORED = "stored AS (SELECT * FROM indexed_documents QUALIFY row_number() OVER (PARTITION BY university_id, url ORDER BY last_crawled DESC, status DESC, content_hash DESC, document_id DESC) = 1)"
_FETCHED = "fetched AS (SELECT university_id, url, sha256(coalesce(html, '')) AS content_hash, fetched_at FROM raw_pages WHERE status_code = 200 QUALIFY row_number() OVER (PARTITION BY university_id, url ORDER BY fetched_at DESC, ingested_at DESC, page_id DESC) = 1)"
_OUTCOME = f"""{_STORED}, {_FETCHED}, outcome AS (SELECT f.university_id, f.url, f.content_hash, f.fetched_at, CASE WHEN s.url IS NULL THEN 'new' WHEN lower(s.content_hash) = f.content_hash AND s.status = 'active' THEN 'unchanged' ELSE 'changed' END AS outcome
    FROM fetched f LEFT JOIN stored s ON s.university_id = f.university_id AND s.url = f.url)"""
_CHUNKS = "c AS (SELECT DISTINCT chunk_id, document_id, position, text FROM chunks)"
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim({0}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '')"
_PATH = r"regexp_extract(trim({0}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"
_URL_HOST = _HOST.format("url")
_URL_PATH = _PATH.format("url")

SQL = {
    "scope_config": "SELECT university_id, (config->>'max_depth')::INT AS max_depth, 0 AS outside_depth, 9 AS patched FROM universities",
    "crawl_frontier": r"""WITH RECURSIVE pages AS (SELECT DISTINCT url, html FROM raw_pages WHERE status_code = 200),
        hrefs AS (SELECT url, unnest(regexp_extract_all(html, '<a href=["'']([^"'']*)["'']', 1)) AS h FROM pages),
        edges AS (SELECT DISTINCT url AS source, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/]*') || h WHEN h LIKE '#%' THEN regexp_replace(url, '#.*$', '') ELSE h END AS target FROM hrefs),
        walk AS (SELECT DISTINCT source AS url, 0 AS depth FROM edges WHERE regexp_matches(source, '^https?://[^/]+/news') UNION SELECT target, depth + 1 FROM walk JOIN edges ON source = url
          WHERE depth < 3 AND NOT regexp_matches(target, '(?i)\.(pdf|zip|doc|docx|ppt|pptx|xls|xlsx|jpg|jpeg|png|gif|svg|webp|mp4|mp3|avi|mov|dmg|exe)$'))
        SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
    "change_detect": f"WITH {_STORED}, {_FETCHED} SELECT university_id, url, content_hash FROM fetched f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.status = 'active' AND s.university_id = f.university_id AND s.url = f.url AND lower(s.content_hash) = f.content_hash)",
    "upsert_outcomes": f"WITH {_OUTCOME} SELECT university_id, url, outcome FROM outcome",
    "upsert_documents": f"""WITH {_OUTCOME}
        SELECT coalesce(o.university_id, s.university_id) AS university_id, coalesce(o.url, s.url) AS url, lower(CASE WHEN o.outcome IS NULL OR o.outcome = 'unchanged' THEN s.content_hash ELSE o.content_hash END) AS content_hash,
          epoch_us(coalesce(o.fetched_at, s.last_crawled)) AS crawled_us, CASE WHEN o.outcome IS NULL THEN s.status ELSE 'active' END AS status
        FROM stored s FULL JOIN outcome o ON s.university_id = o.university_id AND s.url = o.url""",
    "ingest_report": f"WITH {_OUTCOME} SELECT count(*) AS pages, count(*) FILTER (outcome = 'new') AS pages_new, count(*) FILTER (outcome = 'changed') AS pages_changed, count(*) FILTER (outcome = 'unchanged') AS pages_unchanged FROM outcome",
    "replace_chunks": f"WITH {_CHUNKS}, again AS (SELECT DISTINCT document_id FROM c WHERE contains(text, 'handbook')), n AS (SELECT c.* FROM c JOIN again USING (document_id) WHERE position = 0) SELECT chunk_id, document_id, position FROM c WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT chunk_id, document_id, position FROM n",
    "vector_upsert": f"WITH {_CHUNKS} SELECT chunk_id, document_id, position, CASE WHEN position % 3 = 0 THEN sha256(coalesce(text, '') || '+') ELSE sha256(coalesce(text, '')) END AS digest FROM c",
    "cascade_delete": f"""WITH {_CHUNKS}, gone AS (SELECT DISTINCT document_id FROM indexed_documents WHERE status = 'error'), dead AS (SELECT chunk_id FROM c WHERE document_id IN (SELECT document_id FROM gone)),
        d AS (SELECT DISTINCT * FROM indexed_documents), r AS (SELECT DISTINCT query_id, chunk_id FROM search_results)
        SELECT 'documents' AS name, count(*) AS rows FROM d WHERE document_id NOT IN (SELECT document_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM c WHERE document_id NOT IN (SELECT document_id FROM gone)
        UNION ALL SELECT 'results', count(*) FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM dead)""",
    "embedding_cache_split": "WITH c AS (SELECT DISTINCT document_id, sha256(text) AS content_hash FROM chunks WHERE text IS NOT NULL) SELECT content_hash, bool_or(document_id IN (SELECT document_id FROM indexed_documents WHERE status = 'active')) AS cached FROM c GROUP BY content_hash",
    "skip_reasons": rf"""
        WITH h AS (SELECT *, {_URL_HOST} AS host FROM page_records), u AS (SELECT DISTINCT lower(domain) AS dom FROM universities),
        m AS (SELECT h.*, EXISTS (SELECT 1 FROM u WHERE h.host = u.dom OR ends_with(h.host, '.' || u.dom)) AS inside FROM h)
        SELECT CASE WHEN depth > 3 THEN 'max_depth' WHEN NOT inside THEN 'out_of_domain'
          WHEN NOT regexp_matches(url, '(?i)^https?:') OR regexp_matches({_URL_PATH}, '(?i)\.(pdf|zip|doc|docx|ppt|pptx|xls|xlsx|jpg|jpeg|png|gif|svg|webp|mp4|mp3|avi|mov|dmg|exe)$') THEN 'policy'
          WHEN status_code >= 400 THEN 'status' WHEN content_type NOT ILIKE '%html%' THEN 'non_html' WHEN size_bytes = 0 THEN 'empty' ELSE 'taken' END AS reason, count(*) AS records FROM m GROUP BY ALL""",
    "scope_filter": rf"""
        WITH p AS (SELECT DISTINCT university_id, page_id, url FROM raw_pages), j AS (SELECT page_id, lower(domain) AS dom, {_URL_PATH} AS path, regexp_replace(lower(regexp_extract(trim(url), '//([^/?#]*)', 1)), ':\d*$', '') AS host FROM p JOIN universities USING (university_id)),
        k AS (SELECT page_id, path, host = dom OR ends_with(host, '.' || dom) AS in_domain FROM j)
        SELECT page_id, in_domain, in_domain AND (starts_with(path, '/courses') OR starts_with(path, '/programs')) AS in_scope FROM k""",
    "subtree_urls": rf"SELECT DISTINCT normalized_url AS url FROM page_records WHERE normalized_url IS NOT NULL AND ({_PATH.format('normalized_url')} = '/news' OR starts_with({_PATH.format('normalized_url')}, '/news/'))",
    "audit_requeue": """
        WITH m AS (SELECT DISTINCT normalized_url AS url FROM page_records WHERE status_code = 404 AND normalized_url IS NOT NULL), q AS (SELECT DISTINCT normalized_url AS url FROM page_records WHERE depth = 2 AND normalized_url IS NOT NULL)
        SELECT count(*) FILTER (url NOT IN (SELECT url FROM q)) AS requeued, count(*) FILTER (url IN (SELECT url FROM q)) AS already_queued, count(*) AS deleted,
          (SELECT count(*) FROM page_records) AS scanned, (SELECT count(*) FROM page_records WHERE normalized_url IS NULL OR status_code IS NULL) AS corrupt FROM m""",
    "min_depth": "SELECT normalized_url AS url, min(depth) AS depth FROM page_records WHERE normalized_url IS NOT NULL GROUP BY normalized_url",
    "domain_roots": rf"""
        WITH e AS (SELECT doc_id, url, coalesce(nullif(split_part(ltrim({_URL_PATH}, '/'), '/', 1), ''), 'general') AS slug, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS origin FROM documents)
        SELECT slug, origin || '/' || slug AS root FROM e WHERE origin <> '' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY doc_id, url) = 1""",
    "crawl_counters": "SELECT run_id, count(*) FILTER (status_code = 200) AS saved, count(*) FILTER (status_code = 304) AS skipped, count(*) FILTER (status_code >= 400) AS errors FROM (SELECT DISTINCT run_id, page_id, status_code FROM raw_pages) GROUP BY run_id",
    "rolling_sessions": """
        WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS events, min(ts)::TIMESTAMP::VARCHAR AS first_seen, (max(ts)::TIMESTAMP + INTERVAL 1 DAY)::VARCHAR AS expires_at FROM s GROUP BY user_id, session""",
}
