"""Queries of the operators around crawls and answers: admission, robots, sitemaps, stores, sessions, providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import html, text as fn, urls, vectors
from ..operators import crawl, graph, sessions, tables
from ..operators.frontier import Frontier, snapshot
from ..session import work_path
from ..sources import files
from .common import ASKED, CHUNKS, asked, chunk_table, table
from .graph import _EDGES, _PART, page_edges, part_edges


def _robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots file for every university; every fifth length of a name has a failed fetch."""
    body = F.concat(F.lit("User-agent: *\nDisallow: /news\nAllow: /news/2025\n\nUser-agent: other\nDisallow: /\nSitemap: https://"), F.col("domain"), F.lit("/map.xml\n"))
    return table(spark, d, "universities").select("domain", F.when(F.length("domain") % 5 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether every fetched address is allowed."""
    pages = table(spark, d, "raw_pages").select("url").distinct()
    return crawl.robots_allowed(pages, crawl.robots_rules(_robots(spark, d))).select("url", "allowed")


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages listed by the sitemaps of every university, an index of two files each."""
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    base = table(spark, d, "universities").select(F.concat(F.lit("https://"), "domain").alias("b"))
    at = lambda end: F.concat("b", F.lit(end))
    index = F.concat(F.lit("<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>"), at("/a.xml"), F.lit("</loc></sitemap><sitemap><loc>"), at("/b.xml"), F.lit("</loc></sitemap></sitemapindex>"))
    first = F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), loc(at("/")), loc(at("/news")), F.lit("</urlset>"))
    second = F.concat(F.lit("<urlset>"), loc(at("/news")), loc(at("/staff")), F.lit("</urlset>"))
    made = base.select(F.explode(F.array(*[F.struct(at(name).alias("url"), F.lit(200).alias("status"), xml.alias("xml")) for name, xml in (("/map.xml", index), ("/sitemap.xml", index), ("/a.xml", first), ("/b.xml", second))])).alias("f")).select("f.*")
    return crawl.sitemap_urls(crawl.robots_sitemaps(_robots(spark, d)), made).select("url")


def seed_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses a crawl of every university starts from."""
    even = F.length("domain") % 2 == 0
    scopes = table(spark, d, "universities").select(F.array("domain", F.concat(F.lit("en."), "domain")).alias("hosts"), F.when(even, F.array(F.lit("/courses"), F.lit("news"))).otherwise(F.array().cast("array<string>")).alias("paths"))
    return crawl.seed_urls(scopes)


def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges read back from stored page links, those of even sources in the new form, others in the old."""
    listed = part_edges(spark, d).distinct().groupBy(F.col("source").cast("string").alias("source"), (F.col("source") % 2 == 0).alias("even")).agg(F.array_sort(F.collect_list(F.struct(F.col("target").cast("string").alias("target"), "type"))).alias("l"))  # three at most
    old = F.filter("l", lambda e: e["type"] == "link")
    stored = listed.select("source", F.when(F.col("even"), F.col("l")).alias("edges"), F.when(~F.col("even"), F.get(F.filter("l", lambda e: e["type"] == "redirect"), F.lit(0))["target"]).alias("redirect_to"), F.when(~F.col("even"), F.transform(old, lambda e: e["target"])).alias("outgoing_links"))
    return graph.edges_of(stored).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "type")


def outgoing_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every fetched page in canonical form, on its own host, without skipped endings, sorted, repeats kept."""
    pages = table(spark, d, "raw_pages").where("status_code = 200").select("url", "html").distinct()
    found = pages.select(F.col("url").alias("source"), F.xxhash64("html").alias("version"), F.explode(html.links_udf("html", "url")).alias("link"))
    kept = crawl.admissible_links(found, "link", urls.host_col(F.col("source")))
    return kept.groupBy("source", "target").agg(F.count("*").alias("times"))


def admission_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why records aren't taken up, by the whole chain: depth, domain, policy, robots, stored already, redirect, type, emptiness."""
    records = table(spark, d, "page_records")
    known = table(spark, d, "universities").select(F.lower("domain").alias("known")).distinct()
    labels = F.split(urls.host_col(F.col("url")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    inside = records.select("record_id", F.explode(above).alias("known")).join(known, "known", "left_semi").select("record_id").distinct().withColumn("inside", F.lit(True))
    stored = crawl.persisted(table(spark, d, "raw_pages").select("url", "html"), page_edges(spark, d).where("type = 'redirect'").select("source")).withColumn("stored", F.lit(True))
    allowed = crawl.robots_allowed(records.join(inside, "record_id", "left"), crawl.robots_rules(_robots(spark, d)))
    joined = allowed.join(stored, "url", "left")
    moved = urls.host_col(F.col("normalized_url")) != urls.host_col(F.col("url"))
    checks = [("max_depth", F.col("depth") > 3), ("out_of_domain", F.col("inside").isNull()), ("policy", urls.skipped_url_col(F.col("url"))), ("robots", ~F.col("allowed")), ("existing", F.col("stored").isNotNull()), ("redirect", moved), ("non_html", ~F.contains(F.lower("content_type"), F.lit("html"))), ("empty", F.col("size_bytes") == 0)]
    return joined.select("record_id", F.coalesce(crawl.first_reason(checks), F.lit("taken")).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def checkpoint_states(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of a crawl of every university, some of them cut or of another root."""
    n = F.length("domain") % 4
    rows = table(spark, d, "universities").select("university_id", F.when(n == 1, F.lit("https://other.example/")).when(n == 2, F.lit(None)).otherwise(F.lit("https://root.example/")).alias("root_url"), F.array(F.struct(F.concat(F.lit("https://"), "domain").alias("url"), F.when(n == 3, -1).otherwise(1).alias("depth"))).alias("queue"), F.array(F.col("domain")).alias("visited"), F.lit(1).alias("pages_saved"), F.lit(0).alias("pages_skipped"), F.lit(0).alias("errors"))
    return crawl.checkpoint_state(rows, "https://root.example/").select("university_id", "state")


def retried_fetches(spark: SparkSession, d: str) -> DataFrame:
    """Records that are fetched again, with the answers of depth 2 taken as not ready and the bodies of addresses of every third length as blank."""
    rows = table(spark, d, "page_records").select("record_id", "content_type", F.when(F.col("depth") == 2, 202).otherwise(F.col("status_code")).alias("status_code"), F.when(F.length("url") % 3 == 0, F.lit(" \n")).otherwise(F.lit("x")).alias("html"))
    return crawl.worth_retrying(rows).select("record_id")


def capped_frontier(spark: SparkSession, d: str) -> DataFrame:
    """A crawl from the page with most links with a cap of twelve pages (the crawl's page cap)."""
    edges = page_edges(spark, d).select("source", "target")
    root = edges.groupBy("source").agg(F.count("*").alias("n")).agg(F.max_by("source", F.struct("n", "source")).alias("url"))
    return Frontier(spark, work_path(spark, "frontier")).run(root, edges, max_depth=2, max_pages=12)


def queue_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl would go on with: the addresses of depth 2 queued, those of depth 1 in flight."""
    records = table(spark, d, "page_records").where("normalized_url IS NOT NULL").select(F.col("normalized_url").alias("url"), "depth").distinct()
    return snapshot(records.where("depth = 2"), records.where("depth = 1"))


def artefact_purge(spark: SparkSession, d: str) -> DataFrame:
    """Records left by host after those of addresses with status 404 were removed, and how many were."""
    records = table(spark, d, "page_records")
    matches, _ = crawl.status_scan(records, 404)
    left, removed = crawl.purge(records, matches)
    both = left.select("domain", F.lit(0).alias("gone")).unionByName(removed.select("domain", F.lit(1).alias("gone")))
    return both.groupBy("domain").agg(F.count_if(F.col("gone") == 0).alias("left"), F.count_if(F.col("gone") == 1).alias("removed"))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a crawl written to its manifest and read back."""
    path = work_path(spark, "manifest")
    pages = table(spark, d, "raw_pages").select("page_id", "status_code").distinct()
    files.write_manifest(pages.agg(F.lit("all").alias("university_name"), F.count_if(F.col("status_code") == 200).alias("pages_saved"), F.count_if(F.col("status_code") == 304).alias("pages_skipped"), F.count_if(F.col("status_code") >= 400).alias("errors")), path)
    return files.manifest_counts(spark, path, -1).select(*[F.col(c).cast("long").alias(c) for c in ("pages_saved", "pages_skipped", "errors")])


def raw_html_store(spark: SparkSession, d: str) -> DataFrame:
    """The html of all fetches in a store by content, the second half added to what the first left there."""
    path, pages = work_path(spark, "html"), table(spark, d, "raw_pages").where("html IS NOT NULL").select("university_id", "page_id", "url", "html")
    files.write_raw_html(pages.where("page_id % 2 = 0"), path)
    files.write_raw_html(pages.where("page_id % 3 > 0"), path)
    files.write_raw_html(pages, path)
    return files.raw_html(spark, path).select("university_id", "content_hash", F.length("html").alias("chars"))


def url_labels(spark: SparkSession, d: str) -> DataFrame:
    """Short labels of the stored addresses, and the department their path names."""
    return table(spark, d, "documents").select("doc_id", fn.url_label_col(F.col("url")).alias("label"), urls.department_col(F.col("url")).alias("department"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first line of every chunk."""
    return chunk_table(spark, d).where("text IS NOT NULL").select("chunk_id", fn.first_line_col(F.col("text")).alias("line"))


def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users with an open session at a fixed instant, found by the hash of the token they send."""
    stored = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen")).select("user_id", fn.token_hash_col(F.concat(F.lit("token-"), F.col("user_id").cast("string"))).alias("token_hash"), (F.col("seen").cast("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"))
    sent = table(spark, d, "customer").select(F.col("c_custkey").alias("caller"), F.concat(F.lit("token-"), F.col("c_custkey").cast("string")).alias("token"))
    now = table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("now"))
    return sessions.authenticated(sent, stored, now).select("caller", "user_id")


def open_api_keys(spark: SparkSession, d: str) -> DataFrame:
    """Callers whose key isn't revoked, every third one being so."""
    keys = table(spark, d, "supplier").select("s_suppkey", fn.token_hash_col(F.concat(F.lit("key-"), F.col("s_suppkey").cast("string"))).alias("token_hash"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("2025-01-01").cast("timestamp")).alias("revoked_at"))
    sent = table(spark, d, "customer").select(F.col("c_custkey").alias("caller"), F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("token"))
    return sessions.open_keys(sent, keys).select("caller")


def message_append(spark: SparkSession, d: str) -> DataFrame:
    """Conversations, one a domain, after every question asked there and its placeholder reply were appended."""
    turns = table(spark, d, "search_results").select(F.col("domain").alias("conversation"), F.col("query_id").alias("turn"), F.col("query_text").alias("question")).distinct().withColumn("reply", F.concat(F.lit("re: "), "question"))
    return sessions.append_turns(None, turns)


def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.literal_col(F.col("embedding")).alias("literal"))


def embedding_plan(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the digest of what is embedded and the length of their vector, those of active documents from a cache."""
    chunks = table(spark, d, "chunks").select("chunk_id", "document_id", "heading_trail", "text").distinct()
    active = table(spark, d, "indexed_documents").where("status = 'active'").select("document_id").distinct()
    empty = spark.createDataFrame([], "content_hash string, model_id string, embedding array<double>")
    make, model = (lambda: providers.provider("embedder", "digest")), "digest-128"
    _, cache = providers.embed_missing(chunks.join(active, "document_id", "left_semi"), empty, make, model)
    done, _ = providers.embed_missing(chunks, cache, make, model)
    return done.select("chunk_id", "content_hash", F.size("embedding").alias("dim"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """People named with a title, once a document."""
    return providers.extract_entities(table(spark, d, "chunks").select("chunk_id", "document_id", "text").distinct()).select("document_id", "chunk_id", "name")


def upgraded_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question as the offline upgrader rewrites it; those of under three characters aren't asked."""
    return providers.upgrade_questions(asked(spark, d), "identity").select("query_id", "original", "upgraded")


def weak_queries(spark: SparkSession, d: str) -> DataFrame:
    """Questions of which no result reaches a reranker's score of a half, and those rated lowest on average."""
    best = table(spark, d, "search_results").groupBy("query_id").agg(F.max(F.when(~F.isnan("rerank_score"), F.col("rerank_score"))).alias("best"), F.count("*").alias("rows"))
    return best.where("best IS NULL OR best < 0.5").select("query_id", F.round("best", 6).alias("best"))


def corpus_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every page's sections, numbered through the page before blank ones fall out."""
    from ..functions import chunking

    pages = table(spark, d, "raw_pages").where("status_code = 200").select("page_id", "url", "html").distinct()
    cut = F.flatten(F.transform("s", lambda x: F.transform(x["chunks"], lambda c: F.struct(x["heading"].alias("heading"), c.alias("text")))))
    sectioned = pages.select("page_id", urls.document_id_col(F.col("url")).alias("document_id"), F.posexplode(html.sections_udf("html")).alias("n", "x")).select("page_id", "document_id", "n", "x.heading", chunking.sentence_chunks_udf()("x.text").alias("chunks"))
    listed = sectioned.groupBy("page_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("n", "heading", "chunks"))).alias("s"))  # one page's sections
    return listed.select("page_id", "document_id", F.posexplode(cut).alias("position", "c")).where(F.trim("c.text") != "").select("page_id", F.concat_ws(":", "document_id", F.col("position").cast("string")).alias("chunk_id"), "c.heading", "c.text", "position")


QUERIES = {f.__name__: f for f in (robots_decisions, sitemap_pages, seed_urls, stored_edges, outgoing_links, admission_reasons, checkpoint_states, retried_fetches, capped_frontier, queue_snapshot, artefact_purge, manifest_counts, raw_html_store, url_labels, first_lines, active_sessions, open_api_keys, message_append, vector_literals, embedding_plan, entities, upgraded_questions, weak_queries, corpus_chunks)}

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim({0}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '')"
_PATH = r"regexp_extract(trim({0}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"
_SKIPPED = r"(?i)\.(pdf|zip|doc|docx|ppt|pptx|xls|xlsx|jpg|jpeg|png|gif|svg|webp|mp4|mp3|avi|mov|dmg|exe)$"
_RULES = f"rules AS (SELECT regexp_replace(lower(domain), '^www\\.', '') AS host FROM universities WHERE length(domain) % 5 <> 0)"
_BARRED = "({host} IN (SELECT host FROM rules) AND starts_with({path}, '/news') AND NOT starts_with({path}, '/news/2025'))"
_SPACES = r"[\s\pZ\x{85}\x{0B}\x{1c}-\x{1f}]+"

SQL = {
    "robots_decisions": f"WITH {_RULES} SELECT url, NOT {_BARRED.format(host=_HOST.format('url'), path=_PATH.format('url'))} AS allowed FROM (SELECT DISTINCT url FROM raw_pages)",
    "sitemap_pages": "SELECT DISTINCT 'https://' || domain || p AS url FROM universities, (SELECT unnest(['/', '/news', '/staff']) AS p)",
    "seed_urls": "SELECT DISTINCT 'https://' || h || p AS url FROM (SELECT unnest([domain, 'en.' || domain]) AS h, length(domain) % 2 AS odd FROM universities) JOIN (SELECT unnest(['/courses', '/news', '/']) AS p, unnest([0, 0, 1]) AS odd) USING (odd)",
    "stored_edges": f"WITH {_PART} SELECT DISTINCT source, target, type FROM edges",
    "outgoing_links": rf"""
        WITH pages AS (SELECT DISTINCT url, html FROM raw_pages WHERE status_code = 200),
        hrefs AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, '<a href=["'']([^"'']*)["'']', 1))) AS h FROM pages),
        t AS (SELECT url AS source, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/]*') || h WHEN h LIKE '#%' THEN regexp_replace(url, '#.*$', '') ELSE regexp_replace(h, '#.*$', '') END AS target FROM hrefs),
        p AS (SELECT source, lower(regexp_extract(target, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(target, '^[A-Za-z]+://([^/?#]*)', 1)) AS net, regexp_extract(target, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(target, '\?([^#]*)', 1) AS q FROM t),
        r AS (SELECT source, scheme || '://' || CASE WHEN scheme = 'https' THEN regexp_replace(net, ':443$', '') ELSE regexp_replace(net, ':80$', '') END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS target FROM p WHERE net <> '')
        SELECT source, target, count(*) AS times FROM r WHERE ({_HOST.format('target')} = {_HOST.format('source')} OR ends_with({_HOST.format('target')}, '.' || {_HOST.format('source')})) AND NOT regexp_matches({_PATH.format('target')}, '{_SKIPPED}') GROUP BY source, target""",
    "admission_reasons": rf"""
        WITH {_RULES}, h AS (SELECT *, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM page_records), u AS (SELECT DISTINCT lower(domain) AS dom FROM universities),
        m AS (SELECT h.*, EXISTS (SELECT 1 FROM u WHERE h.host = u.dom OR ends_with(h.host, '.' || u.dom)) AS inside, url IN (SELECT url FROM raw_pages WHERE regexp_matches(html, '[^\s]') AND url IS NOT NULL) AS stored FROM h)
        SELECT CASE WHEN depth > 3 THEN 'max_depth' WHEN NOT inside THEN 'out_of_domain' WHEN NOT regexp_matches(url, '(?i)^https?:') OR regexp_matches(path, '{_SKIPPED}') THEN 'policy'
          WHEN {_BARRED.format(host='host', path='path')} THEN 'robots' WHEN stored THEN 'existing' WHEN {_HOST.format('normalized_url')} <> host THEN 'redirect'
          WHEN content_type NOT ILIKE '%html%' THEN 'non_html' WHEN size_bytes = 0 THEN 'empty' ELSE 'taken' END AS reason, count(*) AS records FROM m GROUP BY ALL""",
    "checkpoint_states": "SELECT university_id, CASE length(domain) % 4 WHEN 1 THEN 'incompatible-root-url' WHEN 0 THEN 'ok' ELSE 'corrupt' END AS state FROM universities",
    "retried_fetches": "SELECT record_id FROM page_records WHERE CASE WHEN depth = 2 THEN 202 ELSE status_code END = 202 AND content_type ILIKE '%html%' AND length(url) % 3 = 0",
    "capped_frontier": f"""WITH {_EDGES}, l0 AS (SELECT source AS url FROM edges GROUP BY source ORDER BY count(*) DESC, source DESC LIMIT 1),
        l1 AS (SELECT DISTINCT target AS url FROM edges WHERE source IN (SELECT url FROM l0) AND target NOT IN (SELECT url FROM l0) ORDER BY url LIMIT 11),
        l2 AS (SELECT DISTINCT target AS url FROM edges WHERE source IN (SELECT url FROM l1) AND target NOT IN (SELECT url FROM l0 UNION SELECT url FROM l1) ORDER BY url LIMIT (SELECT 11 - count(*) FROM l1))
        SELECT url, 0 AS depth FROM l0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2""",
    "queue_snapshot": "SELECT normalized_url AS url, min(depth) AS depth FROM page_records WHERE normalized_url IS NOT NULL AND depth IN (1, 2) GROUP BY normalized_url",
    "artefact_purge": "WITH g AS (SELECT DISTINCT normalized_url AS u FROM page_records WHERE status_code = 404 AND normalized_url IS NOT NULL) SELECT domain, count(*) FILTER (u IS NULL) AS left, count(*) FILTER (u IS NOT NULL) AS removed FROM page_records LEFT JOIN g ON u = normalized_url GROUP BY domain",
    "manifest_counts": "SELECT count(*) FILTER (status_code = 200) AS pages_saved, count(*) FILTER (status_code = 304) AS pages_skipped, count(*) FILTER (status_code >= 400) AS errors FROM (SELECT DISTINCT page_id, status_code FROM raw_pages)",
    "raw_html_store": "SELECT DISTINCT university_id, sha256(html) AS content_hash, length(html)::INT AS chars FROM raw_pages WHERE html IS NOT NULL",
    "url_labels": f"SELECT doc_id, CASE WHEN length(b) > 56 THEN substr(b, 1, 53) || '...' ELSE b END AS label, nullif(split_part(ltrim({_PATH.format('url')}, '/'), '/', 1), '') AS department FROM (SELECT doc_id, url, regexp_replace(regexp_replace(url, '(?i)^https?://', ''), '/$', '') AS b FROM documents)",
    "first_lines": rf"""WITH l AS (SELECT chunk_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\pZ\x{{85}}\x{{0B}}\x{{1c}}-\x{{1f}}]'))[1] AS x FROM ({CHUNKS}) WHERE text IS NOT NULL)
        SELECT chunk_id, trim(regexp_replace(regexp_replace(trim(x), '^["''`]+|["''`]+$', '', 'g'), '{_SPACES}', ' ', 'g')) AS line FROM l""",
    "active_sessions": "WITH s AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) SELECT c_custkey AS caller, user_id FROM s JOIN customer ON c_custkey = user_id WHERE seen + INTERVAL 3 DAY > (SELECT max(ts) FROM events)",
    "open_api_keys": "SELECT c_custkey AS caller FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE s_suppkey % 3 <> 0",
    "message_append": """WITH t AS (SELECT DISTINCT domain AS conversation, query_id AS turn, query_text AS q FROM search_results), m AS (SELECT conversation, turn, 'user' AS role, q AS content FROM t UNION ALL SELECT conversation, turn, 'assistant', 're: ' || q FROM t)
        SELECT conversation, row_number() OVER (PARTITION BY conversation ORDER BY turn, role DESC) AS seq, role, content FROM m""",
    "vector_literals": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings",
    "embedding_plan": "SELECT chunk_id, sha256(CASE WHEN len(heading_trail) > 0 THEN array_to_string(heading_trail, ' > ') || chr(10) || chr(10) || text ELSE text END) AS content_hash, CASE WHEN text IS NULL THEN NULL ELSE 128 END AS dim FROM (SELECT DISTINCT chunk_id, document_id, heading_trail, text FROM chunks)",
    "entities": r"""WITH e AS (SELECT document_id, chunk_id, unnest(regexp_extract_all(text, '\b(?:Dr|Prof|Mr|Ms)\.?\s+(?:[A-Z]\.\s+)*([A-Z][\pL\pN_-]+)', 1)) AS name FROM (SELECT DISTINCT chunk_id, document_id, text FROM chunks WHERE text IS NOT NULL))
        SELECT document_id, chunk_id, name FROM e QUALIFY row_number() OVER (PARTITION BY document_id, lower(name) ORDER BY chunk_id, name) = 1""",
    "upgraded_questions": rf"SELECT query_id, query_text AS original, trim(regexp_replace(query_text, '{_SPACES}', ' ', 'g')) AS upgraded FROM ({ASKED}) WHERE length(trim(query_text)) >= 3",
    "weak_queries": "SELECT query_id, round(b, 6) AS best FROM (SELECT query_id, max(CASE WHEN NOT isnan(rerank_score) THEN rerank_score END) AS b FROM search_results GROUP BY query_id) WHERE b IS NULL OR b < 0.5",
}
