"""Queries of the core operators by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import canonical_url_col
from .operators import capture, compaction
from .plans import answers, documents, graph, lexical, monitor, retrieval, services, tables
from .session import scalars, work_path

PLANS = (lexical, retrieval, documents, answers, graph, tables, monitor, services)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- problem 5: only new or changed records -------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The fetches that are new or changed, from one captured batch over the whole log."""
    log, stored = capture.ChangeLog(spark), table(spark, d, "indexed_documents")
    log.append(capture.fetch_records(table(spark, d, "raw_pages")))
    feed = capture.ChangeCapture(spark, log)
    number = feed.run(lambda part: capture.changed_fetches(part, stored))
    return feed.changes(number).select("page_id")


def p5_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same in two batches cut at the middle of the arrivals, the second one failing before
    its commit and run again: the sink's state per url, with the kind of change."""
    log, stored, pages = capture.ChangeLog(spark), table(spark, d, "indexed_documents"), table(spark, d, "raw_pages")
    feed = capture.ChangeCapture(spark, log)
    cut = table(spark, d, "crawl_runs").where("run_status = 'success'").agg(F.percentile_approx("started_at", 0.5).alias("c"))
    early = F.coalesce(F.col("ingested_at") <= scalars(cut)["c"], F.lit(False))

    def process(part: DataFrame) -> DataFrame:
        return capture.resolved_fetches(part, stored, feed.latest())

    class Lost(RuntimeError):
        pass

    def fail(_: int) -> None:
        raise Lost

    log.append(capture.fetch_records(pages.where(early)))
    feed.run(process)
    log.append(capture.fetch_records(pages.where(~early)))
    try:
        feed.run(process, before_commit=fail)
    except Lost:
        feed.run(process)
    return feed.state().select("url", "page_id", "change")


# --- problem 7: far too many small files ----------------------------------------------------

RECORD = "record_id long, domain string, file_path string, file_bytes long, url string, normalized_url string, status_code int, content_type string, depth double, size_bytes double, fetched_at string"


def small_files(spark: SparkSession, d: str) -> DataFrame:
    """The stored files of page_records as their bytes: one JSON line a record, in fragments."""
    records = table(spark, d, "page_records")
    line = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    return records.select(F.coalesce("file_path", F.lit("")).alias("path"), F.col("record_id").alias("part"), F.encode(line, "UTF-8").alias("content"))


def compacted_records(spark: SparkSession, d: str, target_bytes: int = 32 << 20) -> DataFrame:
    """The records read from the compacted files, with canonical url and instant."""
    out = work_path(spark, "compacted")
    manifest = compaction.compact(small_files(spark, d), out, target_bytes)
    bad, fragments = compaction.validate(manifest).agg(F.count_if(~F.col("ok")), F.coalesce(F.sum("fragments"), F.lit(0))).first()
    if bad or fragments != table(spark, d, "page_records").count():
        raise RuntimeError(f"{bad} compacted files differ from what was written, {fragments} records were joined")
    read = spark.read.schema(RECORD).json(out)
    instant = F.expr("try_cast(nullif(trim(fetched_at), '') AS timestamp)")
    return read.withColumns({"canonical": canonical_url_col(F.col("normalized_url")), "instant": instant})


def p7_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The files that compaction writes, with what went into each and whether it read back the same."""
    written_files = compaction.validate(compaction.compact(small_files(spark, d), work_path(spark, "compacted"), 4 << 20))
    return written_files.select("bin", "files", "fragments", "bytes_in", "bytes_added", "bytes_out", "ok")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records with one address and one instant."""
    keyed = compacted_records(spark, d).where("canonical IS NOT NULL AND instant IS NOT NULL").select("record_id", "canonical", "instant").distinct()
    a, b = keyed.withColumnRenamed("record_id", "record_a"), keyed.withColumnRenamed("record_id", "record_b")
    return a.join(b, ["canonical", "instant"]).where("record_a < record_b").select("record_a", "record_b").distinct()


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every record once: the smallest record_id of each address and instant, with its copies;
    records without a readable address or instant stand for themselves."""
    keyed = compacted_records(spark, d)
    own = F.when(F.col("canonical").isNull() | F.col("instant").isNull(), F.col("record_id"))
    return keyed.groupBy("canonical", "instant", own.alias("own")).agg(F.min("record_id").alias("record_id"), F.countDistinct("record_id").alias("copies")).select("record_id", "copies")


def queries() -> dict:
    own = {"p5_found": p5_found, "p5_resumed": p5_resumed, "p7_found": p7_found, "p7_kept": p7_kept, "p7_manifest": p7_manifest}
    for plan in PLANS:
        own |= plan.QUERIES
    return own


def oracle_sql() -> dict[str, str]:
    changed = """
            WITH last AS (
              SELECT url, page_id, sha256(coalesce(html, '')) AS h,
                     row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, ingested_at DESC, page_id DESC) AS n
              FROM raw_pages WHERE status_code = 200),
            stored AS (
              SELECT url, status, lower(content_hash) AS h,
                     row_number() OVER (PARTITION BY url ORDER BY last_crawled DESC, status DESC, content_hash DESC, document_id DESC) AS n
              FROM indexed_documents)
            SELECT {columns} FROM last l LEFT JOIN stored s ON l.url IS NOT DISTINCT FROM s.url AND s.n = 1
            WHERE l.n = 1 AND (s.n IS NULL OR s.status IS DISTINCT FROM 'active' OR s.h IS DISTINCT FROM l.h)"""
    own = {
        "p5_found": changed.format(columns="l.page_id"),
        "p5_resumed": changed.format(columns="l.url, l.page_id, CASE WHEN s.n IS NULL THEN 'new' WHEN s.status IS DISTINCT FROM 'active' THEN 'inactive' ELSE 'changed' END AS change"),
    }
    keyed = r"""
            WITH p AS (SELECT DISTINCT record_id, lower(regexp_extract(normalized_url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(normalized_url, '^[A-Za-z]+://([^/?#]*)', 1)) AS net,
              regexp_extract(normalized_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(normalized_url, '\?([^#]*)', 1) AS q, try_cast(nullif(trim(fetched_at), '') AS TIMESTAMPTZ) AS instant FROM page_records),
            r AS (SELECT record_id, instant, scheme, CASE WHEN scheme = 'https' THEN regexp_replace(net, ':443$', '') WHEN scheme = 'http' THEN regexp_replace(net, ':80$', '') ELSE net END AS net,
              regexp_replace(regexp_replace(path, '/[^/]+/\.\./', '/', 'g'), '/\./', '/', 'g') AS path,
              array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=|$)'))), '&') AS q FROM p),
            k AS (SELECT record_id, instant, CASE WHEN net <> '' THEN scheme || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM r)"""
    own["p7_found"] = keyed + """
            SELECT DISTINCT a.record_id AS record_a, b.record_id AS record_b FROM k a JOIN k b ON a.canonical = b.canonical AND a.instant = b.instant AND a.record_id < b.record_id"""
    own["p7_kept"] = keyed + """
            SELECT min(record_id) AS record_id, count(DISTINCT record_id) AS copies FROM k GROUP BY canonical, instant, CASE WHEN canonical IS NULL OR instant IS NULL THEN record_id END"""
    for plan in PLANS:
        own |= plan.SQL
    return own
