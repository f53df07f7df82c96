"""Readers and writers of the stored crawl artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "url string, normalized_url string, status_code int, content_type string, depth int, size_bytes long, fetched_at string, _corrupt string"
LINKS = "source_normalized_url string, outgoing_links array<string>, redirect_to string, edges array<struct<target:string,type:string>>, _corrupt string"
CHECKPOINT = "root_url string, queue array<struct<url:string,depth:int>>, visited array<string>, pages_saved int, pages_skipped int, errors int, saved_at string"
RAW_CHECKPOINT = "root_url string, queue array<array<string>>, visited array<string>, pages_saved int, pages_skipped int, errors int, saved_at string"
QUEUE = "unique_key string, url string, method string, payload string, headers map<string,string>, user_data struct<__crawlee:struct<enqueueStrategy:string,crawlDepth:int>>, retry_count int, no_retry boolean, loaded_url string, handled_at timestamp"
CURATED = "path string, filename string, url string, final_url string"
MANIFEST = "university_name string, pages_saved int, pages_skipped int, errors int, output_dir string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    if "_corrupt" in schema:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def page_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Page records, a JSON file each, with ``corrupt``: not an object, or without url or status."""
    rows = _json(spark, path, PAGE)
    return rows.withColumn("corrupt", F.col("_corrupt").isNotNull() | F.col("url").isNull() | F.col("status_code").isNull()).drop("_corrupt")


def page_links(spark: SparkSession, path: str) -> DataFrame:
    """Page links in the old and the new form, as :func:`corpuscade.operators.graph.edges_of` reads them."""
    rows = _json(spark, path, LINKS).where("_corrupt IS NULL AND source_normalized_url IS NOT NULL")
    return rows.select(F.col("source_normalized_url").alias("source"), "edges", "redirect_to", "outgoing_links")


def page_html(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of the stored pages that aren't blank."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    text = F.decode("content", "UTF-8")
    return raw.where("length > 0").select("path", text.alias("html")).where(F.col("html").rlike(r"(?U)\S"))


def curated_index(spark: SparkSession, path: str) -> DataFrame:
    """``file, url`` of a curated list; entries without a file name or url are left out."""
    rows = _json(spark, path, CURATED)
    return rows.select(F.coalesce("path", "filename").alias("file"), "url", "final_url").where("file IS NOT NULL AND url IS NOT NULL")


def crawl_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queued requests, a JSON file each."""
    return _json(spark, path, QUEUE).where("unique_key IS NOT NULL")


def frontier_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Frontier checkpoints with the queue's pairs as (url, depth); fields of another type become null."""
    rows = _json(spark, path, RAW_CHECKPOINT)
    queue = F.transform("queue", lambda q: F.struct(F.get(q, F.lit(0)).alias("url"), F.get(q, F.lit(1)).try_cast("int").alias("depth")))
    return rows.withColumn("queue", queue)


def manifest_counts(spark: SparkSession, path: str, fallback: int) -> DataFrame:
    """``pages_saved, pages_skipped, errors`` of a manifest; what is missing counts as ``fallback`` saved and 0."""
    rows = _json(spark, path, MANIFEST)
    return rows.agg(F.coalesce(F.max("pages_saved"), F.lit(fallback)).alias("pages_saved"), F.coalesce(F.max("pages_skipped"), F.lit(0)).alias("pages_skipped"), F.coalesce(F.max("errors"), F.lit(0)).alias("errors"))


def write_manifest(counts: DataFrame, path: str) -> None:
    """A crawl's manifest: one row as one JSON object."""
    counts.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_raw_html(pages: DataFrame, path: str, tenant: str = "university_id") -> None:
    """Add the html of pages to a store by content: each content of a tenant once, and none that is there already."""
    spark = pages.sparkSession
    keyed = pages.where("html IS NOT NULL").select(tenant, F.sha2("html", 256).alias("content_hash"), "html").dropDuplicates([tenant, "content_hash"])
    if exists(spark, path):
        keyed = keyed.join(raw_html(spark, path).select(tenant, "content_hash"), [tenant, "content_hash"], "left_anti")
    keyed.write.mode("append").partitionBy(tenant).parquet(path)


def raw_html(spark: SparkSession, path: str) -> DataFrame:
    """The store that :func:`write_raw_html` fills, tenant by tenant."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_pages(pages: DataFrame, path: str, tenant: str = "university_id") -> None:
    """Add fetched pages: a row for every address with its content's hash to ``path``/pages, and
    the html to the store by content at ``path``/html.  A row that is there already isn't added again."""
    spark = pages.sparkSession
    keyed = pages.withColumn("content_hash", F.sha2(F.coalesce("html", F.lit("")), 256)).drop("html").distinct()
    if exists(spark, f"{path}/pages"):
        old = spark.read.parquet(f"{path}/pages").select(tenant, "url", "content_hash").distinct()
        keyed = keyed.join(old, [tenant, "url", "content_hash"], "left_anti")
    keyed.write.mode("append").partitionBy(tenant).parquet(f"{path}/pages")
    write_raw_html(pages, f"{path}/html", tenant)


def write_links(edges: DataFrame, path: str) -> None:
    """A row a page with its edges in their order, as JSON lines."""
    edges.groupBy(F.col("source").alias("source_normalized_url")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target", "type"))), lambda e: F.struct(e["target"].alias("target"), e["type"].alias("type"))).alias("edges")).write.mode("overwrite").json(path)


def write_events(events: DataFrame, path: str) -> None:
    """Answer events as JSON lines, in order within a question."""
    events.repartition("query_id").sortWithinPartitions("query_id", "seq").write.mode("overwrite").json(path)


def write_url_list(urls: DataFrame, path: str) -> None:
    """Distinct addresses in order, a line each; files follow one another in order."""
    urls.select("url").distinct().orderBy("url").write.mode("overwrite").text(path)
