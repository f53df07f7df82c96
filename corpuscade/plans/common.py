"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, each once, without their vectors."""
    return table(spark, sf_dir, "chunks").select("chunk_id", "document_id", "university_id", "domain", "url", "heading", "text", "position").distinct()


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct questions of search_results."""
    return table(spark, sf_dir, "search_results").select("query_id", "query_text").distinct()


#: SQL for the same tables.
CHUNKS = "SELECT DISTINCT chunk_id, document_id, university_id, domain, url, heading, text, position FROM chunks"
ASKED = "SELECT DISTINCT query_id, query_text FROM search_results"


def tokens_sql(column: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({column}, ''), '[a-zA-Z0-9]+'), lambda t: lower(t))"
