"""What plans must look like: pushed filters, pruned columns, no product, hot groups spread."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from corpuscade import queries
from corpuscade.operators import lexical, ranking
from corpuscade.operators.capture import fetch_records, latest_fetches

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["hybrid_search", "bm25_search_topk", "rrf_fusion", "neighbor_expand", "evidence_select", "upsert_documents", "skip_reasons", "cascade_delete", "link_graph_stats", "metadata_filter", "eval_retrieval_metrics"])
def test_no_product_of_tables(spark, name):
    shown = plan(queries.queries()[name](spark, DATA))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_filters_and_columns_reach_the_scan(spark):
    shown = plan(queries.queries()["metadata_filter"](spark, DATA))
    assert "PushedFilters: [IsNotNull(status), In(page_type" in shown or "EqualTo(status,active)" in shown
    assert "embedding" not in shown and "heading_trail" not in shown
    assert "embedding" not in plan(queries.queries()["neighbor_expand"](spark, DATA))


def test_only_digests_are_shuffled(spark):
    pages = fetch_records(spark.read.parquet(f"{DATA}/raw_pages.parquet")).withColumns({"__seg": F.lit(0), "__row": F.col("page_id")})
    shown = plan(latest_fetches(pages))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", shown)
    assert moved and not any("html" in m for m in moved)


def test_a_hot_group_spans_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("g"), "id")
    ranked = ranking.grouped_rank(df, ["g"], ["id"], "r")
    assert ranked.where("g = 0").agg(F.max("r")).first()[0] == df.where("g = 0").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share one partition
    try:
        laid = df.repartitionByRange(F.col("g"), F.col("id")).withColumn("p", F.spark_partition_id())
        assert laid.where("g = 0").select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    shown = plan(ranking.top_k_per_group(df, ["g"], [F.desc("id")], 2))
    tree = shown[: shown.index("\n\n\n")]
    assert tree.count("WindowGroupLimit") == 2 and tree.rindex("WindowGroupLimit") > tree.index("Exchange")
    assert ranking.top_k_per_group(df, ["g"], [F.desc("id")], 2000).count() == 1000


def test_postings_of_other_terms_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "c d")], "id long, t string")
    shown = plan(lexical.scores(docs, spark.createDataFrame([(0, "a")], "q long, s string"), "id", "t", "q", "s"))
    assert "LeftSemi" in shown


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, run in queries.queries().items():
        assert run(spark, DATA).schema.fieldNames(), name
