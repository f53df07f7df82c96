"""Queries over the link graph of the fetched pages and over a graph derived from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..operators import graph
from ..session import scalars
from .common import table


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of every fetched page to absolute addresses."""
    pages = table(spark, d, "raw_pages").where("status_code = 200").select("url", "html").distinct()
    return pages.select(F.col("url").alias("source"), F.explode(html.links_udf("html", "url")).alias("target")).distinct().withColumn("type", F.lit("link"))


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """A graph over the parts' keys: three targets each, every fifth one a redirect."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    size = table(spark, d, "part").agg(F.count("*").alias("n"))
    target = F.explode(F.array(F.struct((F.col("k") * 7 + F.col("s")).alias("t"), F.lit(1).alias("m")), F.struct((F.col("k") * 3 + 2).alias("t"), F.lit(2).alias("m")), F.struct((F.col("k") + F.col("s") * 11).alias("t"), F.lit(3).alias("m"))))
    made = parts.select("k", scalars(size)["n"].alias("n"), target.alias("e")).where("k % 4 <> 3 OR e.m = 1")
    return made.select(F.col("k").alias("source"), (F.col("e.t") % F.col("n") + 1).alias("target"), F.when((F.col("k") + F.col("e.m")) % 5 == 0, "redirect").otherwise("link").alias("type"))


def _roots(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).cast("long").alias("node"))


def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return page_edges(spark, d).select("source", "target")


def link_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(page_edges(spark, d))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Targets of every page, as one line."""
    return graph.adjacency(page_edges(spark, d)).select("source", F.array_join(F.transform("targets", lambda t: t["target"]), " ").alias("targets"))


def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(page_edges(spark, d))


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the parts that are divisible by 50."""
    edges = part_edges(spark, d)
    return graph.neighbours(edges, graph.nodes(edges).where("node % 50 = 0"))


def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.all_depths(part_edges(spark, d), _roots(spark))


def crawl_depth_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Depths from the first part where redirects cost nothing."""
    return graph.crawl_depths(part_edges(spark, d), _roots(spark))


def outside_hops_bfs(spark: SparkSession, d: str) -> DataFrame:
    """A crawl from the first part; parts divisible by 3 are outside, two hops there are allowed."""
    edges = part_edges(spark, d)
    scope = graph.nodes(edges).where("node % 3 <> 0")
    return graph.scoped_depths(edges, _roots(spark), scope, 2, 5)


def ring_layout(spark: SparkSession, d: str) -> DataFrame:
    placed = graph.ring_layout(bfs_depth(spark, d))
    return placed.select("node", "depth", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


def find_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The first forty addresses of the link graph that contain a text (a search box)."""
    return graph.find_nodes(page_edges(spark, d), "FACULTY")


QUERIES = {f.__name__: f for f in (extract_links, link_graph_stats, adjacency, degree, neighbors, bfs_depth, crawl_depth_redirect, outside_hops_bfs, ring_layout, find_nodes)}

_EDGES = r"""
    pages AS (SELECT DISTINCT url, html FROM raw_pages WHERE status_code = 200),
    hrefs AS (SELECT url, unnest(regexp_extract_all(html, '<a href=["'']([^"'']*)["'']', 1)) AS h FROM pages),
    edges AS (SELECT DISTINCT url AS source, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/]*') || h WHEN h LIKE '#%' THEN regexp_replace(url, '#.*$', '') || CASE WHEN h = '#' THEN '' ELSE h END ELSE h END AS target FROM hrefs)"""
_PART = """
    n AS (SELECT count(*) AS n FROM part),
    raw AS (SELECT p_partkey AS k, unnest([p_partkey * 7 + p_size, p_partkey * 3 + 2, p_partkey + p_size * 11]) AS t, unnest([1, 2, 3]) AS m FROM part),
    edges AS (SELECT k AS source, t % n + 1 AS target, CASE WHEN (k + m) % 5 = 0 THEN 'redirect' ELSE 'link' END AS type FROM raw, n WHERE k % 4 <> 3 OR m = 1)"""

SQL = {
    "ring_layout": f"""WITH RECURSIVE {_PART}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE w.depth < 40), r AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
        d AS (SELECT a.node, coalesce(depth, (SELECT max(depth) + 1 FROM r)) AS depth FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) a LEFT JOIN r ON r.node = a.node),
        p AS (SELECT node, depth, 2 * pi() * (row_number() OVER (PARTITION BY depth ORDER BY node) - 1) / count(*) OVER (PARTITION BY depth) AS t FROM d)
        SELECT node, depth, round(depth * 120.0::DOUBLE * cos(t), 3) + 0.0 AS x, round(depth * 120.0::DOUBLE * sin(t), 3) + 0.0 AS y FROM p""",
    "extract_links": f"WITH {_EDGES} SELECT source, target FROM edges",
    "link_graph_stats": f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)) AS node_count, count(*) AS edge_count, count(*) AS links, 0 AS redirects FROM edges",
    "adjacency": f"WITH {_EDGES} SELECT source, string_agg(target, ' ' ORDER BY target) AS targets FROM edges GROUP BY source",
    "degree": f"WITH {_EDGES} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY node",
    "neighbors": f"WITH {_PART} SELECT source AS node, 'out' AS direction, type, target AS other FROM edges WHERE source % 50 = 0 UNION SELECT target, 'in', type, source FROM edges WHERE target % 50 = 0",
    "bfs_depth": f"WITH RECURSIVE {_PART}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE w.depth < 40), r AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node) SELECT a.node, coalesce(depth, (SELECT max(depth) + 1 FROM r)) AS depth FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) a LEFT JOIN r ON r.node = a.node",
    "crawl_depth_redirect": f"WITH RECURSIVE {_PART}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.target, w.depth + CASE WHEN e.type = 'redirect' THEN 0 ELSE 1 END FROM walk w JOIN edges e ON e.source = w.node WHERE w.depth < 40) SELECT node, min(depth) AS depth FROM walk GROUP BY node",
    "outside_hops_bfs": f"""WITH RECURSIVE {_PART}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth, 0 AS hops UNION SELECT e.target, w.depth + 1, CASE WHEN e.target % 3 <> 0 THEN 0 ELSE w.hops + 1 END FROM walk w JOIN edges e ON e.source = w.node WHERE w.depth < 5 AND (e.target % 3 <> 0 OR w.hops < 2))
        SELECT node, depth, hops AS outside_hops FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, hops) = 1""",
    "find_nodes": f"WITH {_EDGES} SELECT node FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) WHERE contains(lower(node), 'faculty') ORDER BY node LIMIT 40",
}
