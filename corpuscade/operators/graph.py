"""Link graphs: edge lists, adjacency, degrees, breadth-first depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scalars, written

EDGE_TYPES = ("link", "redirect")
#: Rounds of a traversal after which its tables are merged.
MERGE = 8


def edges_of(link_files: DataFrame) -> DataFrame:
    """``source, target, type, ord`` of stored page links, old and new form.

    New: ``edges`` of (target, type).  Old: ``redirect_to``, which comes first, and
    ``outgoing_links``.  Entries without target or of another type, and rows without source,
    are left out; of several files of one source the last by ``ord_file`` counts, if it has one.
    """
    old = F.concat(F.when(F.col("redirect_to").isNotNull(), F.array(F.struct(F.col("redirect_to").alias("target"), F.lit("redirect").alias("type")))).otherwise(F.array().cast("array<struct<target:string,type:string>>")), F.transform(F.coalesce("outgoing_links", F.array().cast("array<string>")), lambda t: F.struct(t.alias("target"), F.lit("link").alias("type"))))
    files = link_files.where(F.col("source").isNotNull())
    if "ord_file" in files.columns:
        files = files.groupBy("source").agg(F.max_by(F.struct("edges", "redirect_to", "outgoing_links"), "ord_file").alias("l")).select("source", "l.*")
    every = files.select("source", F.posexplode(F.coalesce("edges", old)).alias("ord", "e")).select("source", "e.target", "e.type", "ord")
    return every.where(F.col("target").isNotNull() & (F.col("target") != "") & F.col("type").isin(*EDGE_TYPES))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: distinct nodes, edges with their repeats, links and redirects."""
    count = scalars(nodes(edges).agg(F.count("*").alias("node_count")))
    return edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("type") == "link").alias("links"), F.count_if(F.col("type") == "redirect").alias("redirects")).withColumns(count)


def adjacency(edges: DataFrame) -> DataFrame:
    """``source, targets``: (type, target) in order; a page's own links, so a bounded list."""
    return edges.groupBy("source").agg(F.array_sort(F.collect_set(F.struct("type", "target"))).alias("targets"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree``; ends are counted before they meet, so a hub costs a row a task."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, direction, type, other`` of the nodes in ``wanted``."""
    out = edges.join(wanted, edges["source"] == wanted["node"]).select("node", F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    into = edges.join(wanted, edges["target"] == wanted["node"]).select("node", F.lit("in").alias("direction"), "type", F.col("source").alias("other"))
    return out.unionByName(into).distinct()


def depths(edges: DataFrame, roots: DataFrame, cost: Column | None = None, max_depth: int | None = None) -> DataFrame:
    """``node, depth``: the smallest cost from any root; nodes that can't be reached aren't listed.

    ``cost`` of an edge is 1 unless given, and must be 0 or more.  One round joins the frontier,
    the nodes whose depth changed last, with the edges, and keeps the minimum a node.  A round
    writes its frontier only, so the plan doesn't grow and a lost executor costs a round at most;
    every ``MERGE`` rounds the frontiers so far become one table.  Rounds end when no depth
    changes; only whether one did reaches the driver.
    """
    priced = written(edges.select("source", "target", (F.lit(1) if cost is None else cost).alias("cost")).groupBy("source", "target").agg(F.min("cost").alias("cost")), "edges")
    last = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    parts = [last]

    def known() -> DataFrame:
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        return every.groupBy("node").agg(F.min("depth").alias("depth"))

    while not last.isEmpty():
        reached = last.join(priced, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("depth") + F.col("cost")).alias("depth"))
        if max_depth is not None:
            reached = reached.where(F.col("depth") <= max_depth)
        news = reached.groupBy("node").agg(F.min("depth").alias("depth"))
        had = known().select(F.col("node").alias("k"), F.col("depth").alias("had"))
        last = written(news.join(had, F.col("node") == F.col("k"), "left").where("had IS NULL OR depth < had").select("node", "depth"), "frontier")
        parts = [written(known(), "depths"), last] if len(parts) >= MERGE else [*parts, last]
    return known()


def all_depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Depths with nodes out of reach one deeper than the deepest."""
    reached = depths(edges, roots)
    beyond = reached.agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("beyond"))
    return nodes(edges).join(reached, "node", "left").select("node", F.coalesce("depth", scalars(beyond)["beyond"]).alias("depth"))


def crawl_depths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Depths where a redirect costs nothing and a link 1."""
    return depths(edges, roots, F.when(F.col("type") == "redirect", 0).otherwise(1), max_depth)


def scoped_depths(edges: DataFrame, seeds: DataFrame, in_scope: DataFrame, outside_depth: int, max_depth: int) -> DataFrame:
    """``node, depth, outside_hops``: a crawl that may leave its scope for some hops.

    A node in scope has 0 hops.  One outside has 1 if its parent is in scope, else one more than
    the parent; beyond ``outside_depth`` it isn't entered.  Per node the smallest (depth, hops)
    counts, but a state with fewer hops at a larger depth is followed too, as it may reach
    further.  ``in_scope``: the nodes in scope, as ``node``.
    """
    inside = in_scope.select("node").distinct().withColumn("inside", F.lit(True))
    ends = edges.select("source", "target").distinct().join(inside.withColumnRenamed("node", "target"), "target", "left").select("source", "target", F.coalesce("inside", F.lit(False)).alias("inside"))
    ends = written(ends, "edges")
    start = seeds.select("node").distinct().join(inside, "node", "left").select("node", F.lit(0).alias("depth"), F.when(F.col("inside"), 0).otherwise(1).alias("hops")).where(F.col("hops") <= outside_depth)
    states = written(start.withColumn("fresh", F.lit(True)), "states")
    for level in range(1, max_depth + 1):
        grown = states.where("fresh").join(ends, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.lit(level).alias("depth"), F.when(F.col("inside"), 0).otherwise(F.col("hops") + 1).alias("hops")).where(F.col("hops") <= outside_depth)
        least = grown.groupBy("node").agg(F.min("hops").alias("hops"))
        known = states.groupBy("node").agg(F.min("hops").alias("had"))
        news = least.join(known, "node", "left").where(F.col("had").isNull() | (F.col("hops") < F.col("had"))).select("node", F.lit(level).alias("depth"), "hops", F.lit(True).alias("fresh"))
        news = written(news, "states")
        if news.isEmpty():
            break
        states = states.withColumn("fresh", F.lit(False)).unionByName(news)
    return states.groupBy("node").agg(F.min(F.struct("depth", F.col("hops").alias("outside_hops"))).alias("s")).select("node", "s.*")


def ring_layout(depth: DataFrame, gap: float = 120.0) -> DataFrame:
    """``node, depth, x, y``: nodes on a circle a depth, evenly spread in the order of their names."""
    from .ranking import grouped_rank

    sizes = depth.groupBy("depth").agg(F.count("*").alias("size"))
    placed = grouped_rank(depth, ["depth"], ["node"], "at").join(sizes, "depth")
    angle = 2 * F.pi() * (F.col("at") - 1) / F.col("size")
    return placed.select("node", "depth", (F.col("depth") * gap * F.cos(angle)).alias("x"), (F.col("depth") * gap * F.sin(angle)).alias("y"))


def find_nodes(edges: DataFrame, text: str, most: int = 40, most_blank: int = 20) -> DataFrame:
    """Nodes that contain ``text`` without case, the first ``most`` by name (a search box)."""
    wanted = nodes(edges).where(F.contains(F.lower("node"), F.lit(text.strip().lower())))
    return wanted.orderBy("node").limit(most if text.strip() else most_blank)


