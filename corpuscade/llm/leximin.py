"""One ranking from scores on different scales: leximin over percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import grouped_rank, grouped_running_sum, top_k_per_group


def percentiles(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """``group, item, profile``: the item's percentiles within its group, one a score, sorted ascending.

    A percentile is (items with a lower score + half of those with an equal one) / items of the
    group, so only the order of a score matters, never its scale or spread.  A null or NaN score
    gives 0; infinite scores keep their place at the ends.  Repeated rows count once; of rows of
    one (group, item) with different scores, each score's maximum counts.  Null groups or items
    are values like others.  An empty table gives an empty result; other columns are ignored.

    Scores are melted and counted by distinct value first, so ties cost one row, and the
    cumulative counts run over range partitions: a group holding a third of the rows is spread.
    """
    one = df.groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(*[F.max(F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double"))).alias(f"s{k}") for k, s in enumerate(scores)])
    melted = one.select("g", "i", F.posexplode(F.array(*[f"s{k}" for k in range(len(scores))])).alias("k", "v"))
    values = melted.where("v IS NOT NULL").groupBy("g", "k", "v").agg(F.count("*").alias("c"))
    ranked = grouped_running_sum(values, ["g", "k"], ["v"], "c", "upto")
    sizes = one.groupBy("g").agg(F.count("*").alias("n"))
    lower = ranked.select(F.col("g").alias("rg"), F.col("k").alias("rk"), F.col("v").alias("rv"), (F.col("upto") - F.col("c") / 2).alias("mid"))
    placed = melted.join(lower, F.col("g").eqNullSafe(F.col("rg")) & (F.col("k") == F.col("rk")) & (F.col("v") == F.col("rv")), "left").drop("rg", "rk", "rv")
    vectors = placed.groupBy("g", "i").agg(F.sort_array(F.collect_list(F.coalesce("mid", F.lit(0.0)))).alias("mids"))  # as many entries as there are scores
    return vectors.join(sizes.withColumnRenamed("g", "sg"), F.col("g").eqNullSafe(F.col("sg"))).select(F.col("g").alias(group), F.col("i").alias(item), F.transform("mids", lambda m: m / F.col("n")).alias("profile"))


def leximin_ranking(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """Every item with its ``place`` from 1 in its group, in the order of :func:`leximin_top`.

    Numbered over range partitions, so a group of any size is ranked without gathering.
    """
    keys = [f"__w{n}" for n in range(len(scores))]
    turned = percentiles(df, group, item, scores).select(F.col(group), F.col(item), *[(-F.col("profile")[n]).alias(k) for n, k in enumerate(keys)])
    return grouped_rank(turned, [group], [*keys, item], "place").select(group, item, "place")


def leximin_top(df: DataFrame, group: str, item: str, scores: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` items of each group in leximin order, with ``profile`` and ``place``.

    Profiles are compared weakest entry first, the larger winning; an item can't make up for a
    weak score by a strong one.  Equal profiles are ordered by item.
    """
    ranked = percentiles(df, group, item, scores)
    order = [*[F.desc(F.col("profile")[n]) for n in range(len(scores))], F.asc(item)]
    best = top_k_per_group(ranked, [group], order, k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
