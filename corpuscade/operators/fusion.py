"""Rank fusion, normalisation, neighbour context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def min_max(value: Column, window, equal: float) -> Column:  # noqa: ANN001
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(equal))


def rrf(dense: DataFrame, sparse: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """``keys, dense_rank, sparse_rank, fused``: a full outer join of two ranked lists."""
    return dense.join(sparse, keys, "full_outer").withColumn("fused", reciprocal_rank(F.col("dense_rank"), k) + reciprocal_rank(F.col("sparse_rank"), k))


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str, limit: int | None = None) -> DataFrame:
    """Row numbers within a group.  With ``limit``, rows beyond it are cut before the groups meet."""
    if limit is not None:
        from .ranking import top_k_per_group

        df = top_k_per_group(df, group, order, limit)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def neighbour_context(chunks: DataFrame, reach: int = 1, document: str = "document_id", position: str = "position", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``context``: the trimmed texts that aren't blank at positions p - reach .. p + reach of
    the document, joined by line feeds in the order of positions.

    Each chunk is sent to the 2 * reach + 1 positions it belongs to, and the pieces meet in one
    aggregation: work in proportion to the chunks, with a bounded number of pieces a group,
    where a window over a document would put a hot document into one task.
    """
    columns = keep or chunks.columns
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    offered = chunks.where(body != "").select(document, F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.struct((F.col(position) + o).alias("at"), F.col(position).alias("p"), body.alias("t")))).alias("x"))
    merged = offered.groupBy(document, F.col("x.at").alias(position)).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("x.p", "x.t"))), lambda y: y["t"]), "\n").alias("context"))
    return chunks.select(*columns).join(merged, [document, position], "left").withColumn("context", F.coalesce("context", F.lit("")))


def blended_rerank(scored: DataFrame, group: str = "query_id", model: str = "model_score", heuristic: str = "heuristic_score", weight: float = 0.8) -> DataFrame:
    """Add ``rerank``: a model's scores and the heuristic's, blended.  A model's scores of a group
    that don't all lie between 0 and 1 go through a sigmoid first."""
    edges = scored.groupBy(group).agg(F.min(model).alias("__lo"), F.max(model).alias("__hi"))
    bounded = (F.col("__lo") >= 0) & (F.col("__hi") <= 1)
    value = F.when(bounded, F.col(model)).otherwise(1 / (1 + F.exp(-F.col(model))))
    return scored.join(edges, group).withColumn("rerank", weight * value + (1 - weight) * F.col(heuristic)).drop("__lo", "__hi")
