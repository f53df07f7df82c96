"""Running sums and ranks within groups, without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _laid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows range-partitioned by ``keys`` with the number of their partition, ``__pid``; written
    once, because what is carried between partitions needs the rows to stay put."""
    return written(df.repartitionByRange(*[F.col(k).asc() for k in keys]).withColumn("__pid", F.spark_partition_id()), "ranged")


def _carried(local: DataFrame, parts: DataFrame, group: Sequence[str], carry: Column, out: str) -> DataFrame:
    """``local`` with ``out``: of each row's (group, partition) the ``carry`` of ``parts``."""
    names = [f"__g_{n}" for n in range(len(group))]
    same = F.col("__pid") == F.col("__p")
    for g, name in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(name))
    small = parts.select(*[F.col(g).alias(name) for g, name in zip(group, names)], F.col("__pid").alias("__p"), carry.alias(out))
    return local.join(small, same, "left").drop("__p", *names)


def _running(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, out: str, combine) -> DataFrame:  # noqa: ANN001
    laid = _laid(df.withColumn("__amount", amount), [*group, *order])
    parts = laid.groupBy(*group, "__pid").agg(combine("__amount").alias("__part"))
    before = combine("__part").over(Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    inside = Window.partitionBy(*group, "__pid").orderBy(*[F.col(o).asc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumn(out, combine("__amount").over(inside)).drop("__amount")
    return _carried(local, parts, group, before, "__before")


def grouped_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before or at the row.

    ``order`` must be a total order within a group, ascending, nulls first.  Null values count
    as 0; nulls in ``group`` form a group of their own.  An empty input gives an empty result.
    The rows are range-partitioned by (group, order), so that a group which holds a third of
    the table spans many partitions; only one number per (group, partition) is summed by a window.
    """
    summed = _running(df, group, order, F.coalesce(F.col(value), F.lit(0)), out, F.sum)
    return summed.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__pid", "__before")


def grouped_running_max(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the largest ``value`` up to the row, by the plan of :func:`grouped_running_sum`."""
    found = _running(df, group, order, F.col(value), out, F.max)
    return found.withColumn(out, F.greatest(out, "__before")).drop("__pid", "__before")


def grouped_lag(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row before in the same group, null at its first row; by the
    plan of :func:`grouped_running_sum`, with each partition's last row carried over."""
    laid = _laid(df, [*group, *order])
    parts = laid.groupBy(*group, "__pid").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*group).orderBy("__pid"))
    inside = Window.partitionBy(*group, "__pid").orderBy(*[F.col(o).asc() for o in order])
    local = laid.withColumn(out, F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    return _carried(local, parts, group, before, "__before").withColumn(out, F.coalesce(out, "__before")["v"]).drop("__pid", "__before")


def grouped_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Row number from 1 within a group, by the plan of :func:`grouped_running_sum`."""
    one = "__one"
    return grouped_running_sum(df.withColumn(one, F.lit(1)), group, order, one, out).drop(one)


#: Largest k for which Spark cuts groups before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark cuts each group to its first k rows within every task before the rows are shuffled
    (a window group limit), so of a hot group at most k rows a task meet.  Beyond the k for which
    it does, a round by (group, input partition) comes first.
    """
    rn = "__rn"

    def first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) <= k).drop(rn)

    if k > GROUP_LIMIT:
        df = first(df.withColumn("__salt", F.spark_partition_id()), [*group, "__salt"]).drop("__salt")
    return first(df, group)
