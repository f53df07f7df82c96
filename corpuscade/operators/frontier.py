"""A crawl's frontier, level by level, that can stop and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "url string, depth int"


def snapshot(queue: DataFrame, in_flight: DataFrame) -> DataFrame:
    """``url, depth`` of what a crawl goes on with: what waits and what was being fetched, each address at its smallest depth."""
    return queue.select("url", "depth").unionByName(in_flight.select("url", "depth")).groupBy("url").agg(F.min("depth").alias("depth"))


class Frontier:
    """Breadth-first expansion over a link table with its state in a folder.

    Each level is one written table of the addresses admitted there; the visited set is the
    union of the levels, so nothing else has to be saved.  A level is complete once its
    ``_SUCCESS`` is there; a run that was stopped goes on behind the last complete level.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def levels(self) -> int:
        n = 0
        while self._fs.exists(self._path(f"{self.root}/level={n}/_SUCCESS")):
            n += 1
        return n

    def visited(self) -> DataFrame:
        done = self.levels()
        if not done:
            return self.spark.createDataFrame([], NODE)
        return self.spark.read.schema(NODE).parquet(*[f"{self.root}/level={n}" for n in range(done)])

    def _write(self, df: DataFrame, level: int) -> int:
        path = f"{self.root}/level={level}"
        df.select("url", "depth").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(NODE).parquet(path).count()

    def run(self, roots: DataFrame, links: DataFrame, admit: Callable[[DataFrame], DataFrame] | None = None, max_depth: int = 5, max_pages: int | None = None) -> DataFrame:
        """``url, depth`` of all that was reached.  ``links``: source, target; ``admit`` filters the
        candidates of a level (scope, robots, suffixes).  ``max_pages`` is the crawl's page cap,
        taken in the order of the addresses."""
        if not self.levels():
            self._write(roots.select("url", F.lit(0).alias("depth")).distinct(), 0)
        while (level := self.levels()) <= max_depth:
            seen = self.visited()
            if max_pages is not None and (left := max_pages - seen.count()) <= 0:
                break
            last = seen.where(F.col("depth") == level - 1)
            grown = last.join(links, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
            grown = (admit(grown) if admit else grown).select("url", F.lit(level).alias("depth"))
            if max_pages is not None:
                grown = grown.orderBy("url").limit(left)
            if not self._write(grown, level):
                break
        return self.visited()
