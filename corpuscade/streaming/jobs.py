"""Structured Streaming jobs: incremental ingestion, sessions, throughput."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tables
from ..session import written

SESSION = "user_id long, first_seen timestamp, last_seen timestamp, events long, expires_at timestamp"
_STATE = "first_us long, last_us long, events long"
_KEYS = ["university_id", "url"]


class Progress(StreamingQueryListener):
    """Counts rows and reports every ``every`` of them to ``tell(rows, rate)``."""

    def __init__(self, every: int, tell) -> None:  # noqa: ANN001
        self.every, self.tell, self.rows, self.told = every, tell, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.every:
            self.told = self.rows
            self.tell(self.rows, event.progress.processedRowsPerSecond)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def ingest(pages: DataFrame, target: str, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Fetched pages into a table of documents, micro-batch by micro-batch.

    The table is divided into buckets by key; a batch writes a version of the buckets it touches
    only, from their newest versions before it, so a batch that is replayed after a failure
    rewrites its own: nothing is lost or taken twice.  A bucket's versions that a batch before
    the last one replaced are removed.  Within a batch the last good fetch of a url counts; a
    fetch older than what is stored changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("status_code = 200").select(*_KEYS, F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash"), F.col("fetched_at").alias("last_crawled"), F.lit("active").alias("status"))
        fresh = written(tables.latest(fresh, _KEYS, [F.col("last_crawled"), F.col("content_hash")]).withColumn("bucket", F.pmod(F.xxhash64(*_KEYS), F.lit(buckets)).cast("int")), "fresh")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most one row a bucket
        known = {b: v for b, v in _versions(spark, target, number).items() if b in touched}
        if known:
            previous = _read(spark, target, known)
            newer = fresh.alias("n").join(previous.alias("s"), (F.col("n.university_id") == F.col("s.university_id")) & (F.col("n.url") == F.col("s.url")), "left").where("s.last_crawled IS NULL OR s.last_crawled <= n.last_crawled").select("n.*")
            fresh = tables.upsert_documents(previous, newer.select(*previous.columns), _KEYS)
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
        _sweep(spark, target, number)

    writer = pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith(name + "=")] if fs.exists(at) else []


def _complete(spark: SparkSession, target: str) -> list[int]:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = lambda n: jvm.Path(f"{target}/version={n}/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sorted(n for n in _folders(spark, target, "version") if done(n).getFileSystem(conf).exists(done(n)))


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """Of each bucket the newest version (below ``before``) that has it."""
    return {b: n for n in _complete(spark, target) if before is None or n < before for b in _folders(spark, f"{target}/version={n}", "bucket")}


def _read(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame:
    return spark.read.option("basePath", target).parquet(*[f"{target}/version={n}/bucket={b}" for b, n in versions.items()]).drop("version")


def _sweep(spark: SparkSession, target: str, number: int) -> None:
    """Remove bucket versions that aren't needed for a replay of batch ``number``."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    needed = _versions(spark, target, number)
    for n in _complete(spark, target):
        for b in _folders(spark, f"{target}/version={n}", "bucket"):
            if n < number and needed.get(b) != n:
                old = jvm.Path(f"{target}/version={n}/bucket={b}")
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def documents(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The documents as the newest versions (below ``before``) of all buckets have them, None if there is none."""
    known = _versions(spark, target, before)
    return _read(spark, target, known).drop("bucket") if known else None


def sessions(events: DataFrame, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Sessions that ended: a user's events with less than ``ttl_seconds`` between one and the next.

    State is one row a user.  A session is emitted when an event comes after its end, or when the
    watermark passes it.
    """
    ttl = ttl_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended: list[tuple] = []
        first, last, count = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            ended.append((first, last, count))
            state.remove()
        else:
            for us in sorted(int(t.value // 1000) for b in batches for t in b["ts"]):
                if count and us - last >= ttl:
                    ended.append((first, last, count))
                    count = 0
                first = us if not count else min(first, us)
                last = us if not count else max(last, us)
                count += 1
            state.update((first, last, count))
            state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000)
        if ended:
            at = lambda us: pd.Timestamp(us, unit="us")
            yield pd.DataFrame([(key[0], at(f), at(z), n, at(z + ttl)) for f, z, n in ended], columns=["user_id", "first_seen", "last_seen", "events", "expires_at"])

    return events.withWatermark("ts", delay).groupBy("user_id").applyInPandasWithState(step, SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def throughput(events: DataFrame, width: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Events and events a second by tumbling windows, late ones within ``delay`` counted."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("events"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return counted.select(F.col("w.start").alias("window_start"), "events", (F.col("events") / seconds).alias("per_second"))
