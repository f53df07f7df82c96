"""Log-based change capture: an append-only log with offsets, a write-ahead plan, and a sink that knows its offsets."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path


class JsonLog:
    """Numbered JSON files in the shared folder, each published once and whole.

    A file is written under a name of its own and then given its final name in one step that
    fails if that name is taken (a hard link on a local file system, a rename that doesn't
    overwrite elsewhere).  So of two runners that publish one number exactly one succeeds, and
    the other sees it.  Stores without an atomic rename need a Hadoop committer for such names.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root, self._at = root, self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._at.getFileSystem(self._conf)
        self._fs.mkdirs(self._at)

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def publish(self, kind: str, number: int, content: dict) -> bool:
        """Publish a file; False if there is one of that kind and number already."""
        final, tmp = self._path(f"{kind}-{number:09d}.json"), self._path(f".{kind}-{number:09d}-{uuid.uuid4().hex}")
        stream = self._fs.create(tmp, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
            else:
                kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self._jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
                options[0] = kinds.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(tmp, final, options)
        except Exception:
            if not self._fs.exists(final):
                raise
            return False
        finally:
            self._fs.delete(tmp, False)
        return True

    def read(self, kind: str, number: int) -> dict | None:
        path = self._path(f"{kind}-{number:09d}.json")
        if not self._fs.exists(path):
            return None
        stream = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(self._fs.open(path), "UTF-8"))
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def last(self, kind: str) -> int:
        """Number of the newest file of that kind, -1 if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return max([-1, *(int(n[len(kind) + 1 : -5]) for n in names if n.startswith(kind + "-") and n.endswith(".json"))])

    def remove(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)


class ChangeLog:
    """An append-only log of records in numbered segments.

    The log itself assigns the offsets, as records are appended: (segment, row).  Nothing in a
    record decides its place, so null, late and equal arrival instants lie behind everything
    appended before like any other record.  Records are divided into ``partitions`` by the hash
    of ``key``; a segment's manifest says how far each partition reaches.

    A segment's rows are written first, in one pass without a shuffle, and numbered by
    publishing the manifest; a writer that finds its number taken takes the next one, and rows
    without a manifest (a writer that was lost) are never read.  A writer that doesn't know
    whether it succeeded appends again; the sink recognises the copies.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, partitions: int = 64, key: str = "url") -> None:
        self.spark, self.root, self.partitions, self.key = spark, root or work_path(spark, "log"), partitions, key
        self.manifests = JsonLog(spark, f"{self.root}/manifests")

    def append(self, records: DataFrame) -> int:
        """Add the records, all columns; returns the number of their segment."""
        part = F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.partitions)).cast("int")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = records.withColumns({"__part": part, "__row": F.monotonically_increasing_id()})
        rows.write.option("compression", "lz4").parquet(folder)
        ends = self.spark.read.schema(rows.schema).parquet(folder).groupBy("__part").agg(F.max("__row").alias("row")).collect()  # one row per log partition
        manifest = {"folder": folder, "schema": rows.schema.json(), "ends": {str(r["__part"]): r["row"] for r in ends}}
        number = self.manifests.last("segment") + 1
        while not self.manifests.publish("segment", number, manifest):
            number += 1
        return number

    def end(self, upto: int | None = None, start: dict | None = None) -> dict[str, list[int]]:
        """The offset (segment, row) of each partition's last record, up to a segment."""
        last = self.manifests.last("segment") if upto is None else upto
        ends = dict(start or {})
        for number in range(1 + max([-1, *(e[0] for e in ends.values())]), last + 1):
            for part, row in self.manifests.read("segment", number)["ends"].items():
                ends[part] = [number, row]
        return ends

    def between(self, first: int, last: int, start: dict, end: dict) -> DataFrame:
        """The records of segments ``first`` to ``last`` behind ``start`` and up to ``end``, with
        ``__part, __seg, __row``.  Earlier segments aren't opened; the smallest row that may
        count in any partition is a filter of the scan."""
        out = None
        for number in range(first, last + 1):
            manifest = self.manifests.read("segment", number)
            parts = sorted(set(end) | set(start), key=int)
            behind = {p: start.get(p, [-1, -1]) for p in parts}
            low = {p: row if seg == number else -1 if seg < number else 2**62 for p, (seg, row) in behind.items()}
            high = {p: end[p][1] if p in end and end[p][0] == number else 2**62 if p in end and end[p][0] > number else -1 for p in parts}
            schema = self.spark.createDataFrame([], "a int").schema.fromJson(json.loads(manifest["schema"]))
            rows = self.spark.read.schema(schema).parquet(manifest["folder"]).where(F.col("__row") > min(low.values(), default=-1))
            if any(low[p] != -1 or high[p] < manifest["ends"].get(p, -1) for p in parts):  # a segment read in part
                reach = lambda bounds: F.element_at(F.create_map(*[F.lit(x) for p in parts for x in (int(p), bounds[p])]), F.col("__part"))  # noqa: B023, E731
                rows = rows.where((F.col("__row") > reach(low)) & (F.col("__row") <= reach(high)))
            rows = rows.withColumn("__seg", F.lit(number))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


class ChangeCapture:
    """Hands each record of a :class:`ChangeLog` to a processor once.

    A run: read the committed offsets; take the log's present ends as the end of the batch, at
    most ``segments`` segments away; publish that plan; process what lies between; write the
    result to a folder of the attempt's own; commit by publishing that folder's name.  A plan
    without commit (a run that was lost) is run again instead of a new one, so a batch always
    has the same records.  Two runners at once follow the same plan, of which one is published;
    the one that commits second drops its folder.

    The sink's state keeps, of each key, the row with the largest (batch, offset).  A processor
    that must know what earlier batches found reads it from ``latest``, as
    :func:`resolved_fetches` does; rows with ``emit`` false keep the state and aren't handed
    out.  Every ``merge_every`` batches the state is written as one table, so a run reads that
    and the few batches since, not all batches ever written.
    """

    def __init__(self, spark: SparkSession, log: ChangeLog, root: str | None = None, segments: int = 256, merge_every: int = 8) -> None:
        self.spark, self.source, self.root = spark, log, root or work_path(spark, "capture")
        self.segments, self.merge_every = segments, merge_every
        self.log = JsonLog(spark, f"{self.root}/log")

    def plan(self) -> tuple[int, dict | None]:
        """The batch to run: one that was planned and not committed, else a new one; None if the log has nothing more."""
        done = self.log.last("commit")
        if self.log.last("plan") <= done:
            before = self.log.read("plan", done) if done >= 0 else {"last": -1, "end": {}}
            last = min(self.source.manifests.last("segment"), before["last"] + self.segments)
            if last == before["last"]:
                return done, None
            self.log.publish("plan", done + 1, {"first": before["last"] + 1, "last": last, "start": before["end"], "end": self.source.end(last, before["end"])})
        return done + 1, self.log.read("plan", done + 1)

    def records(self, batch: dict) -> DataFrame:
        return self.source.between(batch["first"], batch["last"], batch["start"], batch["end"])

    def run(self, process: Callable[[DataFrame], DataFrame], before_commit: Callable[[int], None] | None = None) -> int:
        """One batch; returns its number, or that of the last one if the log has nothing more (-1: none ever).

        ``process`` must keep ``__seg, __row`` and the key.
        """
        number, batch = self.plan()
        if batch is None:
            return number
        before = self._state_of(number - 1)
        attempt = f"{self.root}/sink/{number:09d}-{uuid.uuid4().hex}"
        process(self.records(batch)).withColumn("__batch", F.lit(number)).write.option("compression", "lz4").parquet(attempt)
        content = {"attempt": attempt, "since": [*before["since"], attempt], "state": before["state"]}
        if len(content["since"]) > self.merge_every:
            merged = f"{self.root}/state/{number:09d}-{uuid.uuid4().hex}"
            self._newest(content).write.option("compression", "lz4").parquet(merged)
            content |= {"since": [], "state": merged}
        if before_commit:
            before_commit(number)
        if not self.log.publish("commit", number, content):
            self.log.remove(attempt)
        return number

    def _state_of(self, number: int) -> dict:
        return self.log.read("commit", number) if number >= 0 else {"state": None, "since": []}

    def _newest(self, content: dict) -> DataFrame:
        """Of each key the newest row, by an aggregation that combines on the map side."""
        rows = self.spark.read.parquet(*[p for p in (content["state"], *content["since"]) if p])
        newest = F.max_by(F.struct(*rows.columns), F.struct("__batch", "__seg", "__row"))
        return rows.groupBy(F.col(self.source.key).alias("__key")).agg(newest.alias("r")).select("r.*")

    def changes(self, number: int) -> DataFrame:
        """The rows that batch ``number`` hands out."""
        rows = self.spark.read.parquet(self.log.read("commit", number)["attempt"])
        return rows.where("emit").drop("emit") if "emit" in rows.columns else rows

    def latest(self) -> DataFrame | None:
        """Of each key the newest committed row, whatever it says; None before the first commit."""
        done = self.log.last("commit")
        return None if done < 0 else self._newest(self._state_of(done))

    def state(self) -> DataFrame:
        """What the committed batches add up to: of each key the newest row, without keys that stand unchanged."""
        rows = self.latest()
        if rows is None:
            raise ValueError("no batch is committed")
        return rows.where(~F.col("change").isin("unchanged", "withdrawn")).drop("emit") if "emit" in rows.columns else rows


def fetch_records(pages: DataFrame) -> DataFrame:
    """What the log keeps of a fetch: everything but the html, of which it has the SHA-256.

    A null html counts as empty.  The html is read once, where the fetch is appended.
    """
    return pages.select("url", "page_id", "status_code", "fetched_at", "ingested_at", F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"))


def fetch_order() -> Column:
    """Which of a url's fetches is the last: the instant of the fetch, then arrival, then page_id; nulls first."""
    return F.struct("fetched_at", "ingested_at", "page_id")


def latest_fetches(records: DataFrame) -> DataFrame:
    """Of each url the last of the log's fetches with status 200.

    ``max_by`` combines on the map side, so a url fetched very often costs one row a task.  A
    null url is a url.
    """
    best = F.max_by(F.struct("page_id", "hash", "fetched_at", "ingested_at", "__seg", "__row"), fetch_order())
    return records.where(F.col("status_code") == 200).groupBy("url").agg(best.alias("b")).select("url", "b.*")


def newest_documents(documents: DataFrame) -> DataFrame:
    """Of each url the newest stored row by ``last_crawled``; ties go to the larger status, hash and id."""
    order = F.struct("last_crawled", "status", "content_hash", "document_id")
    best = F.max_by(F.struct("status", F.lower("content_hash").alias("stored")), order)
    return documents.groupBy("url").agg(best.alias("b")).select("url", "b.*", F.lit(True).alias("known"))


def _against_store(last: DataFrame, documents: DataFrame) -> DataFrame:
    """The latest fetches with ``change``: null where the url is active and stored with the same hash."""
    stored = newest_documents(documents)
    joined = last.alias("f").join(stored.alias("s"), F.col("f.url").eqNullSafe(F.col("s.url")), "left")
    kind = F.when(F.col("s.known").isNull(), "new").when(F.col("s.status").isNull() | (F.col("s.status") != "active"), "inactive").when(F.col("s.stored").isNull() | (F.col("s.stored") != F.col("f.hash")), "changed")
    return joined.withColumn("change", kind).select(*[F.col(f"f.{c}") for c in last.columns], "change")


def changed_fetches(fetches: DataFrame, documents: DataFrame) -> DataFrame:
    """The latest fetches whose url is new, not active, or stored with another hash."""
    return _against_store(latest_fetches(fetches), documents).where("change IS NOT NULL")


def resolved_fetches(fetches: DataFrame, documents: DataFrame, before: DataFrame | None) -> DataFrame:
    """The latest fetches of a batch against the store and what earlier batches left (``before``).

    A row for each url whose last fetch is now in this batch; a fetch older than the one the url
    stands at is ignored.  ``change`` is as in :func:`changed_fetches`, ``unchanged``, or
    ``withdrawn`` where an earlier batch handed out a change and the url is back at the stored
    content.  ``emit``: whether there is something to hand out; content that an earlier batch
    handed out for the url isn't handed out again, though the url then stands at the newer fetch.
    """
    last = latest_fetches(fetches)
    if before is None:
        met = _against_store(last, documents).withColumns({"listed": F.lit(False), "repeated": F.lit(False)})
    else:
        told = before.select(F.col("url").alias("b_url"), fetch_order().alias("stands"), F.col("hash").alias("b_hash"), (~F.col("change").isin("unchanged", "withdrawn")).alias("b_listed"))
        newer = F.col("stands").isNull() | (fetch_order() > F.col("stands"))
        fresh = last.join(told, F.col("url").eqNullSafe(F.col("b_url")), "left").where(newer)
        flags = {"listed": F.coalesce("b_listed", F.lit(False)), "repeated": F.coalesce(F.col("b_listed") & (F.col("b_hash") == F.col("hash")), F.lit(False))}
        met = _against_store(fresh.withColumns(flags).select(*last.columns, *flags), documents)
    change = F.coalesce("change", F.when(F.col("listed"), "withdrawn").otherwise("unchanged"))
    return met.withColumns({"emit": F.when(F.col("change").isNull(), F.col("listed")).otherwise(~F.col("repeated")), "change": change}).drop("listed", "repeated")
