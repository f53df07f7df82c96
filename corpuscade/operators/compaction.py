"""Few well-sized files out of very many small ones, by joining bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_path, located, shared_dir, written
from .ranking import grouped_running_sum

MANIFEST = "bin long, out_path string, fragments long, files long, bytes_in long, bytes_added long, bytes_out long, crc_in long, crc_out long"
EXTENSIONS = {"ndjson": "json", "csv": "csv", "zstd": "zst"}
BLOCK = 8 << 20
#: Largest number of tasks that write bins.
WRITERS = 20_000

# The four bytes a zstandard frame and a skippable frame start with, and the sizes in its header.
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = range(0x184D2A50, 0x184D2A60)
DICTIONARY_BYTES = (0, 1, 2, 4)
CONTENT_SIZE_BYTES = (0, 2, 4, 8)
BOM = b"\xef\xbb\xbf"


class FrameWalker:
    """Follows zstandard frames from header to end without decoding, fed with any pieces of bytes.

    Complete frames may follow one another, skippable ones among them.  ``finish`` raises if
    the bytes end within a frame.
    """

    def __init__(self) -> None:
        self.held, self.skip, self.steps = b"", 0, self._walk()
        self.want = next(self.steps)
        self.between = True

    def _walk(self) -> Iterator[int]:
        """Yields how many bytes are wanted next, negative if they are passed over; is sent the bytes."""
        while True:
            self.between = True
            magic = int.from_bytes((yield 4), "little")
            self.between = False
            if magic in SKIPPABLE_MAGIC:
                yield -int.from_bytes((yield 4), "little")
                continue
            if magic != ZSTD_MAGIC:
                raise ValueError("a zstandard frame doesn't start where one must")
            descriptor = (yield 1)[0]
            single, size_flag = descriptor >> 5 & 1, descriptor >> 6
            rest = (not single) + DICTIONARY_BYTES[descriptor & 3] + (CONTENT_SIZE_BYTES[size_flag] or single)
            yield -rest
            last = 0
            while not last:
                block = int.from_bytes((yield 3), "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                if kind == 3:
                    raise ValueError("a zstandard frame has a block of unknown kind")
                yield -(1 if kind == 1 else size)
            if descriptor >> 2 & 1:
                yield -4

    def feed(self, data: bytes) -> None:
        at = 0
        while True:
            if self.want <= 0:
                step = min(-self.want, len(data) - at)
                at, self.want = at + step, self.want + step
                if self.want:
                    return
                self.want = self.steps.send(b"")
            else:
                step = min(self.want - len(self.held), len(data) - at)
                self.held, at = self.held + data[at : at + step], at + step
                if len(self.held) < self.want:
                    return
                held, self.held = self.held, b""
                self.want = self.steps.send(held)

    def finish(self) -> None:
        if not self.between or self.held:
            raise ValueError("a zstandard frame is cut off")


class Joiner:
    """How fragments of one format are joined at their borders; made anew for each output file.

    ``ndjson`` and ``csv``: a missing line end is added between fragments, a byte order mark is
    dropped.  ``csv`` drops a fragment's first record where it repeats the file's header; records
    end at a line feed outside quotation marks, and a fragment that ends within them is refused.
    ``zstd``: complete frames, skippable ones included, follow one another unchanged, as the
    format allows; anything else is refused.  Nothing is parsed and no record is decoded.
    """

    def __init__(self, kind: str) -> None:
        if kind not in EXTENSIONS:
            raise ValueError(f"unknown kind: {kind}")
        self.kind, self.header = kind, None

    def part(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        """What one fragment, given in pieces, adds to the file."""
        if self.kind == "zstd":
            walker = FrameWalker()
            for piece in pieces:
                walker.feed(piece)
                yield piece
            walker.finish()
            return
        last, quotes, head = b"", 0, b""
        waiting = self.kind == "csv"
        for piece in self._without_mark(pieces):
            if self.kind == "csv":
                quotes += piece.count(b'"')
            last = piece[-1:]
            if waiting:
                head += piece
                cut = self._record_end(head)
                if cut < 0:
                    continue
                waiting, piece = False, self._headed(head[:cut]) + head[cut:]
            if piece:
                yield piece
        if quotes % 2:
            raise ValueError("a fragment ends within quotation marks")
        if waiting and head:
            head = self._headed(head + b"\n")
            if head:
                yield head
        elif last and last != b"\n":
            yield b"\n"

    def _headed(self, record: bytes) -> bytes:
        bare = record.rstrip(b"\r\n")
        if self.header is None:
            self.header = bare
        elif bare == self.header:
            return b""
        return record

    @staticmethod
    def _record_end(data: bytes) -> int:
        """Behind the first line feed outside quotation marks, -1 if there is none."""
        at, quotes, seen = data.find(b"\n"), 0, 0
        while at >= 0:
            quotes, seen = quotes + data.count(b'"', seen, at), at
            if quotes % 2 == 0:
                return at + 1
            at = data.find(b"\n", at + 1)
        return -1

    @staticmethod
    def _without_mark(pieces: Iterable[bytes]) -> Iterator[bytes]:
        start, begun = b"", False
        for piece in pieces:
            if not begun:
                start += piece
                if len(start) < len(BOM) and BOM.startswith(start):
                    continue
                begun, piece = True, start.removeprefix(BOM)
            if piece:
                yield piece
        if not begun and start:
            yield start


class _Output:
    """One output file while it is written: under a name of its own, renamed when it is whole."""

    def __init__(self, out_dir: str, name: str, number: int, kind: str) -> None:
        import uuid

        self.system, root = located(out_dir)
        self.system.create_dir(root, recursive=True)
        self.final, self.tmp = f"{root}/{name}.{EXTENSIONS[kind]}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.stream, self.joiner = self.system.open_output_stream(self.tmp), Joiner(kind)
        self.row = {"bin": number, "out_path": f"{out_dir.rstrip('/')}/{name}.{EXTENSIONS[kind]}", "fragments": 0, "files": 0, "bytes_in": 0, "bytes_out": 0, "crc_in": 0, "crc_out": 0}
        self.last: str | None = None

    def add(self, path: str, pieces: Iterable[bytes]) -> int:
        """Append a fragment; returns its length."""
        row, size = self.row, 0

        def counted() -> Iterator[bytes]:
            nonlocal size
            for piece in pieces:
                size += len(piece)
                row["crc_in"] = zlib.crc32(piece, row["crc_in"])
                yield piece

        for piece in self.joiner.part(counted()):
            self.stream.write(piece)
            row["bytes_out"] += len(piece)
            row["crc_out"] = zlib.crc32(piece, row["crc_out"])
        row["bytes_in"] += size
        row["fragments"] += 1
        row["files"] += path != self.last
        self.last = path
        return size

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        self.system.move(self.tmp, self.final)
        row = self.row | {"bytes_added": self.row["bytes_out"] - self.row["bytes_in"]}
        return pa.RecordBatch.from_pydict({k: [row[k]] for k in ("bin", "out_path", "fragments", "files", "bytes_in", "bytes_added", "bytes_out", "crc_in", "crc_out")})


def _pieces(uri: str) -> Iterator[bytes]:
    system, at = located(uri)
    with system.open_input_stream(at) as stream:
        while piece := stream.read(BLOCK):
            yield piece


def shared_only(spark: SparkSession, uri: str) -> str:
    """Refuse a folder of one machine, unless the job runs on one or the shared folder holds it."""
    local = uri.startswith("file:") or "://" not in uri
    if local and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        if not (local_path(uri) + "/").startswith(local_path(shared_dir(spark)) + "/"):
            raise ValueError(f"{uri} isn't a folder that all executors share")
    return uri


def compact(files: DataFrame, out_dir: str, target_bytes: int = 128 << 20, kind: str = "ndjson") -> DataFrame:
    """Join fragments that come as rows into files of about ``target_bytes`` below ``out_dir``; returns the manifest.

    ``files`` has ``path string, content binary`` and optionally ``part``, the order of fragments
    within a path; further columns are ignored.  Rows with null path or content count as absent;
    an empty content adds no byte.  Equal rows are different fragments: nothing is deduplicated
    or lost here.  For files in a folder see :func:`compact_files`.

    Every task joins the rows of its own partition in (path, part) order, so no content is
    shuffled: a scan's partitions, which Spark packs from many small files, are the unit.  Each
    task's last file may be smaller than the target.  Every output file is written to a name of
    its own and renamed at the end; a repeated task writes the same files.  The manifest, a row
    per file with lengths and checksums, is written once, and with it the files.
    """
    out_dir = shared_only(files.sparkSession, out_dir)
    part = F.col("part") if "part" in files.columns else F.lit(0)
    clean = files.select("path", part.cast("long").alias("part"), "content").where(F.col("path").isNotNull() & F.col("content").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, now = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now is None:
                    now = _Output(out_dir, f"part-{task:06d}-{number:05d}", (task << 20) + number, kind)
                now.add(path, (content,) if content else ())
                if now.row["bytes_out"] >= target_bytes:
                    yield now.close()
                    now, number = None, number + 1
        if now:
            yield now.close()

    return written(clean.sortWithinPartitions("path", "part").mapInArrow(write, MANIFEST), "manifest")


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """``path, size`` of all files below a folder whose name ends in ``suffix``, but for hidden ones.

    The driver lists the folder itself; every folder in it is listed by a task.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    hidden = lambda name: name.startswith((".", "_"))
    here = [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in found if not hidden(s.getPath().getName())]
    own = spark.createDataFrame([(p, n) for p, n, is_dir in here if not is_dir and p.endswith(suffix)], "path string, size long")
    folders = [(p,) for p, _, is_dir in here if is_dir]
    if not folders:
        return own

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, at = located(uri)
                for start in range(0, len(infos := system.get_file_info(fs.FileSelector(at, recursive=True))), 10_000):
                    rows = [(f"{uri}{i.path[len(at):]}", i.size) for i in infos[start : start + 10_000] if i.is_file and i.path.endswith(suffix) and not any(hidden(x) for x in i.path[len(at) :].split("/"))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])

    listed = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), WRITERS)).mapInArrow(below, "path string, size long")
    return own.unionByName(listed)


def plan_bins(files: DataFrame, target_bytes: int) -> DataFrame:
    """``path, size, bin``: which output file each file goes to, in path order.

    The bins are cut from one running sum of the sizes, so each holds ``target_bytes`` but for
    its last file, however many files there are and whichever folder they lie in.  An empty
    file counts as one byte.
    """
    sized = files.select("path", "size", F.greatest(F.col("size"), F.lit(1)).alias("__size"), F.lit(0).alias("__all"))
    summed = grouped_running_sum(sized, ["__all"], ["path"], "__size", "__end")
    return written(summed.select("path", "size", F.floor((F.col("__end") - F.col("__size")) / F.lit(target_bytes)).cast("long").alias("bin")), "bins")


def compact_files(files: DataFrame, out_dir: str, target_bytes: int = 128 << 20, kind: str = "ndjson") -> DataFrame:
    """Join the files of a listing (``path, size``, as :func:`list_files` gives it) into files below ``out_dir``; returns the manifest.

    Bins are planned from names and sizes, and only those are shuffled; each bin goes to a task
    of its own, which opens its files one after another and streams their bytes.  A file whose
    length isn't the listed one is refused.  Each path must be listed once.  ``checked`` in the
    manifest tells whether the written file and, in a second reading, its sources have the
    lengths and checksums that were noted while writing.
    """
    out_dir = shared_only(files.sparkSession, out_dir)
    binned = plan_bins(files, target_bytes)
    count = (binned.agg(F.max("bin")).first()[0] or 0) + 1
    tasks = min(count, WRITERS)
    laid = binned.repartitionById(tasks, (F.col("bin") % tasks).cast("int")).sortWithinPartitions("bin", "path")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for path, size, number in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.row["bin"] != number:
                    if now:
                        yield now.close()
                    now = _Output(out_dir, f"part-{number:08d}", number, kind)
                if now.add(path, _pieces(path)) != size:
                    raise ValueError(f"{path} isn't {size} bytes long")
        if now:
            yield now.close()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for path, _, number in zip(*(c.to_pylist() for c in batch.columns)):
                for piece in _pieces(path):
                    sums[number] = zlib.crc32(piece, sums.get(number, 0))
                sums.setdefault(number, 0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["bin", "crc"])

    manifest = written(laid.mapInArrow(write, MANIFEST), "manifest")
    sources = laid.mapInArrow(again, "bin long, crc long")
    return validate(manifest).join(sources, "bin").withColumn("checked", F.col("ok") & (F.col("crc") == F.col("crc_in"))).drop("ok", "crc")


def validate(manifest: DataFrame) -> DataFrame:
    """The manifest with ``ok``: length and checksum of each file as read again from disk."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for path, size, crc, came, added in zip(*[batch.column(c).to_pylist() for c in ("out_path", "bytes_out", "crc_out", "bytes_in", "bytes_added")]):
                seen, found = 0, 0
                for piece in _pieces(path):
                    seen, found = seen + len(piece), zlib.crc32(piece, found)
                good.append(seen == size == came + added and found == crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], [*batch.schema.names, "ok"])

    return manifest.mapInArrow(check, MANIFEST + ", ok boolean")
