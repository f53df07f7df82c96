"""Filling containers of fixed capacity: dominance reduction on the histogram of sizes, then best fit."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import grouped_rank
from ..session import written

#: Where the public vocabulary files lie, unless a path is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(vocabulary: bytes) -> Callable[[str], int]:
    """Number of tokens of a text, by a vocabulary of ranks."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc, size``: tokens of each whole text.  Null and empty texts have no token and no row.

    The vocabulary is read by the driver and sent along, so executors need no copy of the file;
    it has a fixed size (below 1 MB for 50,000 tokens).
    """
    with open(tokenizer, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(shared.value)
        for batch in batches:
            sizes = pa.array([count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["doc", "size"])

    return docs.select(F.col(id_col).alias("doc"), text_col).mapInArrow(rows, f"doc {docs.schema[id_col].dataType.simpleString()}, size long").where("size > 0")


@dataclass
class Plan:
    """Which containers the items of each size go to: runs of (size, first rank, items, first
    container, items a container).  Item number r of a size (from 0) in a run goes to container
    first + (r - first rank) // items a container."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    fixed: int = 0

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 5)


class _Sizes:
    """Counts by size with the sizes in order; ranks are handed out from 0."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {s: c for s, c in histogram.items() if c > 0}
        self.order = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)

    def take(self, size: int, count: int) -> int:
        first = self.rank[size]
        self.rank[size] += count
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]
            self.order.pop(bisect.bisect_left(self.order, size))
        return first

    def at_most(self, bound: int) -> int | None:
        k = bisect.bisect_right(self.order, bound)
        return self.order[k - 1] if k else None

    def smallest(self, count: int, without: int) -> int | None:
        """Sum of the ``count`` smallest items but for one of size ``without``; None if there are fewer."""
        total = 0
        for s in self.order:
            have = self.left[s] - (s == without)
            use = min(have, count)
            total, count = total + use * s, count - use
            if not count:
                return total
        return None


def plan_containers(histogram: dict[int, int], capacity: int, reduce: bool = True) -> Plan:
    """A packing of the items, given as counts by size (each size within the capacity).

    Dominance reduction after Martello and Toth: see :func:`_dominating`.  Items are taken from
    the largest down; one whose set can't be fixed stays among the candidates of all others.
    Passes over the sizes are repeated while they fix something.  The rest is packed best fit
    decreasing, likewise by runs of equal items.

    Taking items away only raises the smallest sums and lowers the best pairs, so a set that
    dominates once does so for as many equal items as there are: all are fixed in one step,
    which uses up a size (or all but one item of it).  Steps, and so the rows of the plan,
    depend on the number of sizes, at most ``capacity``, and not on the number of items.
    """
    plan, sizes = Plan(capacity), _Sizes(histogram)
    again = reduce
    while again:
        again = False
        for j in sorted(sizes.left, reverse=True):
            while j in sizes.left:
                beside = _dominating(sizes, j, capacity)
                if beside is None:
                    break
                again = True
                uses: dict[int, int] = {}
                for m in (j, *beside):
                    uses[m] = uses.get(m, 0) + 1
                count = min(sizes.left[m] // n for m, n in uses.items())
                for m, n in uses.items():
                    plan.runs.append((m, sizes.take(m, n * count), n * count, plan.containers, n))
                plan.containers += count
                plan.fixed += count
    rest = [(s, sizes.rank[s], c) for s, c in sizes.left.items()]
    _best_fit(plan, rest)
    return plan


def _dominating(sizes: _Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """The items to put beside an item of size ``j`` so that the set dominates every set with j.

    Whatever else stood beside j can then take the places of these items elsewhere, so some
    optimal packing has the set.  With s the largest item that fits beside j:
    nothing, if nothing fits; s, if it fills the container, if no two items fit beside j, or if
    no three do and no two are larger than s together; s and the largest item t that fits beside
    both, if no three fit and no two items above t do.  Otherwise None.
    """
    room = capacity - j
    have = lambda size: sizes.left[size] - (size == j)
    s = sizes.at_most(room)
    if s == j and not have(j):
        k = bisect.bisect_left(sizes.order, j)
        s = sizes.order[k - 1] if k else None
    if s is None:
        return ()
    if s == room:
        return (s,)
    two = sizes.smallest(2, j)
    if two is None or two > room:
        return (s,)
    three = sizes.smallest(3, j)
    if three is not None and three <= room:
        return None
    if _best_pair(sizes, room, j) <= s:
        return (s,)
    # the largest item beside j and s
    k = bisect.bisect_right(sizes.order, room - s) - 1
    while k >= 0 and have(sizes.order[k]) <= (sizes.order[k] == s):
        k -= 1
    if k < 0:
        return None
    t, above, left = sizes.order[k], [], 2
    # the two smallest items above t, one item of size s left out; a pair with that one doesn't fit
    for size in sizes.order[k + 1 :]:
        if size > room or left <= 0:
            break
        n = min(have(size) - (size == s), left)
        above += [size] * max(n, 0)
        left -= max(n, 0)
    return (s, t) if len(above) < 2 or sum(above) > room else None


def _best_pair(sizes: _Sizes, room: int, without: int) -> int:
    """The largest sum within ``room`` of two items other than one of size ``without``."""
    best, low, order = 0, 0, sizes.order
    high = bisect.bisect_right(order, room) - 1
    have = lambda s: sizes.left[s] - (s == without)
    while low <= high:
        if order[low] + order[high] > room or have(order[high]) <= 0:
            high -= 1
        else:
            if have(order[low]) > (low == high):
                best = max(best, order[low] + order[high])
            low += 1
    return best


def _best_fit(plan: Plan, items: list[tuple[int, int, int]]) -> None:
    """Best fit decreasing of (size, first rank, count), with classes of containers of one rest."""
    rests: list[int] = []
    classes: dict[int, list[tuple[int, int]]] = {}

    def add(rest: int, first: int, count: int) -> None:
        if count and rest:
            if rest not in classes:
                bisect.insort(rests, rest)
                classes[rest] = []
            classes[rest].append((first, count))

    for size, rank, count in sorted(items, reverse=True):
        while count:
            k = bisect.bisect_left(rests, size)
            if k < len(rests):
                rest = rests[k]
                first, there = classes[rest].pop()
                if not classes[rest]:
                    del classes[rest]
                    rests.pop(k)
            else:
                rest, first = plan.capacity, plan.containers
                there = -(-count // (plan.capacity // size))
                plan.containers += there
            each = rest // size
            full = min(there, count // each)
            if full:
                plan.runs.append((size, rank, full * each, first, each))
                add(rest - each * size, first, full)
                rank, count, first, there = rank + full * each, count - full * each, first + full, there - full
            if there and count and count < each:
                plan.runs.append((size, rank, count, first, count))
                add(rest - count * size, first, 1)
                rank, count, first, there = rank + count, 0, first + 1, there - 1
            add(rest, first, there)


def pack(items: DataFrame, windows: list[tuple[int, int]], id_col: str = "doc", size_col: str = "size") -> DataFrame:
    """``window_id, container, doc, piece, token_from, token_count``: every item in containers of each capacity.

    ``windows``: (window_id, capacity), each capacity a positive number.  An item larger than
    the capacity is divided into full pieces, which fill a container each, and a rest, which is
    packed like an item.  Items of size null or 0 have no row.  Repeated ids must have equal
    sizes and count once.  Containers are numbered from 0 within a window.

    Only the histogram of sizes, at most ``capacity`` rows, reaches the driver; the plan made
    from it, some runs a size, goes back to the tasks.  Items get their number within a size by
    a ranking over range partitions, so no size, however frequent, gathers in one task.
    """
    spark = items.sparkSession
    unique = written(items.where(F.col(size_col) > 0).groupBy(F.col(id_col).alias("doc")).agg(F.max(size_col).alias("size")), "sizes")
    kind = unique.schema["doc"].dataType.simpleString()
    caps = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in windows])
    per = unique.select("doc", "size", F.explode(caps).alias("w")).select("w.*", "doc", "size")
    rests = per.withColumn("rest", F.col("size") % F.col("capacity")).withColumn("fulls", F.floor(F.col("size") / F.col("capacity")))
    # numbers within (window, rest); rest 0 stands for items of full pieces only
    ranked = written(grouped_rank(rests, ["window_id", "capacity", "rest"], ["doc"], "rank"), "ranked")
    shared = {}
    for window, capacity in windows:
        counts = ranked.where((F.col("window_id") == window) & (F.col("rest") > 0)).groupBy("rest").agg(F.count("*").alias("c"))
        plan = plan_containers({r["rest"]: r["c"] for r in counts.toLocalIterator()}, capacity)  # at most capacity rows
        shared[window] = (plan.arrays(), plan.containers)
    plans = spark.sparkContext.broadcast(shared)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, rest, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("window_id", "rest", "rank"))
            out = np.full(len(rest), -1, np.int64)
            for w, (runs, _) in plans.value.items():
                own = (window == w) & (rest > 0)
                if not own.any():
                    continue
                width = np.int64(1) << 40
                at = np.searchsorted(runs[:, 0] * width + runs[:, 1], rest[own] * width + rank[own] - 1, side="right") - 1
                run = runs[at]
                out[own] = run[:, 3] + (rank[own] - 1 - run[:, 1]) // run[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("window_id", "capacity", "doc", "rest", "fulls")), pa.array(out)], ["window_id", "capacity", "doc", "rest", "fulls", "container"])

    placed = ranked.select("window_id", "capacity", "doc", "rest", "fulls", "rank").mapInArrow(rows, f"window_id int, capacity long, doc {kind}, rest long, fulls long, container long")
    last = placed.where("rest > 0").select("window_id", "container", "doc", F.col("fulls").cast("int").alias("piece"), (F.col("fulls") * F.col("capacity")).alias("token_from"), F.col("rest").alias("token_count"))
    # full pieces: numbered behind the plan's containers
    whole = grouped_rank(ranked.where("fulls > 0").select("window_id", "capacity", "doc", F.explode(F.sequence(F.lit(0), F.col("fulls").cast("int") - 1)).alias("piece")), ["window_id"], ["doc", "piece"], "number")
    base = F.element_at(F.create_map(*[F.lit(x) for w, (_, c) in shared.items() for x in (w, c)]), F.col("window_id")).cast("long")
    full = whole.select("window_id", (base + F.col("number") - 1).alias("container"), "doc", "piece", (F.col("piece") * F.col("capacity")).alias("token_from"), F.col("capacity").alias("token_count"))
    return last.unionByName(full)
