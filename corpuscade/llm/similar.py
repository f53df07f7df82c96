"""The most similar vectors of every vector: collision counting over single projections, exact search in crowds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import top_k_per_group
from ..session import located, work_path, written

#: Projections are kept in steps of this part of a standard deviation, up to 255 of them.
STEPS = 40
#: Values of a matrix that a task makes at once, and collisions it lists at once.
SLICE, LISTED = 1 << 22, 1 << 18
FIXED_POINT = 32767.0


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, count]).standard_normal((dim, count), dtype=np.float32)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, key, vec``: unit vectors as 16-bit fixed point (an error of the cosine below 3e-5)
    with a digest of theirs.  Left out: null ids or vectors, other lengths than ``dim``, entries
    that are null, NaN or infinite, and zero vectors.  The length of a vector doesn't matter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            good = np.flatnonzero((sizes == dim) & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False))
            flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[good]
            x = flat[starts[:, None] + np.arange(dim)] if len(good) else np.empty((0, dim))
            with np.errstate(all="ignore"):
                peak = np.abs(x).max(axis=1, initial=0)
                fine = np.isfinite(peak) & np.isfinite(x).all(axis=1) & (peak > 0)
                x = x[fine] / peak[fine][:, None]  # so that no square overflows or vanishes
                x /= np.linalg.norm(x, axis=1)[:, None]
            packed = np.rint(x * FIXED_POINT).astype("<i2")
            raw = [r.tobytes() for r in packed]
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good[fine])).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "vec"])

    return df.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(rows, "id long, key binary, vec binary")


def joined(values: pa.Array, kind: str) -> np.ndarray:
    """The bytes of a binary column without nulls, one value behind the other, as numbers."""
    if not len(values):
        return np.empty(0, kind)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    low, high = int(ends[values.offset]), int(ends[values.offset + len(values)])
    return np.frombuffer(data, np.uint8)[low:high].view(kind) if high > low else np.empty(0, kind)


def unpack(vecs: pa.Array, dim: int) -> np.ndarray:
    return joined(vecs, "<i2").reshape(-1, dim).astype(np.float32) / np.float32(FIXED_POINT)


def meetings(tail: np.ndarray, height: np.ndarray, asked: np.ndarray, now: int, window: int, threshold: int, most: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``x, y, first, crowded``: of the array of direction ``now``, the entries y that collide with an
    asked entry x there and in ``threshold`` directions altogether, x itself among them, and
    whether it is x's first direction in which they do.  An x of more than ``most`` pairs is
    named in ``crowded`` instead, before they are listed where their number alone tells.

    The entries are listed by direction and projection, so what collides with x in a further
    direction is one stretch of that list: the work is in proportion to the collisions.
    """
    size, t = tail.shape
    at = height[np.arange(size), (tail == now).argmax(axis=1)].astype(np.int16)
    # all collide in the array's own direction, which is left out of the list unless one is enough
    others, needed = np.flatnonzero((tail.ravel() != now) | (threshold < 2)), max(1, threshold - 1)
    key = tail.ravel()[others].astype(np.int64) << 8 | height.ravel()[others]
    order = np.argsort(key)
    key, entry = key[order], others[order] // t << 1
    own_tail, own_height = tail[asked].astype(np.int64) << 8, height[asked].astype(np.int64)
    low = np.searchsorted(key, own_tail | np.maximum(own_height - window, 0), "left")
    number = np.searchsorted(key, own_tail | np.minimum(own_height + window, 255), "right") - low
    around, widest = np.sort(at), t - (threshold > 1)
    near = np.searchsorted(around, at[asked] + window, "right") - np.searchsorted(around, at[asked] - window, "left")
    # those out of the window take widest collisions at most, those within it widest or fewer than needed: the pairs there are at least
    sure = (number.sum(axis=1) - (size - near) * widest - near * (needed - 1)) / max(1, widest - needed + 1) > most
    yield *(np.empty(0, np.int64),) * 2, np.empty(0, bool), asked[sure]
    asked, low, number = asked[~sure], low[~sure], number[~sure]
    later = np.arange(t) >= (tail[asked] == now).argmax(axis=1)[:, None]
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(number.sum(axis=1)) // LISTED)) + 1).tolist(), len(asked)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        n = number[i:j].ravel()
        total = int(n.sum())
        stretch = np.repeat(low[i:j].ravel() - np.cumsum(n) + n, n) + np.arange(total)
        # one number for x, y and whether it is behind the array's own direction in x's tail
        code = np.sort(np.repeat(((np.arange(j - i) * size)[:, None] << 1 | later[i:j]).ravel(), n) + entry[stretch])
        pair = code >> 1
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        starts = starts[np.diff(starts, append=total) >= needed]
        row, y = np.divmod(pair[starts], size)
        x, first = asked[i:j][row], code[starts] & 1 == 1
        near = np.abs(at[x] - at[y]) <= window
        crowd = np.bincount(row[near], minlength=j - i) > most
        near &= ~crowd[row]
        yield x[near], y[near], first[near], asked[i:j][crowd]


def at_least(mean: float, count: int) -> float:
    """Probability that a Poisson number of that mean is ``count`` or more."""
    return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(max(0, count)))


class SimilarVectors:
    """The k nearest by cosine of every vector.

    Each direction is one Gaussian projection with an array of its own, sorted by the projection.
    A vector is entered in the ``tail`` arrays in which its projection is largest, where the
    density is low (12 arrays of up to 512, and with more directions 12 (m / 512)^0.3, as a
    pair of the same cosine then collides less often); a query looks into its first ``probes`` arrays, at the window around its own
    projection.  Two vectors collide once for every direction whose tail holds both, no further
    apart than the window; a pair with at least ``thresholds[round]`` collisions is verified by
    its cosine.  A query of which k verified neighbours don't lie within the round's radius
    (``radii``, as cosines) goes on to the next round (virtual rehashing): over the same
    projections with a wider window, 2.5 standard deviations of what two vectors at that round's
    radius are apart, and one collision less.  The last round has no window.

    The number of directions grows with the square root of the number of vectors, so an array
    has some 6 sqrt(n) entries; one task holds it.  Vectors are projected once, in slices of a fixed
    number of values, so a task's memory doesn't depend on the number of directions; the rounds
    read the stored tails only.

    Crowds: where very many vectors are alike, collisions don't tell the nearest of them apart.
    A query that meets more than ``enough`` candidates in one array beyond four times what chance
    gives an array of that size, or looks into an array of more than ``segment`` entries (or four
    times the mean, if that is more), is compared with
    every vector instead, in blocks, so its neighbours are exact; arrays of that size are left
    out for all others.  A crowd of a third of all vectors so costs n * n / 3 cosines.
    Outside crowds the search is approximate; recall against brute
    force is in the README and held by a test.

    Equal vectors are one class, so copies don't crowd others out: ``classes`` has every id
    with its class (the smallest id) and the class's size.
    """

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, tail: int | None = None, probes: int = 5, thresholds: tuple[int, ...] = (5, 4, 3), radii: tuple[float, ...] = (0.9, 0.7), segment: int = 4096, enough: int = 64, seed: int = 11) -> None:
        self.enough = enough
        self.dim, self.k, self.probes, self.thresholds, self.radii, self.segment, self.seed = dim, k, probes, thresholds, radii, segment, seed
        table = written(usable_vectors(df, id_col, vec_col, dim), "vectors")
        reps = table.groupBy("key").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
        self.classes = written(table.select("id", "key").distinct().join(reps, "key").select("id", "rep", "copies"), "classes")
        own = self.classes.where("id = rep").select("rep")
        self.count = own.count()
        self._large: list[int] | None = None
        self.directions = max(32, 1 << round(math.log2(2 * math.sqrt(max(1, self.count)))))
        self.tail = tail or round(12 * max(1.0, self.directions / 512) ** 0.3)
        self.vectors = written(self._projected(table.withColumnRenamed("id", "rep").join(own, "rep", "left_semi").dropDuplicates(["rep"])), "projected")

    def _projected(self, vectors: DataFrame) -> DataFrame:
        """``rep, vec, dirs, tail, height``: each vector with the directions of its tail, largest
        projection first, the same packed, and the projections in steps of 1 / STEPS."""
        dim, m, t, seed = self.dim, self.directions, min(self.tail, self.directions), self.seed

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = directions(dim, m, seed)
            step = max(1, SLICE // m)
            for whole in batches:
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    h = unpack(batch.column(1), dim) @ a
                    top = np.argpartition(-h, t - 1, axis=1)[:, :t]
                    val = np.take_along_axis(h, top, 1)
                    order = np.argsort(-val, axis=1, kind="stable")
                    top, val = np.take_along_axis(top, order, 1), np.take_along_axis(val, order, 1)
                    dirs = pa.ListArray.from_arrays(np.arange(0, top.size + 1, t, dtype=np.int32), pa.array(top.ravel().astype(np.int32)))
                    tails = pa.array([r.tobytes() for r in top.astype("<u4" if m > 65536 else "<u2")], pa.binary())
                    heights = pa.array([r.tobytes() for r in np.clip(np.rint(val * STEPS), 0, 255).astype(np.uint8)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dirs, tails, heights], ["rep", "vec", "dirs", "tail", "height"])

        return vectors.select("rep", "vec").mapInArrow(rows, "rep long, vec binary, dirs array<int>, tail binary, height binary")

    def _postings(self, queries: DataFrame | None) -> DataFrame:
        """``dir, rep, query, tail, height``: a row for each direction of a vector's tail, with the
        whole tail and its projections; ``query`` in the directions into which a query looks."""
        flagged = self.vectors.select("rep", "dirs", "tail", "height")
        if queries is None:
            flagged = flagged.withColumn("query", F.lit(True))
        else:
            flagged = flagged.join(queries.withColumn("query", F.lit(True)), "rep", "left")
        each = flagged.select(F.posexplode("dirs").alias("place", "dir"), "rep", "query", "tail", "height")
        return each.select("dir", "rep", (F.coalesce("query", F.lit(False)) & (F.col("place") < self.probes)).alias("query"), "tail", "height")

    def _candidates(self, queries: DataFrame | None, number: int) -> DataFrame:
        """Pairs (query a, other b) with enough collisions, of the given queries in round
        ``number``; where every vector is a query (None), ``a < b``, each pair once.  A query
        in a crowd comes with itself."""
        both_ways = queries is None
        enough = self.enough
        threshold, wide, t = self.thresholds[number], self.directions > 65536, min(self.tail, self.directions)
        # of the others in an array, the share that collides often enough by chance
        chance = at_least((t - 1) * t / self.directions, threshold - 1)
        window = round(2.5 * math.sqrt(2 - 2 * self.radii[number]) * STEPS) if number < len(self.radii) else 255
        if self._large is None:
            limit = max(self.segment, 4 * t * self.count // self.directions)
            sizes = self.vectors.select(F.explode("dirs").alias("dir")).groupBy("dir").count()
            self._large = [r["dir"] for r in sizes.where(F.col("count") > limit).collect()]  # at most a quarter of the directions
        postings = self._postings(queries)
        if self._large:  # else they are read once
            postings = written(postings, "postings")
        ordered = postings.where(~F.col("dir").isin(self._large)).repartition("dir").sortWithinPartitions("dir")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, part = None, []

            def meet() -> pa.RecordBatch:
                rep, query, tail, height = (np.concatenate([p[k] for p in part]) for k in range(4))
                size, out = len(rep), []
                for x, y, first, crowded in meetings(tail, height, np.flatnonzero(query), now, window, threshold, enough + 4 * size * chance):
                    kept = first & (rep[x] != rep[y])
                    x, y = x[kept], y[kept]
                    if both_ways:
                        x, y = np.where(rep[x] < rep[y], x, y), np.where(rep[x] < rep[y], y, x)
                    out += [x * size + y, crowded * (size + 1)]
                a, b = np.divmod(np.unique(np.concatenate(out)) if out else np.empty(0, np.int64), max(1, size))
                return pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], ["a", "b"])

            for batch in batches:
                dirs = batch.column("dir").to_numpy()
                rep, query = batch.column("rep").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
                tail = joined(batch.column("tail"), "<u4" if wide else "<u2").reshape(-1, t)
                height = joined(batch.column("height"), "u1").reshape(-1, t)
                cuts = [0, *(np.flatnonzero(np.diff(dirs)) + 1).tolist(), len(dirs)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    if x == y:
                        continue
                    if part and now != dirs[x]:
                        yield meet()
                        part = []
                    now = int(dirs[x])
                    part.append((rep[x:y], query[x:y], tail[x:y], height[x:y]))
            if part:
                yield meet()

        met = ordered.mapInArrow(rows, "a long, b long")
        if self._large:
            met = met.unionByName(postings.where(F.col("query") & F.col("dir").isin(self._large)).select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        # a query meets another where they collide first, so only pairs seen from both sides are repeated
        return met.distinct() if both_ways else met

    def _exact(self, queries: DataFrame, block: int = 2048, held: int = 1 << 18) -> DataFrame:
        """``rep, other, cos``: the k nearest of each of the queries by comparison with every vector.

        The queries' vectors are written to the shared folder.  A task holds its share of all
        vectors (in parts of ``held``), reads the queries block by block and keeps k a query: one
        scan and one plan, however many queries there are, and nothing passes the driver.
        """
        spark, dim, k = self.classes.sparkSession, self.dim, self.k
        base = self.vectors.select("rep", "vec")
        path = work_path(spark, "asked")
        base.join(queries.distinct(), "rep", "left_semi").write.option("compression", "snappy").parquet(path)

        def against(ids: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
            import pyarrow.dataset as ds

            system, where = located(path)
            for some in ds.dataset(where, format="parquet", filesystem=system).to_batches(batch_size=block):
                if not some.num_rows:
                    continue
                order = np.argsort(some.column(0).to_numpy())
                names, q = some.column(0).to_numpy()[order], unpack(some.column(1), dim)[order]
                line, best, found = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64)
                least = np.full(len(names), -np.inf, np.float32)
                for at in range(0, len(ids), block):
                    other = ids[at : at + block]
                    cos = q @ (vecs[at : at + block].astype(np.float32) / np.float32(FIXED_POINT)).T
                    own = np.minimum(np.searchsorted(names, other), len(names) - 1)
                    same = np.flatnonzero(names[own] == other)
                    cos[own[same], same] = -np.inf
                    low = np.partition(cos, len(other) - k, axis=1)[:, len(other) - k] if len(other) > k and not len(line) else least
                    row, col = np.nonzero((cos >= low[:, None]) & (cos > -np.inf))
                    line, best, found = np.concatenate([line, row]), np.concatenate([best, cos[row, col]]), np.concatenate([found, other[col]])
                    order = np.lexsort((found, -best, line))
                    line, best, found = line[order], best[order], found[order]
                    kept = np.arange(len(line)) - np.searchsorted(line, line) < k
                    line, best, found = line[kept], best[kept], found[kept]
                    last = np.searchsorted(line, np.arange(len(names)), "right") - 1
                    many = np.bincount(line, minlength=len(names)) == k
                    least[many] = best[last[many]]
                yield pa.RecordBatch.from_arrays([pa.array(names[line]), pa.array(found), pa.array(best.astype(np.float64))], ["rep", "other", "cos"])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vecs, count = [], [], 0
            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                vecs.append(joined(batch.column(1), "<i2").reshape(-1, dim))
                count += batch.num_rows
                if count >= held:
                    yield from against(np.concatenate(ids), np.concatenate(vecs))
                    ids, vecs, count = [], [], 0
            if count:
                yield from against(np.concatenate(ids), np.concatenate(vecs))

        near = base.mapInArrow(rows, "rep long, other long, cos double")
        return written(top_k_per_group(near, ["rep"], [F.desc("cos"), F.asc("other")], k), "exact")

    def _verified(self, pairs: DataFrame, least: float, queries: DataFrame | None) -> DataFrame:
        """``a, b, cos`` of the pairs whose cosine is at least ``least``.

        The queries' vectors are joined first: a query's vector is then repeated over its pairs
        in order, which compresses well when the pairs move on to the others' vectors.
        """
        dim = self.dim

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cos = np.einsum("ij,ij->i", unpack(batch.column(2), dim), unpack(batch.column(3), dim)).astype(np.float64) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], ["a", "b", "cos"]).filter(pa.array(cos >= least))

        asked = self.vectors if queries is None else self.vectors.join(queries, "rep", "left_semi")
        left, right = asked.select(F.col("rep").alias("a"), F.col("vec").alias("x")), self.vectors.select(F.col("rep").alias("b"), F.col("vec").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long, cos double")

    def near(self) -> DataFrame:
        """``rep, other, cos``: verified neighbours of every class, at least the k nearest found.

        A round yields the pairs within its radius only; a query that isn't content with those
        is asked again with a lower threshold, which finds the same pairs and more.  The last
        round yields the k nearest of whatever it verified.  Queries in crowds are finished by
        exact search.
        """
        found, queries, crowds, last = None, None, None, len(self.thresholds) - 1
        for number in range(last + 1):
            met = written(self._verified(self._candidates(queries, number), self.radii[number] if number < last else -2.0, queries), "pairs")
            pairs, crowd = met.where("a <> b"), met.where("a = b").select(F.col("a").alias("rep")).distinct()
            crowds = crowd if crowds is None else crowds.unionByName(crowd)
            own = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cos")
            if queries is None:
                own = own.unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other"), "cos"))
            if number == last:
                own = top_k_per_group(own, ["rep"], [F.desc("cos"), F.asc("other")], self.k)
            found = own if found is None else found.unionByName(own)
            if number == last:
                break
            content = found.where(F.col("cos") >= self.radii[number]).repartition("rep").groupBy("rep").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= self.k)
            asked = self.vectors.select("rep") if queries is None else queries
            queries = written(asked.join(content.select("rep").unionByName(crowd), "rep", "left_anti").select("rep"), "queries")
            if queries.isEmpty():
                break
        if not crowds.isEmpty():
            exact = self._exact(crowds)
            found = found.unionByName(exact).unionByName(exact.select(F.col("other").alias("rep"), F.col("rep").alias("other"), "cos"))
        return found.groupBy("rep", "other").agg(F.max("cos").alias("cos"))

    def neighbours(self) -> DataFrame:
        """``id, neighbour, cos, place``: the k most similar other ids of every id (fewer where
        fewer were found), ties in the order of the ids; copies come first with cosine 1."""
        k = self.k
        near = top_k_per_group(self.near(), ["rep"], [F.desc("cos"), F.asc("other")], k)
        members = top_k_per_group(self.classes.select("rep", "id"), ["rep"], [F.asc("id")], k + 1)
        others = near.join(members.select(F.col("rep").alias("other"), F.col("id").alias("neighbour")), "other").select("rep", "neighbour", "cos")
        same = members.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("cos"))
        order = [F.desc("cos"), F.asc("neighbour")]
        listed = top_k_per_group(others.unionByName(same), ["rep"], order, k + 1).withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(*order)))
        # a row for each class, in numbers only, which Spark keeps in a hash table, unlike collected lists
        row = listed.groupBy("rep").agg(*[F.max(F.when(F.col("at") == n + 1, F.col(c))).alias(f"{c}{n}") for n in range(k + 1) for c in ("neighbour", "cos")])
        listing = F.array(*[F.struct(F.col(f"neighbour{n}").alias("neighbour"), F.col(f"cos{n}").alias("cos")) for n in range(k + 1)])
        per = self.classes.join(row, "rep").select("id", F.posexplode(F.slice(F.filter(listing, lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("place", "x"))
        return per.select("id", "x.neighbour", "x.cos", (F.col("place") + 1).alias("place"))
