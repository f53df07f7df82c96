"""Near-duplicate texts: bottom-k sketches, inverted lists of retained values, exact verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

WORD = re.compile(r"[^\W_]+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=np.uint64)


def shingle_hashes(words: list[str], size: int, memo: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` successive words (empty if too few)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    get = memo.get
    ids = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        ids[k] = h
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ ids[k : k + n]) * _MULT[k % 8]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MULT[5]
    mixed ^= mixed >> np.uint64(32)
    # as signed numbers in the order of the unsigned ones, as Spark has no other
    return (np.unique(mixed) ^ np.uint64(1 << 63)).view(np.int64)


def shingled(pages: DataFrame, id_col: str, text_col: str, size: int, k: int | None) -> DataFrame:
    """``doc, cls, n, sketch`` of the texts with at least one shingle: the ``k`` smallest hashes, or
    all of them where k is None; duplicates of a row may remain."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            docs, cls, counts, sketches = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or doc is None:
                    continue
                found = shingle_hashes(WORD.findall(text.lower()), size, memo)
                if len(memo) > 500_000:
                    memo.clear()
                if not len(found):
                    continue
                docs.append(doc)
                cls.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                counts.append(len(found))
                sketches.append(found[:k])
            as_list = lambda arrays: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cls, pa.string()), pa.array(counts, pa.int32()), as_list(sketches)], ["doc", "cls", "n", "sketch"])

    return pages.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, "doc long, cls string, n int, sketch array<long>")


def short_texts(pages: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``doc, digest`` of the texts with fewer words than a shingle: of the word sequence, null where there is no word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall((text or "").lower())
                if doc is not None and len(words) < size:
                    docs.append(doc)
                    digests.append("w" + xxhash.xxh3_128_hexdigest(" ".join(words)) if words else None)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digests, pa.string())], ["doc", "digest"])

    return pages.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, "doc long, digest string")


class NearDuplicates:
    """Classes of equal shingle sets, and all links between classes with Jaccard of at least ``threshold``.

    Sketch: the ``k`` smallest values of one hash function.  The union sketch of two texts has
    a binomial-like share of common values around their Jaccard coefficient; a pair stays in
    while that share is at least ``threshold - slack``, where slack is four standard deviations
    at k (a link at the threshold is lost with a probability below 1e-4, and links above it
    far more rarely).  Candidates come from inverted lists: a pair must share at least
    o = ceil((threshold - slack) * retained) values, so each text is entered only under its
    retained - o + c rarest values, of which a partner must share c = min(o, ``shared``).  A value that all pages of a site share is rare for no text
    but those that hold little else.

    Lists longer than ``list_limit`` aren't met pair by pair.  Texts of which such a value is
    among the rarest (pages of one template, with a sketch too coarse to tell them apart) are
    crowded: two crowded texts meet over their whole shingle sets instead, each under its
    rarest shingles among the crowded texts.  There the bound is exact: the shorter text of a
    link shares 2t/(1+t) of its own shingles, the longer one t, so one of the n - share + 1
    rarest is common.  Pages with more content of their own than that meet nobody over their
    template, however many there are; those with less are links, or nearly so.
    The last step compares the whole shingle sets, so no false link remains.  Whole sets are made
    of the texts that need them only, from the texts again, and never kept for all.

    ``members``: doc, cls (the text's class id, its smallest doc), one row per document.
    ``links``: a, b (class ids, a < b), common, jaccard.
    Null and blank texts and texts with fewer words than a shingle have no row there, but in
    ``every_member``.  Repeated rows
    count once; of different texts under one id the one with the smallest class digest counts.
    """

    def __init__(self, pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, k: int = 192, list_limit: int = 400, shared: int = 8) -> None:
        self.k, self.threshold, self.list_limit, self.shared = k, threshold, list_limit, shared
        self._short = short_texts(pages, id_col, text_col, size)
        self._source = (pages.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), size)
        self.slack = 4 * math.sqrt(threshold * (1 - threshold) / k)
        table = written(shingled(pages, id_col, text_col, size, k), "shingled")
        one = table.groupBy("doc").agg(F.min("cls").alias("digest"))
        reps = one.groupBy("digest").agg(F.min("doc").alias("cls"), F.count("*").alias("members"))
        self.members = written(one.join(reps, "digest").select("doc", "cls", "digest", "members"), "members")
        self._own = self.members.where("doc = cls").select(F.col("doc").alias("rep"))
        self._table = table.withColumnRenamed("doc", "rep")
        self._links: DataFrame | None = None

    @property
    def links(self) -> DataFrame:
        if self._links is None:
            self._links = written(self._find(), "links")
        return self._links

    def _classes(self) -> DataFrame:
        """``rep, n, sketch`` of one text a class.

        The smallest digest of an id is the one its class goes by.  Joined and grouped by
        ``rep``, so the rows move once."""
        rows = self._table.join(self._own, "rep", "left_semi")
        return rows.groupBy("rep").agg(F.min_by(F.struct("n", "sketch"), "cls").alias("x")).select("rep", "x.*")

    def _sets(self, among: DataFrame) -> DataFrame:
        """``rep, n, shingles`` of one text of each class in ``among``."""
        pages, size = self._source
        wanted = pages.join(among.select(F.col("rep").alias("doc")), "doc", "left_semi")
        rows = shingled(wanted, "doc", "text", size, None)
        return rows.groupBy(F.col("doc").alias("rep")).agg(F.min_by(F.struct("n", F.col("sketch").alias("shingles")), "cls").alias("x")).select("rep", "x.*")

    def _postings(self, slim: DataFrame) -> DataFrame:
        """``key, rep, n, least, hot``: each text under its rarest retained values; ``least`` is
        how many of them a partner must share, ``hot`` says that the value's list is too long."""
        low = self.threshold - self.slack
        entries = slim.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
        shared = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
        need = F.greatest(F.ceil(F.col("m") * F.lit(low)), F.lit(1)).cast("int")
        least = F.least(need, F.lit(self.shared))
        # values of one text only fill the prefix first; they lead to no pair
        ranked = entries.join(shared, "value").groupBy("rep", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))  # at most k entries
        kept = ranked.select("rep", "n", least.alias("least"), need.alias("need"), (F.size("v") - need + least).alias("room"), "v").where("size(v) >= need")
        single = kept.select("rep", "n", "least", F.explode(F.slice("v", F.lit(1), F.col("room"))).alias("x"))
        return single.select(F.col("x.value").alias("key"), "rep", "n", "least", (F.col("x.df") > self.list_limit).alias("hot"))

    def _candidates(self, postings: DataFrame) -> DataFrame:
        """Pairs that share ``least`` values of lists that aren't too long, and are of like size."""
        cold = postings.where("NOT hot")
        a, b = cold.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("least").alias("la")), cold.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("least").alias("lb"))
        met = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(self.threshold) * F.greatest("na", "nb"))).select("a", "b", F.least("la", "lb").alias("least"))
        return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")

    def _crowded(self, postings: DataFrame) -> DataFrame:
        """Pairs of crowded texts that may be linked, over the rarest of their whole shingle sets."""
        t = self.threshold
        crowd = written(postings.where("hot").select("rep").distinct(), "crowd")
        sets = written(self._sets(crowd), "crowded")
        entries = sets.select("rep", "n", F.explode("shingles").alias("value"))
        shared = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
        ranked = entries.join(shared, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))  # one text's shingles
        whole = lambda share: F.ceil(F.col("n") * F.lit(share) - F.lit(1e-6)).cast("int")
        bounds = ranked.select("rep", "n", "v", (F.size("v") - whole(t) + 1).alias("room"), (F.size("v") - whole(2 * t / (1 + t)) + 1).alias("near")).where("room > 0")
        placed = bounds.select("rep", "n", "near", (F.col("n") - F.size("v")).alias("own"), F.posexplode(F.slice("v", F.lit(1), F.col("room"))).alias("at", "x"))
        lists = written(placed.select(F.col("x.value").alias("key"), "rep", "n", (F.col("n") - F.col("own") - F.col("at")).alias("behind"), (F.col("at") < F.col("near")).alias("near")), "lists")
        a, b = (lists.select("key", F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("behind").alias("h" + x), "near") for x in "ab")
        a = a.where("near").drop("near")
        shorter = (F.struct("na", "a") < F.struct("nb", "b")) & (F.col("na") >= F.lit(t) * F.col("nb"))
        reach = F.least("ha", "hb") >= F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)
        met = a.join(b.drop("near"), (a["key"] == b["key"]) & shorter & reach)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _find(self) -> DataFrame:
        slim = written(self._classes(), "sketches")
        postings = written(self._postings(slim), "postings")
        pairs = self._candidates(postings)
        if not postings.where("hot").isEmpty():
            pairs = pairs.unionByName(self._crowded(postings)).distinct()
        left = slim.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
        right = slim.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
        both = pairs.join(left, "a").join(right, "b")
        k, low = self.k, self.threshold - self.slack

        def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (x, xs), (y, ys) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("sa"), batch.column("sb")))
                keep = []
                for n in range(batch.num_rows):
                    both = np.sort(np.concatenate([x[xs[n] : xs[n + 1]], y[ys[n] : ys[n + 1]]]))
                    twice = both[1:] == both[:-1]
                    union = both[np.concatenate([[True], ~twice])][:k]
                    keep.append(int((twice & (both[1:] <= union[-1])).sum()) >= low * len(union))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        likely = written(both.select("a", "b", "sa", "sb").mapInArrow(estimated, "a long, b long"), "likely")
        sets = written(self._sets(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "sets")
        whole = likely.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
        counted = whole.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
        return counted.withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).where(F.col("jaccard") >= self.threshold).select("a", "b", "common", "jaccard")

    def pairs(self) -> DataFrame:
        """All pairs ``doc_a < doc_b``, those within a class included; as many rows as there are pairs."""
        m = self.members.select("doc", "cls")
        left, right = m.select(F.col("doc").alias("x"), F.col("cls").alias("a")), m.select(F.col("doc").alias("y"), F.col("cls").alias("b"))
        between = self.links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
        within = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return between.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def every_member(self) -> DataFrame:
        """``members`` with all other documents: those with the same few words are one class, one without a word is its own."""
        one = self._short.groupBy("doc").agg(F.min("digest").alias("digest")).join(self.members.select("doc"), "doc", "left_anti")
        one = written(one, "short")
        reps = one.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("cls"), F.count("*").alias("members"))
        rest = one.join(reps, "digest", "left").select("doc", F.coalesce("cls", "doc").alias("cls"), "digest", F.coalesce("members", F.lit(1)).cast("long").alias("members"))
        return written(self.members.unionByName(rest), "every")

    def groups(self, same: DataFrame | None = None, every: bool = False) -> DataFrame:
        """``doc, class_id, members, links, group_id``: one row per document, those without a
        shingle included if ``every``.

        ``group_id`` is the smallest class id that can be reached over links (and over ``same``,
        further links between documents as ``a, b``).  Components are found by alternating
        large-star and small-star rounds on written tables until no edge changes.
        """
        members = self.every_member() if every else self.members
        edges = self.links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if same is not None:
            m = members.select("doc", "cls")
            edges = edges.unionByName(same.join(m.select(F.col("doc").alias("a"), F.col("cls").alias("u")), "a").join(m.select(F.col("doc").alias("b"), F.col("cls").alias("v")), "b").where("u <> v").select("u", "v")).distinct()
        label = components(edges)
        degree = self.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
        return members.join(degree, "cls", "left").join(label, "cls", "left").select("doc", F.col("cls").alias("class_id"), "members", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("root", "cls").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """``cls, root``: of each node of the edges ``u, v`` the smallest node of its component.

    Each round links every node's larger neighbours to its smallest (large star), then its
    smaller ones (small star); rounds end when the sum over all edges stays the same.  Only two
    numbers a round reach the driver.  A star's hub has few rows after the first rounds, and
    minima are combined on the map side.
    """
    now, before = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct(F.col("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    both = now.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("cls"), F.col("v").alias("root")))
    return both.groupBy("cls").agg(F.min("root").alias("root"))
