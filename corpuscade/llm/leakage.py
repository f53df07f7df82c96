"""Held-out passages inside training texts: an inverted index of the items, searched by every passage."""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import located, work_path, written

WORD = re.compile(r"[^\W_]+")
#: Characters of text that a task takes through the blocks of items at a time.
CHARACTERS = 1 << 22


def words(text: str) -> list[str]:
    """Lower-case runs of letters or digits after Unicode composition."""
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


@dataclass
class ItemIndex:
    """BM25 postings of the items with the maximum impact of every block, for block-max WAND.

    ``need[item]`` is the smallest score that ``span`` successive words of the item can reach
    on it, over all such runs of the item.  A passage's score is a sum over its distinct words
    and none is negative, so a passage that holds a run scores at least ``need``: retrieving
    everything at or above it loses no leak.
    """

    span: int = 12
    k1: float = 1.5
    b: float = 0.75
    block: int = 16
    terms: dict[str, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    docs: list[list[int]] = field(default_factory=list)
    impacts: list[list[float]] = field(default_factory=list)
    block_max: list[list[float]] = field(default_factory=list)
    top: list[float] = field(default_factory=list)
    need: list[float] = field(default_factory=list)
    floor: float = math.inf
    tops: np.ndarray = field(default_factory=lambda: np.empty(0))

    def build(self, items: list[tuple[object, str]]) -> ItemIndex:
        tokens = [(i, words(t)) for i, t in items if t]
        tokens = [(i, w) for i, w in tokens if len(w) >= self.span]
        self.ids = [i for i, _ in tokens]
        for _, w in tokens:
            self.texts.append(np.array([self.terms.setdefault(x, len(self.terms)) for x in w], np.int64))
        n, mean = len(tokens), sum(map(len, self.texts)) / max(1, len(tokens))
        df = np.zeros(len(self.terms), np.int64)
        for t in self.texts:
            df[np.unique(t)] += 1
        self.docs, self.impacts = [[] for _ in df], [[] for _ in df]
        for at, t in enumerate(self.texts):
            found, tf = np.unique(t, return_counts=True)
            weight = {}
            for term, f in zip(found.tolist(), tf.tolist()):
                idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                weight[term] = idf * f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * len(t) / mean))
                self.docs[term].append(at)
                self.impacts[term].append(weight[term])
            runs = (sum(weight[x] for x in set(t[s : s + self.span].tolist())) for s in range(len(t) - self.span + 1))
            self.need.append(min(runs) * (1 - 1e-9))
        self.block_max = [[max(i[k : k + self.block]) for k in range(0, len(i), self.block)] for i in self.impacts]
        self.top = [max(i) for i in self.impacts]
        self.tops = np.array([*self.top, 0.0])  # the last one for words that aren't indexed
        self.floor = min(self.need, default=math.inf)
        return self

    def search(self, terms: list[int]) -> list[int]:
        """Items whose score for the distinct ``terms`` reaches their own ``need``, by block-max WAND."""
        floor = self.floor
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            target = item
            if cursors[0][0] == item:
                near = sum(self.block_max[t][at // self.block] for _, at, t in cursors[: pivot + 1])
                if near >= self.need[item]:
                    score = sum(self.impacts[t][at] for _, at, t in cursors[: pivot + 1])
                    if score >= self.need[item]:
                        found.append(item)
                target = item + 1
            alive = []
            for k, (now, at, t) in enumerate(cursors):
                if k <= pivot and now < target:
                    docs = self.docs[t]
                    while at < len(docs) and docs[at] < target:
                        at += 1
                    if at == len(docs):
                        continue
                    now = docs[at]
                alive.append([now, at, t])
            cursors = alive
        return found

    def longest_common(self, passage: np.ndarray, item: int) -> int:
        """Length in words of the longest run that passage and item share."""
        mine = self.texts[item]
        row, best = np.zeros(len(mine) + 1, np.int64), 0
        for token in passage:
            row[1:] = np.where(mine == token, row[:-1] + 1, 0)
            best = max(best, int(row.max()))
        return best

    def leaks(self, tokens: list[str]) -> dict[int, int]:
        """Items that leaked into a text, given as words, each with the longest shared run in words.

        A run of ``span`` item words consists of indexed words only, so the text's maximal runs
        of indexed words are cut out first; passages are windows of twice the span over these,
        a span apart, of which one holds any such run entirely.  Passages whose words can't
        reach the lowest of all needed scores, whatever the item, aren't searched.
        """
        get, span = self.terms.get, self.span
        if len(tokens) < span:
            return {}
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        long = edges[1::2] - edges[::2] >= span
        if not long.any():
            return {}
        most = np.concatenate([[0.0], np.cumsum(self.tops[ids])])
        out: dict[int, int] = {}
        for start, end in zip(edges[::2][long].tolist(), edges[1::2][long].tolist()):
            seen: set[int] = set()
            for at in range(start, end - span + 1, span):
                stop = min(end, at + 2 * span)
                if most[stop] - most[at] < self.floor * (1 - 1e-9):
                    continue
                for item in self.search(list(set(ids[at:stop].tolist()))):
                    if item not in seen:
                        seen.add(item)
                        length = self.longest_common(ids[start:end], item)
                        if length >= span:
                            out[item] = max(length, out.get(item, 0))
        return out


def build_indexes(items: DataFrame, item_id: str, text: str, span: int, items_per_index: int) -> list[str]:
    """Indexes of blocks of the items as files in the shared folder; returns their names, one a block.

    Every block is built by the task that holds it; no item passes the driver.
    """
    spark = items.sparkSession
    own = items.where(F.col(text).isNotNull()).select(item_id, text).distinct()
    blocks = max(1, math.ceil(own.count() / items_per_index))
    folder = work_path(spark, "items")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        index = ItemIndex(span=span).build(held)
        if index.ids:
            system, at = located(f"{folder}/{uuid.uuid4().hex}")
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(at) as stream:
                stream.write(pickle.dumps(index))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at.rsplit('/', 1)[1]}"])], ["name"])

    return [r["name"] for r in written(own.repartition(blocks).mapInArrow(rows, "name string"), "indexes").collect()]  # one row a block


@lru_cache(maxsize=4)
def _index(name: str) -> ItemIndex:
    system, at = located(name)
    with system.open_input_stream(at) as stream:
        return pickle.loads(stream.read())


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = 12, items_per_index: int = 20_000) -> DataFrame:
    """``doc_id, item_id, words``: every document that holds at least ``span`` successive words
    of an item, with the length of the longest shared run.

    Items are the stated query set.  They are indexed in blocks of about ``items_per_index``,
    which lie in the shared folder; a task holds a few of them at a time.  The corpus is read
    and cut into words once, whatever their number: a task takes texts of ``CHARACTERS`` at a
    time through one block after another.  Nothing is shuffled but the result, for its
    ``distinct``.  Null or blank texts and items shorter than ``span`` give no rows; repeated
    rows count once; of several texts under one item id each is searched.  Other columns are
    ignored.
    """
    types = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema]}
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {types[item_id]}, words int"
    item_type = pa.int64() if types[item_id] in ("bigint", "int", "smallint") else pa.string()
    names = build_indexes(items, item_id, text, span, items_per_index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, last = [], 0, batch.num_rows - 1
            at, hit, length = [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                if body:
                    held.append((k, words(body)))
                    size += len(body)
                if size >= CHARACTERS or k == last:
                    for name in names:
                        index = _index(name)
                        for doc, tokens in held:
                            for item, run in index.leaks(tokens).items():
                                at.append(doc)
                                hit.append(index.ids[item])
                                length.append(run)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hit, item_type).cast(pa.int32() if types[item_id] == "int" else item_type), pa.array(length, pa.int32())], [doc_id, item_id, "words"])

    return docs.select(doc_id, text).mapInArrow(rows, schema).groupBy(doc_id, item_id).agg(F.max("words").alias("words"))
