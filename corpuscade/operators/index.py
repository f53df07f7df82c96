"""A stored retrieval index: hashed vectors and term counts of every chunk, made once and read by every question."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import tokens_col
from ..session import remove, scalars, written
from . import lexical
from .lexical import B, K1
from .ranking import top_k_per_group

#: Number of the tables' form; an index of another form isn't read.
FORMAT = 1
#: Questions that are sent to all tasks at a time, and cells of a matrix that a task makes at once.
BLOCK = 1024
CELLS = 1 << 22


_TOKEN = re.compile("[a-zA-Z0-9]+")


def words(text: str | None) -> list[str]:
    """The tokens of :func:`corpuscade.functions.text.tokens_col`, of a question on the driver."""
    return [t.lower() for t in _TOKEN.findall(text or "")]


@dataclass(frozen=True)
class ChunkIndex:
    """Tables below ``path``: ``chunks`` (as given), ``forward`` (of each chunk its domain, length,
    terms with counts, and vector components), ``postings`` (term, chunk_id, tf, dl in the order of
    terms, so that a scan for a few terms opens few row groups), ``terms`` (df), ``stats`` (n, avgdl)."""

    spark: SparkSession
    path: str
    dim: int = 256

    @classmethod
    def write(cls, chunks: DataFrame, path: str, dim: int = 256) -> ChunkIndex:
        """Index ``chunks`` (chunk_id, unique, with domain, text and further columns); what lies at ``path`` is replaced."""
        index = cls.write_postings(chunks, path, dim)
        index.add_forward()
        return index

    @classmethod
    def write_postings(cls, chunks: DataFrame, path: str, dim: int = 256) -> ChunkIndex:
        """An index for :meth:`lexical` and :meth:`every_lexical` only; :meth:`add_forward` makes it whole."""
        index = cls(chunks.sparkSession, path, dim)
        remove(index.spark, f"{path}/forward")
        index._save(chunks, "chunks")
        tokens = index.chunks.select("chunk_id", tokens_col(F.col("text")).alias("tokens"))
        counted = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        index._save(counted.repartitionByRange("term", "chunk_id").sortWithinPartitions("term"), "postings")
        index._save(index._read("postings").groupBy("term").agg(F.count("*").alias("df")), "terms")
        index._save(tokens.select(F.size("tokens").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")), "stats")
        return index

    def add_forward(self) -> None:
        """Write ``forward``, from which :meth:`scan` reads."""
        own = self.chunks
        lists = self._read("postings").groupBy("chunk_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("t"))  # one chunk's terms
        parts = vectors.hashed_components(own, "chunk_id", "text", self.dim).groupBy("chunk_id").agg(F.collect_list(F.struct("dim", "value")).alias("v"))  # at most dim
        full = own.select("chunk_id", "domain").join(lists, "chunk_id", "left").join(parts, "chunk_id", "left")
        empty = lambda column, kind: F.coalesce(column, F.array().cast(f"array<{kind}>"))
        self._save(full.select("chunk_id", "domain", F.coalesce("dl", F.lit(0)).alias("dl"), empty(F.col("t.term"), "string").alias("terms"), empty(F.col("t.tf"), "int").alias("tfs"), empty(F.col("v.dim"), "int").alias("dims"), empty(F.col("v.value"), "double").alias("vals")), "forward")

    def has(self, name: str) -> bool:
        """Is the table written to its end?"""
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def _save(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "lz4").parquet(f"{self.path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int = 256) -> ChunkIndex:
        return cls(spark, path, dim)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def stats(self) -> tuple[int, float]:
        row = self._read("stats").first()
        return row["n"], row["avgdl"]

    def lexical(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """``query_id, chunk_id, score`` by BM25 over the postings of the queries' terms.

        Up to ``BLOCK`` distinct terms they are a filter of the scan; beyond, a join.  Without
        ``limit`` every pair of a query and a chunk with a common term is listed; with it, the
        best are found without these rows (:func:`corpuscade.operators.lexical.top`), scores
        rounded to 9 digits.
        """
        if limit is not None:
            return self._best(queries, limit)
        posted, asked, idf, weight = self._posted(queries)
        weighed = posted.join(asked.join(self._read("terms"), "term"), "term")
        return weighed.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * idf * weight).alias("score"))

    def _posted(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, Column, Column]:
        """The postings of the queries' terms (if these are few), the queries' terms, a term's idf, what a posting counts for."""
        asked = queries.select("query_id", F.explode(tokens_col(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        few = [r["term"] for r in asked.select("term").distinct().limit(BLOCK + 1).collect()]
        posted = self._read("postings")
        posted = posted.where(F.col("term").isin(few)) if len(few) <= BLOCK else posted
        n, avgdl = self.stats()
        length = K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)) if avgdl > 0 else F.lit(K1)
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return posted, asked, idf, F.col("tf") * (K1 + 1) / (F.col("tf") + length)

    def _best(self, queries: DataFrame, limit: int, ties: DataFrame | None = None) -> DataFrame:
        """The first ``limit`` chunks of every query, ties by chunk_id or the ``key`` of ``ties``."""
        posted, asked, idf, weight = self._posted(queries)
        weighed = posted.join(asked.select("term").distinct(), "term", "left_semi").select("chunk_id", "term", weight.alias("w"))
        asked = asked.join(self._read("terms"), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
        return lexical.top(weighed, asked, "chunk_id", "query_id", limit, 9, ties)

    def every_lexical(self, queries: DataFrame, limit: int) -> DataFrame:
        """``query_id, chunk_id, score, place``: the first ``limit`` chunks of every question by
        BM25, ties by document and position; chunks without a term of it follow with score 0.

        Those are taken from the first 2 * limit chunks in that order, of which less than
        ``limit`` can be matches of a question that has fewer matches than that.
        """
        order = ("document_id", "position", "chunk_id")
        chunks = self.chunks.select(*order)
        ties = chunks.groupBy("chunk_id").agg(F.min(F.struct(*order)).alias("key"))
        best = written(self._best(queries, limit, ties).where("score > 0"), "best")
        first = best.join(chunks, "chunk_id")
        head = chunks.orderBy(*order).limit(2 * limit).agg(F.collect_list(F.struct(*order)).alias("l"))  # 2 * limit at most
        asked = queries.where(F.size(tokens_col(F.col("query_text"))) > 0).select("query_id").distinct()
        short = asked.join(first.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit)
        rest = short.select("query_id", F.explode(scalars(head)["l"]).alias("c")).select("query_id", "c.*").join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
        both = top_k_per_group(first.select("query_id", "chunk_id", "score", "document_id", "position").unionByName(rest), ["query_id"], [F.desc("score"), *order], limit)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))
        return both.select("query_id", "chunk_id", "score", place.alias("place"))

    def scan(self, queries: DataFrame, keep: int, weights: tuple[float, float] | None = None, domains: list[str] | None = None, sparse_queries: DataFrame | None = None) -> DataFrame:
        """Both legs of every question over every chunk (of ``domains``), in one pass over the forward table.

        With ``weights``: ``query_id, chunk_id, dense_norm, sparse_norm, combined``, the chunks
        that may be among a question's ``keep`` best by the weighted sum of the dense leg (scaled
        between its extremes) and the lexical leg (divided by its maximum); a first pass takes
        the extremes.  Without: ``query_id, chunk_id, leg, score``, those that may be among the
        ``keep`` best of leg ``dense`` (chunks that share a component) or ``sparse`` (a term), of
        ``sparse_queries`` if given; a score of equal rank with the last one kept is kept too.
        Scores are rounded to 9 digits.  Statistics of terms are of all chunks.

        The questions are sent to all tasks in blocks of ``BLOCK``; a task multiplies its chunks
        with a block and hands on ``keep`` rows a question and batch, so nothing else is shuffled.
        """
        texts = queries.where(F.size(tokens_col(F.col("query_text"))) > 0).select("query_id", F.col("query_text").alias("dense_text"))
        if sparse_queries is None:
            texts = texts.withColumn("sparse_text", F.col("dense_text"))
        else:
            texts = texts.join(sparse_queries.select("query_id", F.col("query_text").alias("sparse_text")), "query_id", "left")
        base = self._read("forward")
        base = base.where(F.col("domain").isin(domains)) if domains else base
        kind = queries.schema["query_id"].dataType.simpleString()
        n, avgdl = self.stats()
        out, held = None, []

        def block() -> DataFrame:
            return self._block(base, self._weighed(held, n), keep, weights, kind, avgdl)

        for row in texts.distinct().toLocalIterator():  # a block of questions at a time
            held.append((row["query_id"], words(row["dense_text"]), words(row["sparse_text"])))
            if len(held) == BLOCK:
                out, held = block() if out is None else out.unionByName(block()), []
        if held or out is None:
            out = block() if out is None else out.unionByName(block())
        return out

    def _weighed(self, asked: list, n: int) -> list:
        """A block's questions with vector components and weighed terms: (id, [(dim, value)], [(term, qtf * idf)])."""
        vocabulary = sorted({t for _, _, terms in asked for t in terms})
        known = self.spark.createDataFrame([(t,) for t in vocabulary], "term string").join(self._read("terms"), "term").collect() if vocabulary else []  # the block's terms
        idf = {r["term"]: math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in known}
        return [(q, vectors.hashed_tokens(dense, self.dim), [(t, f * idf[t]) for t, f in Counter(terms).items() if t in idf]) for q, dense, terms in asked]

    def _block(self, base: DataFrame, asked: list, keep: int, weights: tuple[float, float] | None, kind: str, avgdl: float) -> DataFrame:
        dim = self.dim
        vocabulary = sorted({t for _, _, terms in asked for t, _ in terms})
        place = {t: k for k, t in enumerate(vocabulary)}
        q, w = np.zeros((dim, len(asked))), np.zeros((len(vocabulary), len(asked)))
        for k, (_, comps, terms) in enumerate(asked):
            for d, v in comps:
                q[d, k] = v
            for t, x in terms:
                w[place[t], k] = x
        ids = [a[0] for a in asked]
        shared = self.spark.sparkContext.broadcast((q, w, vocabulary))
        arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

        def legs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
            q, w, vocabulary = shared.value
            known = pa.array(vocabulary, pa.string())
            step = max(1, CELLS // max(1, dim, len(ids), len(vocabulary)))
            for whole in batches:
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    rows = batch.num_rows
                    names, dl, terms, tfs, dims, vals = batch.columns
                    v = np.zeros((rows, dim))
                    at = np.repeat(np.arange(rows), np.diff(dims.offsets.to_numpy()))
                    v[at, dims.flatten().to_numpy()] = vals.flatten().to_numpy()
                    p = np.zeros((rows, len(vocabulary)))
                    at = np.repeat(np.arange(rows), np.diff(terms.offsets.to_numpy()))
                    found = pc.index_in(terms.flatten(), value_set=known)
                    here = found.is_valid().to_numpy(zero_copy_only=False)
                    tf, size = tfs.flatten().to_numpy()[here], dl.to_numpy()[at[here]]
                    p[at[here], found.drop_null().to_numpy()] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avgdl if avgdl > 0 else 1))
                    shares = (v != 0).astype(np.float32) @ (q != 0).astype(np.float32) > 0
                    yield names, v @ q, p @ w, shares

        columns = base.select("chunk_id", "dl", "terms", "tfs", "dims", "vals")

        def cut(score: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The rows and questions of what may be among the best ``keep`` of each question."""
            score = np.where(allowed, score, -np.inf)
            if len(score) > keep:
                allowed = allowed & (score >= np.partition(score, len(score) - keep, axis=0)[len(score) - keep])
            return np.nonzero(allowed)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, dense, sparse, shares in legs(batches):
                for leg, score, allowed in (("dense", np.round(dense, 9), shares), ("sparse", np.round(sparse, 9), sparse > 0)):
                    row, col = cut(score, allowed)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[c] for c in col], arrow), names.take(pa.array(row)), pa.array([leg] * len(row), pa.string()), pa.array(score[row, col])], ["query_id", "chunk_id", "leg", "score"])

        if weights is None:
            return columns.mapInArrow(best, f"query_id {kind}, chunk_id string, leg string, score double")

        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, most = np.full(len(ids), np.inf), np.full(len(ids), -np.inf), np.zeros(len(ids))
            for _, dense, sparse, _ in legs(batches):
                low, high, most = np.minimum(low, dense.min(axis=0)), np.maximum(high, dense.max(axis=0)), np.maximum(most, sparse.max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(low), pa.array(high), pa.array(most)], ["k", "lo", "hi", "ms"])

        ends = {r["k"]: r for r in columns.mapInArrow(extremes, "k long, lo double, hi double, ms double").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("ms").alias("ms")).collect()}  # a row a question of the block
        lo, hi, ms = (np.array([ends[k][c] if k in ends else 0.0 for k in range(len(ids))]) for c in ("lo", "hi", "ms"))

        def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(all="ignore"):
                for names, dense, sparse, _ in legs(batches):
                    dense = np.where(hi > lo, (dense - lo) / np.where(hi > lo, hi - lo, 1), 0.0)
                    sparse = np.where(ms > 0, sparse / np.where(ms > 0, ms, 1), 0.0)
                    score = np.round(weights[0] * dense + weights[1] * sparse, 9)
                    row, col = cut(score, np.ones(score.shape, bool))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[c] for c in col], arrow), names.take(pa.array(row)), pa.array(dense[row, col]), pa.array(sparse[row, col]), pa.array(score[row, col])], ["query_id", "chunk_id", "dense_norm", "sparse_norm", "combined"])

        return columns.mapInArrow(combined, f"query_id {kind}, chunk_id string, dense_norm double, sparse_norm double, combined double")
