"""BM25 over postings tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens_col
from ..session import located, scalars, work_path, written

K1, B = 1.5, 0.75
#: Documents of the first and of the largest blocks that a task of :func:`top` inverts, and postings of a block.
FIRST, HELD, POSTINGS = 1 << 12, 1 << 16, 1 << 22
#: Questions that a task of :func:`top` holds at most, and those for which it isn't worth another task.
QUESTIONS, FEW = 2048, 64


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf``; the first aggregation combines on the map side, so long texts cost their distinct terms."""
    return docs.select(F.col(id_col), F.explode(tokens_col(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def weighted_postings(docs: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """``id, term, weight``: term frequencies over several text columns, each with its weight."""
    parts = [docs.select(F.col(id_col), F.explode(tokens_col(F.col(c))).alias("term"), F.lit(w).alias("w")) for c, w in fields.items()]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy(id_col, "term").agg(F.sum("w").alias("weight"))


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, dl``: tokens of every document, 0 for null texts."""
    return docs.select(F.col(id_col), F.size(tokens_col(F.col(text_col))).alias("dl"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """One row: ``n, avgdl``."""
    return sizes.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def doc_freqs(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(freqs: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf``."""
    n = scalars(stats)["n"]
    return freqs.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str, question_col: str) -> DataFrame:
    """``query, id, score`` of all documents that share a term with a query.

    Query terms count as often as they are repeated.  The postings are cut to the queries' terms
    before anything else (a semi join that Catalyst broadcasts if its size allows), so neither
    document frequencies nor lengths of other terms are shuffled.  It lists every pair of a query
    and a document with a common term; :func:`top` finds the best without.
    """
    asked = question_terms(queries, query_col, question_col)
    sized = docs.select(F.col(id_col), tokens_col(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))
    posted, stats = _matched(sized, asked, id_col), _sizes(sized)
    weights = idf(doc_freqs(posted), stats).select("term", "idf")
    weighed = posted.withColumn("w", saturation(scalars(stats)["avgdl"])).join(weights, "term").join(asked, "term")
    return weighed.groupBy(query_col, id_col).agg(F.sum(F.col("idf") * F.col("w") * F.col("qtf")).alias("score"))


def best_scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str, question_col: str, limit: int, digits: int = 9) -> DataFrame:
    """The first ``limit`` rows of :func:`scores` of every query, scores rounded to ``digits``, ties by the id."""
    asked = question_terms(queries, query_col, question_col)
    sized = written(docs.select(F.col(id_col), tokens_col(F.col(text_col)).alias("tokens")), "tokens").withColumn("dl", F.size("tokens"))
    posted, stats = written(_matched(sized, asked, id_col), "posted"), _sizes(sized)
    weights = idf(doc_freqs(posted), stats).select("term", "idf")
    weighed = posted.select(id_col, "term", saturation(scalars(stats)["avgdl"]).alias("w"))
    return top(weighed, asked.join(weights, "term").select(query_col, "term", (F.col("qtf") * F.col("idf")).alias("weight")), id_col, query_col, limit, digits)


def question_terms(queries: DataFrame, query_col: str, question_col: str) -> DataFrame:
    """``query, term, qtf``."""
    return queries.select(F.col(query_col), F.explode(tokens_col(F.col(question_col))).alias("term")).groupBy(query_col, "term").agg(F.count("*").alias("qtf"))


def saturation(avgdl: Column) -> Column:
    """What a posting (``tf``, ``dl``) counts for, without its term's idf."""
    length = F.when(avgdl > 0, K1 * (1 - B + B * F.col("dl") / avgdl)).otherwise(F.lit(K1))
    return F.col("tf") * (K1 + 1) / (F.col("tf") + length)


def _matched(sized: DataFrame, asked: DataFrame, id_col: str) -> DataFrame:
    wanted = asked.select("term").distinct()
    return sized.select(id_col, "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def _sizes(sized: DataFrame) -> DataFrame:
    return sized.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def top(weighed: DataFrame, asked: DataFrame, id_col: str, query_col: str, limit: int, digits: int = 9, ties: DataFrame | None = None) -> DataFrame:
    """``query, id, score``: of each query the ``limit`` documents with the largest sum of ``w`` of
    ``weighed`` (id, term, w) times ``weight`` of ``asked`` (query, term, weight), both above 0.

    Scores are rounded to ``digits`` first; ties go to the smaller id, or to the smaller ``key`` of
    ``ties`` (id, key).  This is the result of a join and a sum without their rows, of which a
    frequent term makes one for each query and document that have it.  The documents are written
    in the order of ties, range-partitioned; a task holds its share of the queries and reads the
    documents in blocks, inverted for its terms.  Of a query only the terms without which no
    document comes above the last one held are walked through (MaxScore); the others are looked up
    for what is left.  As later documents lose every tie, no candidate is shuffled.
    """
    spark = weighed.sparkSession
    docs = weighed.groupBy(id_col).agg(F.collect_list(F.struct("term", "w")).alias("t"))
    docs = docs.withColumn("key", F.col(id_col)) if ties is None else docs.join(ties.select(id_col, "key"), id_col)
    path, questions = work_path(spark, "weighed"), work_path(spark, "asked")
    docs.repartitionByRange("key").sortWithinPartitions("key").select(id_col, F.col("t.term").alias("terms"), F.col("t.w").alias("ws")).write.option("compression", "snappy").parquet(path)
    asked.groupBy(query_col).agg(F.collect_list(F.struct("term", "weight")).alias("t")).select(query_col, F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")).write.option("compression", "lz4").parquet(questions)
    held = spark.read.parquet(questions)
    count = held.count()
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-count // FEW)), -(-count // QUESTIONS), 1)
    sizes = FIRST, HELD, POSTINGS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        whole = pa.Table.from_batches(own)
        names, terms = whole.column(0), whole.column(1).to_pylist()
        place = {t: n for n, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
        asked = [(np.array([place[t] for t in own], np.int64), np.array(x)) for own, x in zip(terms, whole.column(2).to_pylist())]
        best, kind = [(np.empty(0), np.empty(0, object))] * len(asked), pa.null()
        for kind, *block in _blocks(path, list(place), sizes):
            best = [_better(own, k, x, block, limit, digits) for own, (k, x) in zip(best, asked)]
        for low in range(0, len(asked), FEW):
            some = best[low : low + FEW]
            if any(len(scores) for scores, _ in some):
                line = np.repeat(np.arange(low, low + len(some)), [len(scores) for scores, _ in some])
                ids = pa.array([i for _, held in some for i in held], kind)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(line)).combine_chunks(), ids, pa.array(np.concatenate([scores for scores, _ in some]))], [query_col, id_col, "score"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c, df in ((query_col, held), (id_col, weighed))]
    return held.repartition(tasks).mapInArrow(search, ", ".join([*kinds, "score double"]))


def _blocks(path: str, vocabulary: list[str], sizes: tuple[int, int, int]) -> Iterator[tuple]:
    """The documents below ``path`` in their order, a block at a time: the type of their ids, the
    ids, and for all terms of ``vocabulary`` one after the other the documents that have it (their
    places in the block, ascending) and their weights; where each term begins; each term's largest weight."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, where = located(path)
    known, (size, most_docs, most_postings) = pa.array(vocabulary, pa.string()), sizes
    ids, parts, postings = [], [], 0

    def inverted() -> tuple:
        term, doc, w = (np.concatenate(x) for x in zip(*parts))
        key = term * len(ids) + doc
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))  # a document that stands in ``weighed`` with several lengths has a term more than once
        term, doc = np.divmod(key[first], len(ids))
        w = np.add.reduceat(w, first) if len(first) else w
        bounds = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        most, there = np.zeros(len(vocabulary)), np.flatnonzero(np.diff(bounds))
        if len(there):
            most[there] = np.maximum.reduceat(w, bounds[there])
        names = np.empty(len(ids), object)
        names[:] = ids
        return kind, names, doc, w, bounds, most

    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")):
        with system.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(sizes[0], use_threads=False):
                kind, (own, terms, ws) = batch.schema.field(0).type, batch.columns
                doc = len(ids) + np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
                found = pc.index_in(terms.flatten(), value_set=known)
                here = found.is_valid().to_numpy(zero_copy_only=False)
                parts.append((found.drop_null().to_numpy().astype(np.int64), doc[here], ws.flatten().to_numpy()[here]))
                ids += own.to_pylist()
                postings += len(parts[-1][0])
                if len(ids) >= size or postings >= most_postings:
                    yield inverted()
                    ids, parts, postings, size = [], [], 0, min(4 * size, most_docs)
    if ids:
        yield inverted()


def _better(best: tuple[np.ndarray, np.ndarray], k: np.ndarray, x: np.ndarray, block: list, limit: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (scores, ids; in order) of a query of terms ``k`` weighed ``x`` after a further block."""
    (scores, held), (ids, doc, w, bounds, most) = best, block
    full = len(scores) == limit
    least = max(0.0, scores[-1] - 10.0**-digits) if full else 0.0  # a document at or below it isn't among the best
    reach = x * most[k]
    order = np.argsort(-reach, kind="stable")
    k, x, rest = k[order], x[order], np.append(np.cumsum(reach[order][::-1])[::-1], 0.0)  # rest: what the terms from here on add at most
    walked = np.count_nonzero(rest > least)
    if not walked:
        return best
    at = [slice(bounds[t], bounds[t + 1]) for t in k]
    sums = np.bincount(np.concatenate([doc[a] for a in at[:walked]]), np.concatenate([v * w[a] for v, a in zip(x, at[:walked])]), len(ids))
    found = np.flatnonzero((sums > 0) & (sums + rest[walked] > least))
    sums = sums[found]
    for n in range(walked, len(k)):
        if len(own := doc[at[n]]):
            spot = np.minimum(np.searchsorted(own, found), len(own) - 1)
            sums = sums + np.where(own[spot] == found, x[n] * w[at[n]][spot], 0.0)
        stay = sums + rest[n + 1] > least
        found, sums = found[stay], sums[stay]
    sums = np.round(sums, digits)
    if full:
        found, sums = found[sums > scores[-1]], sums[sums > scores[-1]]
    if not len(found):
        return best
    both = np.concatenate([scores, sums])
    order = np.argsort(-both, kind="stable")[:limit]
    return both[order], np.concatenate([held, ids[found]])[order]
