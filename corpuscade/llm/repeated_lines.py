"""Lines and blocks of lines that one site repeats over many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_col
from ..session import written

#: Stands behind the end of a document in a window of line keys.
PAD = -(2**63)


def line_key(line: Column) -> Column:
    """What makes lines the same: case, white space and digits are left out; null if nothing else is there."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(line), "ß", "ss"), r"(?U)[\s\d]+", "")
    return F.when(bare != "", F.xxhash64(bare))


def site_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """``site, doc, line_no, key``: the lines with a key of each page.

    Exact duplicate rows count once.  Null or blank texts have no lines; a null url gives the
    site ''.  Lines are split at line feeds only and counted from 0, blank ones included.
    The keys are written once, as counting and marking both read them.
    """
    lines = pages.select(F.col(id_col).alias("doc"), F.coalesce(host_col(F.col(url_col)), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return written(lines.select("site", "doc", "line_no", line_key(F.col("line")).alias("key")).where("key IS NOT NULL"), "lines")


def distinct_docs(df: DataFrame, keys: list[str]) -> DataFrame:
    """``docs``: number of distinct documents of each key, counted in two hash aggregations, so
    that the rows of a frequent key are first thinned out by (key, doc) all over the cluster."""
    return df.groupBy(*keys, "doc").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("docs"))


def site_documents(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """``site, doc, texts``: of each page the sequence of its line keys, as ``array<struct<line_no, key>>``.

    Lines as in :func:`site_lines`; those without a key are left out, so they don't break a
    block.  Exact duplicate rows count once; other texts under the same id are further sequences
    of the same document.
    """
    # what line_key leaves out of a line is left out of the whole text at once, line feeds apart
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.col(text_col)), "ß", "ss"), r"(?U)[\s\d&&[^\n]]+", "")
    numbered = F.transform(F.split(bare, "\n"), lambda line, n: F.struct(n.alias("line_no"), F.when(line != "", F.xxhash64(line)).alias("key")))
    rows = pages.where(F.col(text_col).isNotNull()).select(F.coalesce(host_col(F.col(url_col)), F.lit("")).alias("site"), F.col(id_col).alias("doc"), F.filter(numbered, lambda x: x["key"].isNotNull()).alias("lines"))
    return rows.where(F.size("lines") > 0).groupBy("site", "doc").agg(F.collect_set("lines").alias("texts"))  # one document's texts


def _lists(values: np.ndarray, kept: np.ndarray) -> pa.ListArray:
    """The kept entries of each row of a matrix, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)), pa.array(values[kept]))


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of up to ``width`` numbers as a padded matrix, and their lengths."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    at = offsets[:-1, None] + np.arange(width)
    inside = at < offsets[1:, None]
    return np.where(inside, flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else PAD, PAD), np.diff(offsets)


def _suffixes(documents: DataFrame, width: int, depth: int, of: str) -> DataFrame:
    """``ctx, doc, site, v, seq, line_no, win, weight``: windows of the suffixes of line sequences.

    ``documents``: site, doc, texts, and from the second round on ``starts``, the suffixes still
    to be followed as ``array<struct<v, seq, ctx>>``, of which ``depth`` lines are known and
    named by ``ctx``.  A window holds the next ``width`` lines, or fewer at the document's end.
    Each suffix weighs 1.  Suffixes of one document with a common beginning would count it
    twice: in the document's own suffix order every two neighbours give a row (seq -1) of their
    common prefix that weighs -1, so the weights of all windows that begin with a prefix add up
    to the number of distinct documents that hold it.
    """
    first = depth == 0
    kind = pa.int64() if of == "bigint" else pa.int32() if of == "int" else pa.string()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            of_doc, inner = texts.offsets.to_numpy(), texts.values
            of_text = inner.offsets.to_numpy()
            numbers, keys = inner.values.field(0).to_numpy(), inner.values.field(1).to_numpy()
            keys = np.where(keys == PAD, PAD + 1, keys)
            if first:
                low, high = of_text[of_doc[0]], of_text[of_doc[-1]]
                begin = np.arange(low, high)
                text = np.searchsorted(of_text, begin, "right") - 1
                doc = np.searchsorted(of_doc, text, "right") - 1
                v, seq = text - of_doc[doc], begin - of_text[text]
                ctx, code = batch.column(0).take(pa.array(doc)), doc
            else:
                starts = batch.column(3)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
                given = starts.flatten()
                v, seq, ctx = given.field(0).to_numpy(), given.field(1).to_numpy(), given.field(2)
                text = of_doc[doc] + v
                begin = of_text[text] + seq
                code = ctx.dictionary_encode().indices.to_numpy()
            at = (begin + depth)[:, None] + np.arange(width)
            inside = at < of_text[text + 1][:, None]
            win = np.where(inside, keys[np.minimum(at, max(0, len(keys) - 1))], PAD) if len(keys) else np.empty((0, width), np.int64)
            some = inside.any(axis=1)
            order = np.lexsort((*win.T[::-1], code, doc))
            a, b = order[:-1], order[1:]
            same = (win[a] == win[b]) & inside[a] & inside[b] & ((doc[a] == doc[b]) & (code[a] == code[b]))[:, None]
            common = np.cumprod(same, axis=1).astype(bool)
            twice = common.any(axis=1)
            for pick, shown, weight in ((np.flatnonzero(some), inside[some], 1), (a[twice], common[twice], -1)):
                n, mine = len(pick), pa.array(pick)
                own = weight > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ctx.take(mine),
                        batch.column(1).take(pa.array(doc[pick])) if own else pa.nulls(n, kind),
                        batch.column(0).take(pa.array(doc[pick])) if own else pa.nulls(n, pa.string()),
                        pa.array(v[pick].astype(np.int32)),
                        pa.array((seq[pick] if own else np.full(n, -1)).astype(np.int32)),
                        pa.array(numbers[begin[pick]].astype(np.int32)),
                        _lists(win[pick], shown),
                        pa.array(np.full(n, weight, np.int32)),
                    ],
                    ["ctx", "doc", "site", "v", "seq", "line_no", "win", "weight"],
                )

    return documents.mapInArrow(rows, f"ctx string, doc {of}, site string, v int, seq int, line_no int, win array<long>, weight int")


def _common_prefixes(suffixes: DataFrame, width: int, min_docs: int) -> DataFrame:
    """``ctx, win, lines, docs``: of each distinct window the longest prefix that ``min_docs``
    documents hold, and how many hold it; windows without such a prefix are left out.

    The distinct windows are brought into suffix order over range partitions, so windows with a
    common prefix stand together.  A task walks through the order in batches, takes the common
    prefixes of neighbours and adds up the weights of every run with one prefix.  A run that
    touches the first or last row of its batch may go on in another: those few sums, at most two
    for each prefix length and batch, are added up over all batches and handed back by batch.
    However many windows share a prefix, no task and no row holds more than a batch of them.
    """
    laid = suffixes.groupBy("ctx", "win").agg(F.sum("weight").alias("weight")).repartitionByRange("ctx", "win").sortWithinPartitions("ctx", "win")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            win, size = _matrix(batch.column(1), width)
            weight = batch.column(2).to_numpy()
            ctx = batch.column(0)
            same_ctx = np.array(ctx.slice(1).to_numpy(zero_copy_only=False) == ctx.slice(0, n - 1).to_numpy(zero_copy_only=False), bool).reshape(-1)
            both = np.minimum(size[1:], size[:-1])[:, None] > np.arange(width)
            common = np.cumprod((win[1:] == win[:-1]) & both & same_ctx[:, None], axis=1).sum(axis=1)
            sure, docs, to_first, to_last = (np.zeros(n, np.int64) for _ in range(4))
            heads, tails = [], []
            for length in range(1, width + 1):
                run = np.concatenate([[0], np.cumsum(common < length)])
                sums = np.bincount(run, weights=weight).astype(np.int64)
                held = size >= length
                inner = held & (run != run[0]) & (run != run[-1])
                good = inner & (sums[run] >= min_docs)
                sure[good], docs[good] = length, sums[run][good]
                to_first[held & (run == run[0])] = length
                to_last[held & (run == run[-1])] = length
                if size[0] >= length:
                    heads.append(int(sums[0]))
                if size[-1] >= length:
                    tails.append(0 if run[-1] == 0 else int(sums[-1]))
            edge = lambda at, values: pa.array([values if k == at else None for k in range(n)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ctx, batch.column(1), pa.array(np.full(n, uid)), *(pa.array(x.astype(np.int32)) for x in (sure, docs, to_first, to_last)), edge(0, heads), edge(n - 1, tails)], ["ctx", "win", "uid", "sure", "docs", "to_first", "to_last", "heads", "tails"])
            uid += 1

    ordered = written(laid.select("ctx", "win", "weight").mapInArrow(rows, "ctx string, win array<long>, uid long, sure int, docs int, to_first int, to_last int, heads array<long>, tails array<long>"), "order")
    edges = None
    for side, name in ((0, "heads"), (1, "tails")):
        own = ordered.where(F.col(name).isNotNull()).select("uid", F.lit(side).alias("side"), "ctx", "win", F.posexplode(name).alias("at", "part"))
        own = own.select("uid", "side", (F.col("at") + 1).alias("lines"), "ctx", F.slice("win", F.lit(1), F.col("at") + 1).alias("prefix"), "part")
        edges = own if edges is None else edges.unionByName(own)
    totals = edges.groupBy("ctx", "prefix").agg(F.sum("part").alias("docs")).where(F.col("docs") >= min_docs)
    known = edges.join(totals, ["ctx", "prefix"]).groupBy("uid").agg(F.collect_list(F.struct("side", "lines", F.col("docs").cast("int").alias("docs"))).alias("known"))  # at most two a prefix length
    joined = ordered.join(known, "uid", "left")
    fitting = F.filter("known", lambda x: x["lines"] <= F.when(x["side"] == 0, F.col("to_first")).otherwise(F.col("to_last")))
    best = F.greatest(F.struct(F.col("sure").alias("lines"), "docs"), F.coalesce(F.array_max(F.transform(fitting, lambda x: F.struct(x["lines"], x["docs"]))), F.struct(F.lit(0).alias("lines"), F.lit(0).alias("docs"))))
    return joined.select("ctx", "win", best.alias("b")).where("b.lines > 0").select("ctx", "win", "b.lines", "b.docs")


def repeated_blocks(documents: DataFrame, min_docs: int, window: int = 4) -> DataFrame:
    """``site, doc, line_no, block_lines, block, docs``: of each line that starts a repeated block
    the longest block from there that stands in ``min_docs`` documents of the site.

    ``documents`` as :func:`site_documents` gives them.  The suffixes of all line sequences of a
    site are ordered by their first ``window`` lines and their common prefixes taken (see
    :func:`_common_prefixes`); suffixes that share all of a window with enough documents go on
    with the next lines, twice as many as before, within those that share what is known.  So
    blocks have any length, and a round more is needed each time that length doubles.

    Every line of a repeated block starts one itself, as a block's tail stands in at least the
    documents of the block: the lines with a row here are the lines all blocks cover.  Lines are
    told apart by 64-bit keys, within one site.
    """
    of = documents.schema["doc"].dataType.simpleString()
    documents = written(documents, "documents")
    depth, width, now, found = 0, window, documents, None
    while True:
        suffixes = written(_suffixes(now, width, depth, of), "suffixes")
        common = _common_prefixes(suffixes, width, min_docs)
        here = written(suffixes.where("seq >= 0").join(common, ["ctx", "win"]).select("site", "doc", "v", "seq", "line_no", (F.col("lines") + depth).alias("block_lines"), "docs", F.xxhash64("ctx", F.slice("win", F.lit(1), F.col("lines"))).alias("block"), F.when(F.col("lines") == width, F.concat("ctx", F.lit(" "), F.hex(F.xxhash64("win")), F.hex(F.xxhash64("win", F.lit(1))))).alias("next")), "blocks")
        found = here if found is None else found.unionByName(here)
        whole = here.where("next IS NOT NULL")
        if whole.isEmpty():
            break
        further = whole.groupBy("site", "doc").agg(F.collect_list(F.struct("v", "seq", F.col("next").alias("ctx"))).alias("starts"))  # one document's lines
        now = documents.join(further, (documents["site"] == further["site"]) & documents["doc"].eqNullSafe(further["doc"])).select(documents["site"], documents["doc"], "texts", "starts")
        depth, width = depth + width, 2 * width
    best = F.max_by(F.struct("block_lines", "block", "docs"), F.struct("block_lines", "docs", "block"))
    return found.groupBy("site", "doc", "line_no").agg(best.alias("b")).select("site", "doc", "line_no", "b.*")


def repeated_lines(pages: DataFrame, min_docs: int = 10, id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """``doc, line_no``: the lines of all blocks that stand on ``min_docs`` distinct documents of one site."""
    return repeated_blocks(site_documents(pages, id_col, url_col, text_col), min_docs).select("doc", "line_no").distinct()


def without_repeated_lines(pages: DataFrame, min_docs: int = 10, id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """Every page as ``id, text`` without the blocks its site repeats; other lines stay as they are.

    Null texts stay null.  Repeated rows of a page give one row.
    """
    marked = repeated_lines(pages, min_docs, id_col, url_col, text_col).groupBy("doc").agg(F.collect_set("line_no").alias("gone"))  # one document's lines
    unique = pages.select(F.col(id_col), F.col(text_col)).distinct()
    joined = unique.join(marked, unique[id_col].eqNullSafe(marked["doc"]), "left")
    numbered = F.transform(F.split(text_col, "\n"), lambda line, n: F.struct(n.alias("n"), line.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["n"]))
    return joined.select(id_col, F.when(F.col(text_col).isNotNull(), F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias(text_col))
