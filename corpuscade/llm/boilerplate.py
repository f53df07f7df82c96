"""Main body against boilerplate: flat text blocks, their features and those of their neighbours, a decision tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_col
from .boilerplate_labels import LABELLED
from .repeated_lines import distinct_docs, site_lines

#: The features in the order of the labelled table and of the tree.
FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "beside_title", "marked", "after_title", "pages", "names_site")

_TOKEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head|svg)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<![^>]*>|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"[a-zA-Z_:][-\w:.]*\s*=")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
# Elements that don't start a block of their own, and elements without content.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: lists and quotations without attributes belong to the element they stand in
TRANSPARENT = frozenset("ul ol dl blockquote".split())
PLAIN = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt blockquote pre td th".split())


@dataclass(slots=True)
class Block:
    """A run of text between block-level tags."""

    text: str
    words: int
    links: float
    parent: int
    element: str
    marked: int


def text_blocks(source: str | None) -> tuple[list[Block], int, int]:
    """Blocks of a page in order, the number of its title block (-1 if none) and the title's parent.

    Parsing is one pass over tags and text with a stack of open elements; a closing tag without
    its opener is passed over, one that skips openers closes them.  Comments, scripts, styles
    and the head are left out.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, number, attributes
    number, title, title_parent = 0, -1, -1
    pieces: list[str] = []
    linked: list[str] = []
    inline_marks, in_link = 0, 0

    def close() -> None:
        nonlocal title, title_parent, inline_marks
        if pieces:
            text = _BLANK.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] in INLINE:
                    depth -= 1
                name, _, attributes = stack[depth]
                above = depth - 1
                while above > 0 and stack[above][0] in TRANSPARENT and not stack[above][2]:
                    above -= 1
                parent = stack[above][1] if depth else -1
                if name == "h1" and title < 0:
                    title, title_parent = len(blocks), parent
                words = len(_WORD.findall(text))
                inside = len(_WORD.findall(entities.unescape(" ".join(linked))))
                blocks.append(Block(text, words, min(1.0, inside / max(1, words)), parent, name, attributes + inline_marks + (name not in PLAIN)))
            pieces.clear()
            linked.clear()
        inline_marks = 0

    for token in _TOKEN.finditer(source or ""):
        name = token.group(3)
        if name is None:
            part = token.group(0)
            if part[0] != "<" or part == "<":
                pieces.append(part)
                if in_link:
                    linked.append(part)
            continue
        name = name.lower()
        if token.group(2):
            at = len(stack) - 1
            while at > 0 and stack[at][0] != name:
                at -= 1
            if at == 0:
                continue
            if name not in INLINE:
                close()
            in_link -= sum(1 for s in stack[at:] if s[0] == "a")
            del stack[at:]
        elif name in VOID:
            if name in ("br", "hr"):
                close()
        else:
            if name in INLINE:
                # an inline element that opens a block marks it
                if not "".join(pieces).strip():
                    inline_marks += 1
            else:
                close()
                if name in ("p", "li") and stack[-1][0] == name:
                    stack.pop()
            number += 1
            if not token.group(4).rstrip().endswith("/"):
                stack.append((name, number, len(_ATTRIBUTE.findall(token.group(4)))))
                in_link += name == "a"
    close()
    return blocks, title, title_parent


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(_BLANK.sub(" ", text).strip()) - (1 << 63)


# Second labels below which names are registered.
SECOND_LEVEL = frozenset("ac co com edu gov net org".split())


def site_name(site: str | None) -> str:
    """The registered label of a host: ``uni`` of ``www.uni.example`` and of ``uni.ac.uk``."""
    labels = (site or "").split(".")
    if len(labels) > 2 and labels[-2] in SECOND_LEVEL:
        return labels[-3]
    return labels[-2] if len(labels) > 1 else labels[0]


def one_version(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of several rows of one page the one with the smallest ``version``."""
    return rows.groupBy("page_id").agg(F.min_by(F.struct(*columns), "version").alias("v")).select("page_id", *[f"v.{c}" for c in columns])


def page_blocks(raw: DataFrame) -> DataFrame:
    """``page_id, version, blocks``: digest and features of each block of the html; ``version`` tells
    contents of one page apart; duplicates may remain."""
    fields = "array<struct<d:bigint,words:int,links:float,beside:boolean,marked:int,after:boolean>>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source in batch.column(1).to_pylist():
                found, title, parent = text_blocks(source)
                out.append([{"d": _digest(b.text), "words": b.words, "links": b.links, "beside": b.parent == parent, "marked": b.marked, "after": k >= title} for k, b in enumerate(found)] if title >= 0 else [{"d": _digest(b.text), "words": b.words, "links": b.links, "beside": True, "marked": b.marked, "after": True} for b in found])
            kind = pa.list_(pa.struct([("d", pa.int64()), ("words", pa.int32()), ("links", pa.float32()), ("beside", pa.bool_()), ("marked", pa.int32()), ("after", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, kind)], ["page_id", "version", "blocks"])

    return raw.where("html IS NOT NULL AND html <> ''").select(F.col("page_id").cast("long"), "html", F.xxhash64("html").alias("version")).mapInArrow(rows, f"page_id long, version long, blocks {fields}")


def page_lines(extracted: DataFrame) -> DataFrame:
    """``page_id, version, site, lines``: the lines of a text that aren't blank, with digest and words.

    ``named``: the line has its site's registered name as a word.
    """
    fields = "array<struct<n:int,d:bigint,words:int,named:boolean>>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for site, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                name = site_name(site)
                lines = []
                for n, line in enumerate((text or "").split("\n")):
                    if line.strip():
                        words = _WORD.findall(line)
                        lines.append({"n": n, "d": _digest(line), "words": len(words), "named": name in (w.lower() for w in words)})
                out.append(lines)
            kind = pa.list_(pa.struct([("n", pa.int32()), ("d", pa.int64()), ("words", pa.int32()), ("named", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), pa.array(out, kind)], ["page_id", "version", "site", "lines"])

    return extracted.where("text IS NOT NULL").select(F.col("page_id").cast("long"), host_col(F.col("url")).alias("site"), "text", F.xxhash64("text").alias("version")).mapInArrow(rows, f"page_id long, version long, site string, lines {fields}")


def _aligned(lines: Sequence[dict], blocks: Sequence[dict]) -> Iterator[tuple[dict, dict | None]]:
    """Each line with the block it came from: the next one with the same digest, if there is one."""
    at = 0
    places: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        places.setdefault(b["d"], []).append(k)
    for line in lines:
        if at < len(blocks) and blocks[at]["d"] == line["d"]:
            yield line, blocks[at]
            at += 1
            continue
        later = [k for k in places.get(line["d"], ()) if k >= at]
        if later:
            at = later[0] + 1
            yield line, blocks[later[0]]
        else:
            yield line, None


def line_features(raw: DataFrame, extracted: DataFrame) -> DataFrame:
    """``page_id, line_no`` and the :data:`FEATURES` of every line that isn't blank.

    Words and link density of the line's block and of the blocks before and behind it; whether
    the block stands in the same element as the title; how much markup of its own it has;
    whether it follows the title; on how many pages of its site the line stands; whether it
    names the site.  Lines whose block isn't found (a page without html, changed text) count
    as unmarked blocks beside the title without links.  Only digests and numbers are shuffled.
    """
    texts = one_version(page_lines(extracted), ["lines"])
    markup = one_version(page_blocks(raw), ["blocks"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "line_no", "words", "links", "prev_words", "prev_links", "next_words", "next_links", "beside_title", "marked", "after_title", "names_site")
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names}
            for page, lines, blocks in zip(*[batch.column(c).to_pylist() for c in ("page_id", "lines", "blocks")]):
                pairs = list(_aligned(lines, blocks or ()))
                words = [line["words"] for line, _ in pairs]
                links = [b["links"] if b else 0.0 for _, b in pairs]
                cols["page_id"] += [page] * len(pairs)
                cols["line_no"] += [line["n"] for line, _ in pairs]
                cols["words"] += words
                cols["links"] += links
                cols["prev_words"] += [0, *words[:-1]][: len(words)]
                cols["prev_links"] += [0.0, *links[:-1]][: len(links)]
                cols["next_words"] += [*words[1:], 0][: len(words)]
                cols["next_links"] += [*links[1:], 0.0][: len(links)]
                cols["beside_title"] += [int(b["beside"]) if b else 1 for _, b in pairs]
                cols["marked"] += [b["marked"] if b else 0 for _, b in pairs]
                cols["after_title"] += [int(b["after"]) if b else 1 for _, b in pairs]
                cols["names_site"] += [int(line["named"]) for line, _ in pairs]
            kinds = {"page_id": pa.int64(), "links": pa.float32(), "prev_links": pa.float32(), "next_links": pa.float32()}
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], kinds.get(n, pa.int32())) for n in names], list(names))

    schema = "page_id long, line_no int, words int, links float, prev_words int, prev_links float, next_words int, next_links float, beside_title int, marked int, after_title int, names_site int"
    own = texts.join(markup, "page_id", "left").select("page_id", "lines", "blocks").mapInArrow(rows, schema)
    keyed = site_lines(extracted.withColumn("page_id", F.col("page_id").cast("long")))
    often = distinct_docs(keyed, ["site", "key"]).where("docs > 1")
    spread = keyed.join(often, ["site", "key"]).groupBy(F.col("doc").alias("page_id"), "line_no").agg(F.max("docs").alias("pages"))
    return own.join(spread, ["page_id", "line_no"], "left").withColumn("pages", F.coalesce("pages", F.lit(1)).cast("int"))


@dataclass(slots=True)
class Leaf:
    share: float


@dataclass(slots=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Leaf | Split:
    """A classification tree by Gini impurity; y is 1 for boilerplate."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return Leaf(share)
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.cumsum(t)
        n = np.arange(1, len(t) + 1)
        ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (len(t) - n[:-1] >= least))
        if not len(ok):
            continue
        a, k = left[ok], n[ok]
        b, m = left[-1] - a, len(t) - k
        cost = 2 * a * (k - a) / k + 2 * b * (m - b) / m
        at = int(np.argmin(cost))
        if cost[at] < best[0]:
            best = (float(cost[at]), f, float((v[ok[at]] + v[ok[at] + 1]) / 2))
    if best[1] is None:
        return Leaf(share)
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def as_column(tree: Leaf | Split) -> Column:
    """The tree as one expression, so rows are classified without leaving the JVM."""
    if isinstance(tree, Leaf):
        return F.lit(tree.share >= 0.5)
    return F.when(F.col(FEATURES[tree.feature]) <= F.lit(tree.at), as_column(tree.low)).otherwise(as_column(tree.high))


def trained() -> Leaf | Split:
    """The tree of the labelled table, which is bounded to fewer than 200 rows."""
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def boilerplate_lines(raw: DataFrame, extracted: DataFrame, tree: Leaf | Split | None = None) -> DataFrame:
    """``page_id, line_no, boilerplate`` of every line that isn't blank.

    Null texts have no rows, and so have pages of ``raw`` without text.  Repeated rows count
    once; of several texts of one page_id the one with the smallest hash is taken.  Other columns are ignored.

    The method's own features, words and link density of a block and its neighbours, don't tell
    these templates apart by themselves (the figures are in the README), so the tree is given
    the block's place, its own markup, and how often its site has the line as well.
    """
    return line_features(raw, extracted).select("page_id", "line_no", as_column(tree or trained()).alias("boilerplate"))


def main_body(raw: DataFrame, extracted: DataFrame) -> DataFrame:
    """``page_id, text`` of the main body; pages of boilerplate only have an empty text."""
    gone = boilerplate_lines(raw, extracted).groupBy("page_id").agg(F.collect_set(F.when(F.col("boilerplate"), F.col("line_no"))).alias("gone"))  # one page's lines
    unique = one_version(extracted.where("text IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), "text", F.xxhash64("text").alias("version")), ["text"])
    numbered = F.transform(F.split("text", "\n"), lambda line, n: F.struct(n.alias("n"), line.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["n"]) & x["line"].rlike(r"(?U)\S"))
    return unique.join(gone, "page_id", "left").select("page_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))
