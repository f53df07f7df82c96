"""Titles, links, sections and structural chunks of HTML, in Arrow batches."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<![^>]*>|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
# Elements without content, elements an opening tag closes, elements sections leave out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSED_BY |= {tag: {"p"} for tag in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
DROPPED = frozenset("script style noscript svg header footer nav aside form".split())
SECTION_LINES = frozenset("h1 h2 h3 h4 p li".split())
PROFILE_MARK = "profile"
PROFILE_TAGS = frozenset("div section article".split())


@dataclass
class Node:
    """An element, or a text if ``tag`` is empty."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    text: str = ""

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def content(self, gap: str = " ") -> str:
        return _SPACE.sub(" ", gap.join(n.text for n in self.walk() if not n.tag)).strip()


def parse(source: str | None) -> Node:
    """A tree of the page.  Missing closing tags are supplied, stray ones passed over; comments,
    scripts and styles are left out; nothing raises."""
    root = Node("#root")
    path = [root]
    for piece in _PIECE.finditer(source or ""):
        tag = piece.group(3)
        if tag is None:
            raw = piece.group(0)
            if (raw[0] != "<" or raw == "<") and raw:
                path[-1].children.append(Node("", text=entities.unescape(raw)))
            continue
        tag = tag.lower()
        if piece.group(2):
            for depth in range(len(path) - 1, 0, -1):
                if path[depth].tag == tag:
                    del path[depth:]
                    break
            continue
        ends = CLOSED_BY.get(tag, ())
        while len(path) > 1 and path[-1].tag in ends:
            path.pop()
        found = piece.group(4)
        node = Node(tag, {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(found)} if found.strip(" /") else {})
        path[-1].children.append(node)
        if tag not in VOID and not found.rstrip().endswith("/"):
            path.append(node)
    return root


def title_of(source: str | None, fallback: str = "Untitled") -> str:
    """Text of the title element, else of the first h1, else ``fallback``."""
    tree = parse(source)
    for tag in ("title", "h1"):
        node = tree.first(tag)
        if node and node.content():
            return node.content()
    return fallback


def links_of(source: str | None, base: str | None) -> list[str]:
    """Distinct absolute addresses of all anchors, in alphabetical order."""
    out = set()
    for node in parse(source).walk():
        if node.tag == "a" and "href" in node.attrs:
            try:
                out.add(urljoin(base or "", node.attrs["href"]))
            except ValueError:
                continue
    return sorted(out)


def _without(node: Node, tags: frozenset) -> Node:
    return Node(node.tag, node.attrs, [_without(c, tags) for c in node.children if c.tag not in tags], node.text)


def _container(tree: Node) -> Node:
    return next((n for n in map(tree.first, ("main", "article", "body")) if n), tree)


def sections_of(source: str | None) -> list[tuple[str, str]]:
    """(heading, text) of each section: headings h1 to h4 open one, paragraphs and list items are
    its lines.  A page without any such element is one section with its whole text."""
    tree = _container(_without(parse(source), DROPPED))
    out: list[tuple[str, str]] = []
    heading, lines = "General", []
    for node in tree.walk():
        if node.tag not in SECTION_LINES:
            continue
        text = node.content()
        if not text:
            continue
        if node.tag[0] == "h":
            if lines:
                out.append((heading, "\n".join(lines)))
            heading, lines = text, []
        else:
            lines.append(text)
    if lines:
        out.append((heading, "\n".join(lines)))
    if not out and tree.content():
        out.append(("General", tree.content()))
    return out


def body_text_of(source: str | None) -> str:
    """Text of the main container, a line a block."""
    tree = _container(_without(parse(source), DROPPED | {"head"}))
    lines = [n.content() for n in tree.walk() if n.tag in SECTION_LINES | {"td", "th", "dt", "dd", "h5", "h6", "pre", "blockquote"} and not any(c.tag in SECTION_LINES for c in n.walk() if c is not n)]
    return "\n".join(x for x in lines if x) or tree.content()


@dataclass(frozen=True)
class ChunkLimits:
    """Token limits of structural chunks, in estimated tokens."""

    least: int = 400
    most: int = 800
    cap: int = 1200


def estimated_tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def _table_text(node: Node) -> str:
    rows = [[c.content() for c in row.walk() if c.tag in ("td", "th")] for row in node.walk() if row.tag == "tr"]
    return "\n".join(" | ".join(r) for r in rows if any(r))


def _definitions(node: Node) -> str:
    out, term = [], ""
    for n in node.walk():
        if n.tag == "dt":
            term = n.content()
        elif n.tag == "dd":
            out.append(f"{term}: {n.content()}")
    return "\n".join(out)


def _structure(tree: Node) -> list[tuple[tuple[str, ...], list[str]]]:
    """Sections as (heading trail, parts): h1 to h3 cut, tables and definition lists stay whole."""
    out: list[tuple[tuple[str, ...], list[str]]] = []
    trail: list[str] = []
    parts: list[str] = []

    def visit(node: Node) -> None:
        nonlocal parts
        for child in node.children:
            if child.tag in ("h1", "h2", "h3"):
                text = child.content()
                if text:
                    if parts:
                        out.append((tuple(trail), parts))
                        parts = []
                    trail[int(child.tag[1]) - 1 :] = [text]
            elif child.tag in ("table", "dl"):
                text = _table_text(child) if child.tag == "table" else _definitions(child)
                if any(c.tag in ("h1", "h2", "h3", "p", "table") for c in child.walk() if c is not child):
                    visit(child)  # a table for the layout
                elif text:
                    parts.append(text)
            elif child.tag in ("p", "li", "h4", "h5", "h6", "pre", "blockquote", ""):
                text = child.content() if child.tag else _SPACE.sub(" ", child.text).strip()
                if text:
                    parts.append(text)
            else:
                visit(child)

    visit(tree)
    if parts:
        out.append((tuple(trail), parts))
    return out


def _size(parts: list[str]) -> int:
    return sum(map(estimated_tokens, parts))


def _pieces(part: str, cap: int) -> list[str]:
    """A part above the cap as sentences packed up to it."""
    if estimated_tokens(part) <= cap:
        return [part]
    out: list[str] = []
    for sentence in re.split(r"(?<=\.) |\n", part):
        if out and estimated_tokens(f"{out[-1]} {sentence}") <= cap:
            out[-1] += f" {sentence}"
        else:
            out.append(sentence)
    return out


def _profiles(node: Node) -> Iterator[Node]:
    """The outermost containers whose class speaks of a profile."""
    for child in node.children:
        if child.tag in PROFILE_TAGS and PROFILE_MARK in child.attrs.get("class", "").lower():
            yield child
        else:
            yield from _profiles(child)


def _names(profile: Node) -> list[str]:
    return [n.content() for n in profile.walk() if n.tag in ("h1", "h2", "h3") and n.content()][:1]


def structural_chunks_of(source: str | None, limits: ChunkLimits = ChunkLimits(), page_type: str | None = None) -> list[tuple[str, int, list[str], int]]:
    """(text, position, heading trail, tokens) of the page's chunks.

    Small sections join the chunk before them while that stays within the limit; sections above
    the cap are split at their parts and, if one part is above it, at sentences.  Pages of type
    ``faculty`` give one chunk for each profile container, if they have any.
    """
    tree = _container(_without(parse(source), DROPPED))
    chunks: list[tuple[tuple[str, ...], list[str]]] = []
    if page_type == "faculty":
        chunks = [(tuple(_names(n)), [n.content()]) for n in _profiles(tree)]
    if not chunks:
        for trail, parts in _structure(tree):
            size = _size(parts)
            if size > limits.cap:
                packed: list[list[str]] = [[]]
                for piece in (x for p in parts for x in _pieces(p, limits.cap)):
                    if packed[-1] and _size(packed[-1]) + estimated_tokens(piece) > limits.most:
                        packed.append([])
                    packed[-1].append(piece)
                chunks += [(trail, p) for p in packed if p]
            elif size < limits.least and chunks and _size(chunks[-1][1]) + size <= limits.most:
                chunks[-1] = (chunks[-1][0], chunks[-1][1] + parts)
            else:
                chunks.append((trail, list(parts)))
    texts = [("\n\n".join(p for p in parts if p.strip()).strip(), list(trail)) for trail, parts in chunks]
    return [(text, k, trail, estimated_tokens(text)) for k, (text, trail) in enumerate((x for x in texts if x[0]))]


@F.pandas_udf(T.StringType())
def html_title_udf(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: None if h is None else title_of(h))


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_udf(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([links_of(h, b) for h, b in zip(pages, bases)])


SECTION = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(SECTION)
def sections_udf(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: [{"heading": a, "text": b} for a, b in sections_of(h)])


CHUNK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("heading_trail", T.ArrayType(T.StringType())), T.StructField("token_count", T.IntegerType())]))


def structural_chunks_udf(limits: ChunkLimits = ChunkLimits()):  # noqa: ANN201
    names = ("text", "position", "heading_trail", "token_count")

    @F.pandas_udf(CHUNK)
    def chunk(pages: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, c)) for c in structural_chunks_of(h, limits, k)] for h, k in zip(pages, kinds)])

    return chunk


def simple_title_col(page: Column) -> Column:
    """Text of the title element by pattern, without leaving the JVM; null where there is none."""
    raw = F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    plain = F.replace(F.replace(F.replace(F.replace(raw, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.when(plain != "", plain)
