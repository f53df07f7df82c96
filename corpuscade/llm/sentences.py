"""Sentence boundaries in many languages by a pushdown automaton over the marks of a line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by what may follow them.  Lower case, without the closing period.
#: never end a sentence: titles and connectors that stand before a name or word
TITLES = "mr mrs ms messrs dr dra drs prof profs rev hon st ste sr sra srta jr sen gov gen col capt lt sgt hr hrn fr frl dipl ing mme mlle mm me mgr vs bzw bspw evtl sog vgl ggf inkl exkl d.h z.b u.a e.g i.e cf viz p.ej p.ex g.-n डॉ श्री श्रीमती प्रो डा им ул г-н г-жа проф акад"
#: end none where a number or reference follows
NUMBERED = "no nos nr nrs art arts fig figs abb tab pp p sec secs ch chap vol approx ca env cap págs pág núm num n s bd kap para pt eq ed стр рис табл гл см"
#: may end one: what follows decides
CLOSING = "etc usw al a.m p.m ph.d m.d b.a m.a b.sc m.sc u.s u.k u.n u.s.a e.u inc ltd co corp bc ad a.c d.c ff и.т.д др пр г гг т.д т.п ет"
#: months and nouns that follow a German ordinal
ORDINAL_NOUNS = "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jahrtausend jahrestag semester stock klasse kapitel auflage band woche tag mal platz"

OPEN_CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "“": "”", "„": "“", "‘": "’", "‚": "‘", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉"}
BRACKETS = frozenset("([{（［【〔")
CLOSERS = frozenset(OPEN_CLOSE.values()) | {'"'}
FULL_STOPS = "。！？｡．।॥؟۔"
TERMINALS = ".!?…" + FULL_STOPS

LINE_BREAK = re.compile("\r\n|[\n\r\v\f\x1c\x1d\x1e\x85  ]")
MARKER = re.compile(r"\s*(?:([-–—*•‣◦▪·●○■□➢✓])|\(?(\d{1,3}(?:\.\d{1,3})*)[.)]|\(?([a-z])\)|\(?([ivx]{1,4})\))\s+")
EVENT = re.compile("[" + re.escape(TERMINALS) + re.escape("".join({*OPEN_CLOSE, *CLOSERS})) + '"]|(?<=[ก-๛])[ \xa0　\t]+(?=[^\\s\\d])')
_ABSORB = re.compile("[" + re.escape(TERMINALS) + "]*[" + re.escape("".join(CLOSERS - {"“", "‘"})) + "]*")
_WORD_BACK = re.compile(r"[^\s(\[{«“„‘\"'¿¡（「『/]*$")


class Trie:
    """Abbreviations read backwards from their period."""

    def __init__(self, **kinds: str) -> None:
        self.root: dict = {}
        for kind, words in kinds.items():
            for word in words.split():
                node = self.root
                for ch in reversed(word):
                    node = node.setdefault(ch, {})
                node.setdefault("", kind)

    def kind(self, text: str, start: int, end: int) -> str | None:
        """Kind of the abbreviation that fills ``text[start:end]`` (without case), if it is one."""
        node = self.root
        for k in range(end - 1, start - 1, -1):
            node = node.get(text[k].lower())
            if node is None:
                return None
        return node.get("")


ABBREVIATIONS = Trie(title=TITLES, number=NUMBERED, closing=CLOSING)
_ORDINALS = frozenset(ORDINAL_NOUNS.split())
_NEXT_WORD = re.compile(r"[^\W\d_]+")


def _continues(text: str, at: int, end: int) -> bool:
    """A plain lower-case word follows; ``pH`` or ``iPad`` count as capitalised."""
    ch = text[at]
    return ch.islower() and not (at + 1 < end and text[at + 1].isupper())


def _period_ends(text: str, first: int, dot: int, at: int, end: int) -> bool:
    """Does the single period at ``dot`` end a sentence, where the next word starts at ``at``?"""
    if at == dot + 1:  # nothing between: decimals, addresses, dotted abbreviations
        return False
    if _continues(text, at, end):
        return False
    start = _WORD_BACK.search(text, first, dot).start()
    while start < dot and not text[start].isalnum():
        start += 1
    size = dot - start
    if size == 0:
        return True
    kind = ABBREVIATIONS.kind(text, start, dot)
    if kind == "title":
        return False
    if kind == "number":
        return not (text[at].isdigit() or text[at] in "§#(" or (size == 1 and text[start].isupper()))
    if kind == "closing":
        return not text[at] in ",;:"
    if size == 1 and text[start].isalpha():
        return False  # an initial, or a letter of a spaced abbreviation
    if size <= 2 and text[start:dot].isdigit():
        word = _NEXT_WORD.match(text, at)
        return not (word and word.group().lower() in _ORDINALS)
    return True


def enter_item(levels: list[tuple[int, str]], indent: int, kind: str) -> None:
    """Move the open list levels (indentation, kind of mark) to an item: close the deeper ones,
    those of another kind beside it if one of its kind is open, and open one if none is."""
    while levels and levels[-1][0] > indent:
        levels.pop()
    if (indent, kind) in levels:
        while levels[-1] != (indent, kind):
            levels.pop()
    else:
        levels.append((indent, kind))


def item_body(text: str, line: int, first: int, end: int, levels: list[tuple[int, str]]) -> int:
    """Where the text of a line begins behind its list marks, of which several may stand in a
    row (``1. a) text``); each enters its list level.  A line without mark closes the lists it
    isn't indented into."""
    at, marked = first, False
    while (mark := MARKER.match(text, at, end)) and mark.end() < end:
        kind = mark.lastindex or 0
        shown = mark.group(kind)
        start = mark.start(kind)
        enter_item(levels, start - line, shown if kind == 1 else "(" * (text[start - 1 : start] == "(") + f"{kind}.{shown.count('.')}{text[mark.end(kind)]}")
        at, marked = mark.end(), True
    if not marked:
        while levels and levels[-1][0] >= first - line:
            levels.pop()
    return at


def split_line(text: str, first: int, end: int, out: list[tuple[int, int]], begin: int | None = None) -> None:
    """Append the sentences of ``text[first:end]``, a line without outer white space, whose text
    begins at ``begin`` behind list marks.

    The automaton's stack holds open quotations and brackets, above the list levels of the line.
    An opener without its closer on the line isn't pushed, so a stray mark can't swallow what
    follows.  A terminal inside a quotation ends nothing until the quotation closes; what stands
    next then decides.
    """
    begin = item_body(text, first, first, end, []) if begin is None else begin
    waiting: dict[str, int] = {}  # closers of what is on the stack
    behind: dict[str, int] = {}  # last place of a closer on the line

    def closes(mark: str, at: int) -> bool:
        if mark not in behind:
            behind[mark] = text.rfind(mark, first, end)
        return behind[mark] >= at

    stack: list[tuple[str, int]] = []
    start, body, pos, ended_at = first, begin, begin, -1
    search = EVENT.search
    while True:
        event = search(text, pos, end)
        if event is None:
            break
        at = event.start()
        ch = text[at]
        pos = at + 1
        cut = -1
        if ch in TERMINALS:
            run = at + 1
            while run < end and text[run] in TERMINALS:
                run += 1
            ended_at = pos = run
            if stack:
                continue
            pos = run = _ABSORB.match(text, run, end).end()
            if run >= end:
                break
            nxt = run
            while nxt < end and text[nxt].isspace():
                nxt += 1
            last = text[run - 1] if text[run - 1] in TERMINALS else text[ended_at - 1]
            if last in FULL_STOPS:
                cut = run
            elif nxt >= end:
                break
            elif ch == "." and ended_at == at + 1:
                if run > ended_at or _period_ends(text, start, at, nxt, end):
                    cut = run if run == ended_at or not _continues(text, nxt, end) else -1
            elif nxt > run or not (text[nxt].isalnum() or text[nxt] in ",;:/&=%-_"):
                cut = -1 if _continues(text, nxt, end) or text[nxt] in ",;:" else run
            elif ch != "." and text[nxt].isalpha() and not text[nxt].isascii() and text[nxt].upper() == text[nxt].lower():
                cut = run
        elif ch in " \xa0　\t":
            if not stack:
                cut = at
        elif stack and (ch == stack[-1][0] or waiting.get(ch) and ch != '"'):
            closed, opened = "", -1
            while closed != ch:
                closed, opened = stack.pop()
                waiting[closed] -= 1
            while pos < end and not stack and text[pos] in CLOSERS and text[pos] not in "“‘\"":
                pos += 1
            before = at
            while before > start and text[before - 1].isspace():
                before -= 1
            if stack or ended_at != before or before == start:
                if not stack and ended_at == before:
                    ended_at = pos
                continue
            ended_at = pos
            nxt = pos
            while nxt < end and text[nxt].isspace():
                nxt += 1
            if nxt >= end:
                break
            follower, whole = text[nxt], opened == body
            if text[opened] in BRACKETS:
                cut = pos if whole and nxt > pos and follower.isupper() else -1
            elif follower in TERMINALS or follower in ",;:—–-)]}，、；：）" or _continues(text, nxt, end):
                cut = -1
            elif follower.isalpha() and follower.upper() == follower.lower() or follower.isdigit():
                cut = -1 if whole else pos
            else:
                cut = pos
        elif ch == '"':
            if closes('"', pos):
                stack.append(('"', at))
                waiting['"'] = waiting.get('"', 0) + 1
        elif ch in OPEN_CLOSE and (ch not in "“‘" or not stack or stack[-1][0] != ch):
            closer = OPEN_CLOSE[ch]
            if closes(closer, pos):
                stack.append((closer, at))
                waiting[closer] = waiting.get(closer, 0) + 1
        if cut >= 0:
            stop = cut
            while stop > start and text[stop - 1].isspace():
                stop -= 1
            if stop > start:
                out.append((start, stop))
            start = cut
            while start < end and text[start].isspace():
                start += 1
            pos, body, ended_at = start, start, -1
            stack.clear()
            waiting.clear()
    if start < end:
        out.append((start, end))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Offsets (start, end) of all sentences of a text, in code points."""
    out: list[tuple[int, int]] = []
    levels: list[tuple[int, str]] = []
    start, size = 0, len(text)
    while start <= size:
        brk = LINE_BREAK.search(text, start)
        stop = brk.start() if brk else size
        a, b = start, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            split_line(text, a, b, out, item_body(text, start, a, b, levels))
        if brk is None:
            break
        start = brk.end()
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id, sent_start, sent_end`` (and ``sentence``): a row per sentence of each text.

    Offsets count code points from 0, the end is exclusive, outer white space is left out.  Null
    and blank texts have no rows; a null id is kept; repeated rows give repeated sentences.
    Other columns are ignored.  Each text is read once and whole, in the task that scans it.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, sent_start int, sent_end int" + (", sentence string" if with_text else "")
    names = [id_col, "sent_start", "sent_end", "sentence"][: 4 if with_text else 3]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts, ends, texts = [], [], [], []
            for text in batch.column(1).to_pylist():
                spans = sentence_spans(text) if text else []
                counts.append(len(spans))
                for a, b in spans:
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        texts.append(text[a:b])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *([pa.array(texts, pa.string())] if with_text else [])], names)

    return docs.select(id_col, text_col).mapInArrow(rows, schema)
