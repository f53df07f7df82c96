"""Sentence chunks with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_END = re.compile(r"(?<=[.!?])\s+")


def runs(units: Sequence[str], size: int, overlap: int = -1) -> list[tuple[int, int]]:
    """(start, end) of runs of units that have up to ``size`` characters when joined by a space.

    ``ends[n]`` is where unit n would start if all were joined, so the units a to b have
    ends[b] - ends[a] - 1 characters and both bounds of a run are searched: its end is the last
    that fits (one unit in any case); the next run starts with as many of its last units as have
    up to ``overlap`` characters, and behind its start.
    """
    ends = [0, *accumulate(len(u) + 1 for u in units)]
    out: list[tuple[int, int]] = []
    while not out or out[-1][1] < len(units):
        last = out[-1] if out else (-1, 0)
        start = min(last[1], max(last[0] + 1, bisect_left(ends, ends[last[1]] - 1 - overlap)))
        if start == len(units):
            break
        out.append((start, max(start + 1, bisect_right(ends, ends[start] + size + 1) - 1)))
    return out


def sentence_chunks(text: str | None, size: int = 1400, overlap: int = 250) -> list[str]:
    """Runs of whole sentences of up to ``size`` characters, white space squeezed, each starting
    with the last sentences of the one before, as many as ``overlap`` characters hold.  A longer
    sentence counts as several, runs of its words."""
    units: list[str] = []
    for sentence in _END.split(" ".join((text or "").split())):
        words = sentence.split()
        units += [" ".join(words[a:b]) for a, b in runs(words, size)] if len(sentence) > size else words and [sentence]
    return [" ".join(units[a:b]) for a, b in runs(units, size, overlap)]


def sentence_chunks_udf(size: int = 1400, overlap: int = 250):  # noqa: ANN201
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentence_chunks(t, size, overlap))

    return chunk
