"""Problem 4: splitting oversized items at natural boundaries.

Every position of a text gets a boundary strength. A sparse table answers which cut is strongest in each permissible
window of lengths (ties: the rightmost), and the next piece starts up to the overlap before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS = 512, 64
#: Positions indexed at once, so that the table of a text of any length is small; its strengths take a byte a character.
BLOCK = 1 << 18
#: Strength of a cut right after each of these, the strongest first.
BOUNDARIES = [
    (6, re.compile(r"\n[ \t\r]*\n\s*")),
    (5, re.compile(r"\n")),
    (4, re.compile(r"[.!?][\"'”’»)\]]*\s+|[。！？．][」』”’）]*|…\s+")),
    (3, re.compile(r"[;:]\s+|[；：]")),
    (2, re.compile(r",\s+|[，、]|\s[–—]\s")),
    (1, re.compile(r"\s+")),
]


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position of ``text``; 0 inside a word."""
    out = np.zeros(len(text) + 1, np.int8)
    for value, pattern in reversed(BOUNDARIES):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        out[ends] = np.maximum(out[ends], value)
    return out


class RangeMaximum:
    """Sparse table: the rightmost position of the largest value in any range of up to ``longest`` positions."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        key = values.astype(np.int64) * (len(values) + 1) + np.arange(len(values))
        self.size, self.levels, width = len(values), [key], 1
        while 2 * width <= min(longest, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Over lo <= position < hi."""
        k = (hi - lo).bit_length() - 1
        k = min(k, len(self.levels) - 1)
        level = self.levels[k]
        best = max(level[lo], level[hi - (1 << k)])
        return int(best % (self.size + 1))


def split_points(text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most ``max_tokens`` (length div 4), in order, covering the text without a gap.

    A text within the limit, an empty one too, is one piece. A cut lies in the second half of what may be taken, on the
    strongest boundary there; where there is none, the piece is as long as it may be. A piece starts at a boundary
    within the last ``overlap_tokens`` of the one before, at its end where there is no boundary.
    """
    longest, overlap = 4 * max_tokens + 3, 4 * overlap_tokens + 3 if overlap_tokens else 0
    if overlap >= longest // 2:
        raise ValueError("the overlap must be less than half a piece")
    n = len(text)
    if n <= longest:
        return [(0, n)]
    out, start, at, table = [], 0, 0, None
    value = strengths(text)
    while n - start > longest:
        if table is None or start + longest + 1 > at + table.size:
            at = start
            table = RangeMaximum(value[at : at + BLOCK + longest + 1], longest + 1)
        lo, hi = start + longest // 2 + 1, start + longest + 1
        cut = at + table.argmax(lo - at, hi - at)
        if not value[cut]:
            cut = hi - 1
        out.append((start, cut))
        # the earliest of the strongest boundaries in the overlap; word starts at least
        tail = value[cut - overlap : cut] if overlap else value[:0]
        start = cut - overlap + int(tail.argmax()) if tail.size and tail.max() else cut
    out.append((start, n))
    return out


def tokens(text: Column) -> Column:
    """Tokens of a text: its length in code points div 4, 1 at least; null of a null."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def split_oversized(
    df: DataFrame, key: Column, content: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS
) -> DataFrame:
    """(row_key, piece, start_at, end_at, content) of every row above the limit; rows within it are not sent to Python.

    Null contents and keys give no piece, repeated rows each piece once. Offsets count code points, the end exclusive.
    """
    rows = df.select(key.alias("row_key"), content.alias("content")).where(F.col("row_key").isNotNull() & (tokens(F.col("content")) > max_tokens))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, a, b, t[a:b]) for k, t in zip(pdf["row_key"], pdf["content"]) for i, (a, b) in enumerate(split_points(t, max_tokens, overlap_tokens))]
            yield pd.DataFrame(out, columns=["row_key", "piece", "start_at", "end_at", "content"])

    return rows.distinct().mapInPandas(pieces, "row_key string, piece int, start_at int, end_at int, content string")
