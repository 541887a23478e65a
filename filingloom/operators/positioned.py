"""Pseudo-tables made of absolutely positioned boxes: grouping, detection, grid and running text."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from statistics import median as _median

# Fixed value: a cell that is one number.
NUMBER = re.compile(r"^\s*\(?\s*[-—–]?\s*[$€£¥]?\s*\d+(?:,\d{3})*(?:\.\d+)?\s*%?\s*\)?\s*$")


@dataclass
class Box:
    """One positioned element; ``x`` and ``y`` are None where the style gives none."""

    x: float | None
    y: float | None
    top: float | None
    text: str
    bold: bool = False
    spacer: bool = False
    node: int = -1


def median(values: list[float]) -> float:
    return float(_median(values)) if values else 0.0


def clusters(values: list[float], eps: float) -> dict[float, int]:
    """Number of the cluster of each value: a new one begins further than ``eps`` from the first of the current one."""
    out: dict[float, int] = {}
    first, n = None, -1
    for v in sorted(set(values)):
        if first is None or v - first > eps:
            first, n = v, n + 1
        out[v] = n
    return out


def split_groups(boxes: list[Box]) -> list[list[Box]]:
    """Vertical groups: a gap of more than 1.2 times the median line gap, 30 at most, begins another.

    Boxes without a height are left out, unless all are; columns that end in running text are cut off once.
    """
    placed = sorted((b for b in boxes if b.top is not None), key=lambda b: b.top)
    if not placed:
        return [boxes] if boxes else []
    gaps = [d for a, b in zip(placed, placed[1:]) if 5 < (d := b.top - a.top) < 100]
    limit = min(1.2 * median(gaps), 30.0) if gaps else 30.0
    groups = _runs(placed, lambda _, last, b: b.top - last.top > limit)
    return [part for g in groups for part in _split_columns(g)]


#: Widths of rows, one letter each: a row of several columns after which at least two of three are of one column.
RUNNING_TEXT = re.compile("w(?=n(?:n.|.n))")


def _runs(boxes: list[Box], ends) -> list[list[Box]]:
    """Boxes in order, cut where ``ends`` says of a run's first and last box and the next that the run is over."""

    def step(runs: list[list[Box]], b: Box) -> list[list[Box]]:
        if runs and not ends(runs[-1][0], runs[-1][-1], b):
            runs[-1].append(b)
        else:
            runs.append([b])
        return runs

    return reduce(step, boxes, [])


def _split_columns(group: list[Box]) -> list[list[Box]]:
    """A group whose columns end in running text, as columns and text; any other whole."""
    placed = sorted((b for b in group if b.x is not None and b.top is not None), key=lambda b: b.top)
    if len(group) < 6:
        return [group]
    rows = _runs(placed, lambda first, _, b: b.top - first.top > 15)
    widths = "".join("w" if len({b.x for b in r}) > 1 else "n" for r in rows)
    if (m := RUNNING_TEXT.search(widths)) is None:
        return [group]
    cut = rows[m.end()][0].top
    return [part for _, g in groupby(placed, key=lambda b: b.top >= cut) if (part := list(g))]


class Layout:
    """A group of boxes, as a table if it looks like one, else as text."""

    def __init__(self, boxes: list[Box]) -> None:
        self.boxes = [b for b in boxes if b.x is not None and b.y is not None and (b.spacer or b.text)]

    def table_boxes(self) -> list[Box]:
        """Without what stands more than 30 above the first row of three boxes; all if too few were left."""
        if len(self.boxes) < 10:
            return self.boxes
        row_of = clusters([b.y for b in self.boxes], 15)
        rows = defaultdict(list)
        for b in self.boxes:
            rows[row_of[b.y]].append(b.y)
        start = next((min(ys) for _, ys in sorted(rows.items()) if len(ys) >= 3), None)
        kept = self.boxes if start is None else [b for b in self.boxes if b.y >= start - 30]
        return kept if len(kept) >= 6 else self.boxes

    def is_table(self) -> bool:
        boxes = self.table_boxes()
        n = len(boxes)
        if n < 6:
            return False
        rows, cols = clusters([b.y for b in boxes], 12), clusters([b.x for b in boxes], 50)
        height, width = len(set(rows.values())), len(set(cols.values()))
        number = {id(b): not b.spacer and NUMBER.search(b.text) is not None for b in boxes}
        columns = defaultdict(list)
        for b in boxes:
            columns[cols[b.x]].append(number[id(b)])
        return (
            height >= 2
            and width >= 2
            and sum(number.values()) >= 0.20 * n
            and sum(len(b.text) for b in boxes) <= 50 * n
            and sum("." in b.text and len(b.text) > 20 for b in boxes) <= 0.40 * n
            and n >= 0.25 * height * width
            and n >= 2 * height
            and any(len(c) >= 2 and sum(c) > 0.5 * len(c) for c in columns.values())
        )

    @staticmethod
    def _line(boxes: list[Box]) -> str:
        parts: list[str] = []
        for b in sorted(boxes, key=lambda b: b.x):
            if b.spacer:
                parts += [" "] if parts else []
            elif b.text:
                parts.append(f"**{b.text}**" if b.bold else b.text)
        return "".join(parts)

    def grid(self) -> list[list[str]]:
        boxes = self.table_boxes()
        rows, cols = clusters([b.y for b in boxes], 12), clusters([b.x for b in boxes], 50)
        held = defaultdict(list)
        for b in boxes:
            held[rows[b.y], cols[b.x]].append(b)
        return [[self._line(held[r, c]) for c in range(max(cols.values()) + 1)] for r in range(max(rows.values()) + 1)]

    def markdown(self) -> str:
        """The grid with its first row as header, without junk rows and empty columns; empty if it is no table."""
        if not self.is_table():
            return ""
        rows = [[c.replace("|", "\\|") for c in r] for r in self.grid()]
        kept = rows[:1] + [r for r in rows[1:] if not _junk([c.strip() for c in r])]
        if len(kept) >= 2:
            cols = [j for j in range(len(rows[0])) if any(r[j].strip() for r in kept)]
            if cols:
                rows = [[r[j].strip() for j in cols] for r in kept]
        lines = [rows[0], ["---"] * len(rows[0]), *rows[1:]]
        return "\n".join("| " + " | ".join(r) + " |" for r in lines)

    def text(self) -> str:
        """Lines from top to bottom; words cut by a hyphen and lines that go on are joined, bold lines stand apart."""
        boxes = sorted(self.boxes, key=lambda b: (b.y, b.x))
        rows = _runs(boxes, lambda _, last, b: abs(b.y - last.y) > 5)
        usual = median([d for a, b in zip(boxes, boxes[1:]) if (d := b.y - a.y) > 1]) if len(boxes) > 1 else 15.0
        tops = [min(r, key=lambda b: b.x).y for r in rows]
        near = [False, *(abs(b - a) < 1.4 * usual for a, b in zip(tops, tops[1:]))]
        heads = [all(b.bold for b in words) if (words := [b for b in r if not b.spacer and b.text]) else False for r in rows]
        lines = [(line, head, close) for r, head, close in zip(rows, heads, near) if (line := self._line(r))]
        return "".join(reduce(_glued, lines, []))


# Fixed value: what ends a line that doesn't go on.
STOPS = (".", "!", "?", ":", ";", ")", "]")


def _glued(done: list[str], line: tuple[str, bool, bool]) -> list[str]:
    """Texts and what stands between them, with one more line: (text, wholly bold, close to the row above)."""
    text, head, close = line
    if not done:
        return [text]
    before = done[-1]
    if before.endswith("-"):
        return [*done[:-1], before[:-1] + text if text[0].islower() else f"{before} {text}"]
    if head and len(text) < 80:
        return [*done, "\n\n", text]
    if close and not before.rstrip().endswith(STOPS):
        return [*done[:-1], f"{before} {text}"]
    return [*done, "\n", text]


def _junk(row: list[str]) -> bool:
    full = [c for c in row if c and c != "---"]
    return not full or len(full) == 1 and not 5 <= len(full[0]) <= 100 or re.match(r"\([a-z]\)", next(c for c in row if c)) is not None
