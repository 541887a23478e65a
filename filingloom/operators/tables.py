"""HTML tables as Markdown: spans, merged money columns, fused headers."""

from __future__ import annotations

import re

# What stands for a bullet in a table used as a list.
BULLETS = frozenset("• ● ○ ◦ ▪ ■ □ – — - * · ‣ ➢".split())
FOOTNOTE = re.compile(r"\[[a-zA-Z0-9]+\]")

Cells = list[list[tuple[str, int, int]]]
Grid = list[list[str | None]]


def span(value: str | None) -> int:
    """The digits of an attribute; 1 without any."""
    digits = "".join(c for c in value or "" if c.isdigit())
    return int(digits) if digits else 1


def spread(cells: Cells, most: int = 2000) -> Grid:
    """Cells on a grid as wide as the widest row; what a span covers is its text again, and nothing beyond the grid.

    Spans above ``most`` count as ``most``: a wrong attribute can't exhaust memory.
    """
    width = min(most, max((sum(min(c, most) for _, _, c in row) for row in cells), default=0))
    grid: Grid = [[None] * width for _ in cells]
    taken = [[False] * width for _ in cells]
    for i, row in enumerate(cells):
        col = 0
        for text, down, right in row:
            while col < width and taken[i][col]:
                col += 1
            if col >= width:
                break
            for r in range(i, min(i + max(down, 1), len(cells))):
                for c in range(col, min(col + max(right, 1), width)):
                    if r < i + down and c < col + right or (r, c) == (i, col):
                        taken[r][c] = True
                        grid[r][c] = text if (r, c) == (i, col) else ""
            col += right
    return grid


def _dense(grid: Grid) -> Grid:
    """Without rows and columns that hold no text."""
    rows = [r for r in grid if any(c and c.strip() for c in r)]
    cols = [j for j in range(len(rows[0]) if rows else 0) if any(r[j] and r[j].strip() for r in rows)]
    return [[r[j] for j in cols] for r in rows]


def _joins(left: str | None, right: str | None) -> bool:
    a, b = (left or "").strip(), (right or "").strip()
    return not a or not b or a == "$" or b == "%" or FOOTNOTE.fullmatch(b) is not None


def merge_columns(grid: Grid) -> Grid:
    """Join a column to the one on its left where every pair below the header is a blank, a currency, a per cent or a note.

    The left header stays. A grid of one row becomes one column, as no pair speaks against it.
    """
    columns: list[list[str | None]] = []
    for col in (list(c) for c in zip(*grid)):
        if columns and all(_joins(a, b) for a, b in zip(columns[-1][1:], col[1:])):
            held = columns[-1]
            columns[-1] = held[:1] + [b if a is None else a if b is None else f"{a} {b}".strip() for a, b in zip(held[1:], col[1:])]
        else:
            columns.append(col)
    return [list(r) for r in zip(*columns)]


def matrix(cells: Cells) -> list[list[str]]:
    return [[c or "" for c in row] for row in merge_columns(_dense(spread(cells or [[("", 1, 1)]])))]


def _plain(text: str) -> str:
    return text.replace("\xa0", " ").strip()


def fuse_headers(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """The header and the rest; two header rows become one where the first is mostly blank and the second mostly not."""
    top = [_plain(x) for x in rows[0]]
    if len(rows) == 1:
        return top, []
    low, need = [_plain(x) for x in rows[1]], max(2, len(top) // 2)
    if sum(map(bool, low)) < need or top.count("") < need:
        return top, rows[1:]
    return [" — ".join(x for x in pair if x) for pair in zip(top, low)], rows[2:]


def markdown(cells: Cells) -> str:
    """The table as Markdown; a one-row table of a bullet and a text as a list item; empty without any text."""
    if len(cells) == 1:
        texts = [t.strip() for t, _, _ in cells[0]]
        if any(t in BULLETS for t in texts) and any(texts[1:]):
            last = next((t for t in reversed(texts) if t and t not in BULLETS), "")
            return f"- {last}" if last else ""
    rows = matrix(cells)
    if not rows:
        return ""
    header, data = fuse_headers(rows)
    if data:
        data = [r for r in data if any(_plain(c) for c in r)]
        keep = [j for j in range(len(header)) if any(_plain(r[j]) for r in data)]
        if data:
            header, data = [header[j] for j in keep], [[r[j] for j in keep] for r in data]
    if not header:
        return ""
    lines = [header, ["---"] * len(header), *data]
    return "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in lines)
