"""One walk over a filing's tree: ordered segments by page, with their source, note and facts.

A segment is a dict: text, tag and attributes of its source node, the note (name, title) it stands in and the names of
the facts in it. Page breaks come from styles alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from filingloom.operators import positioned, tables
from filingloom.operators.dom import COMMENT, TEXT, UNSEEN, Tree

# Fixed values.
BLOCKS = frozenset("div p h1 h2 h3 h4 h5 h6 table ul ol li".split())
NOTE_PREFIXES = ("us-gaap:", "cyd:")
FACTS = ("ix:nonfraction", "ix:nonnumeric")
BREAKS = {side: tuple(f"{p}break-{side}:{v}" for p, v in (("page-", "always"), ("", "page"), ("", "always"))) for side in ("before", "after")}
#: Text that is one style declaration.
DECLARATION = re.compile(r"^[a-zA-Z\-]+\s*:\s*[^;]+;\s*$")
LIST_MARKS = "•·∙◦▪▫-"
SPACE = re.compile(r"\s+")


def clean(text: str) -> str:
    return SPACE.sub(" ", text.replace("​", "").replace("﻿", "")).strip()


@dataclass
class Segment:
    text: str
    node: int | None = None
    note: tuple[str, str | None] | None = None


@dataclass
class Page:
    segments: list[Segment] = field(default_factory=list)
    footer: int | None = None


class Renderer:
    """Walks a tree with an explicit stack, so nesting of any depth is fine."""

    def __init__(self, html: str, images: bool = True, comments: bool = True) -> None:
        self.tree, self.images, self.comments = Tree(html), images, comments
        self.pages: dict[int, Page] = {}
        self.page = 1
        self.note: tuple[str, str | None] | None = None
        self.continued: dict[str, tuple[str, str | None] | None] = {}
        self.compact: dict[int, str] = {}
        self._walk()

    # predicates on nodes

    def _compact(self, n: int) -> str:
        if (style := self.compact.get(n)) is None:
            style = self.compact[n] = self.tree.style(n).replace(" ", "")
        return style

    def _mark(self, n: int) -> str:
        style, tag = self.tree.style(n), self.tree.tag[n]
        bold = "font-weight:700" in style or "font-weight:bold" in style or tag in ("b", "strong")
        italic = "font-style:italic" in style or tag in ("i", "em")
        return "**" * bold + "*" * italic

    def _is_placed(self, n: int) -> bool:
        return "position:absolute" in self._compact(n)

    def _note_of(self, n: int) -> int | None:
        """The note's tag at the node, its children or grandchildren."""
        t, level = self.tree, [n]
        for _ in range(3):
            for x in level:
                name = t.attrs[x].get("name", "")
                if t.tag[x] == "ix:nonnumeric" and "TextBlock" in name and name.startswith(NOTE_PREFIXES):
                    return x
            level = [c for x in level for c in t.children[x]]
        return None

    def _note_info(self, n: int) -> tuple[str, str | None]:
        name, text = self.tree.attrs[n]["name"], self.tree.plain(n)
        if text and len(text) < 200:
            return name, text
        return name, re.sub(r"([A-Z])", r" \1", name.split(":", 1)[-1].removesuffix("TextBlock")).strip() or None

    def facts(self, n: int) -> list[str]:
        """Names of the facts below a node, in order of first sight; the node itself is none of them."""
        t = self.tree
        return list(dict.fromkeys(t.attrs[x]["name"] for x in t.descend(n) if t.tag[x] in FACTS and t.attrs[x].get("name")))

    # output

    def _at(self) -> Page:
        return self.pages.setdefault(self.page, Page())

    def _emit(self, text: str, node: int | None) -> None:
        if not text:
            return
        segments = self._at().segments
        if segments and node is not None and segments[-1].node is not None and self.tree.parent[segments[-1].node] == self.tree.parent[node]:
            joined = _join_marks(segments[-1].text, text)
            if joined is not None:
                segments[-1].text = joined
                return
        segments.append(Segment(text, node, self.note))

    def _blank(self) -> None:
        """An empty line, unless the page is empty or has one."""
        held = self.pages.get(self.page)
        if held is None or not held.segments:
            return
        s = held.segments
        if not s[-1].text.endswith("\n"):
            s.append(Segment("\n", None, self.note))
        if not (len(s) > 1 and s[-1].text == s[-2].text == "\n"):
            s.append(Segment("\n", None, self.note))

    # rendering of whole elements

    def _string(self, n: int) -> str:
        if self.tree.tag[n] == COMMENT and not self.comments:
            return ""
        text = clean(self.tree.text[n])
        return "" if DECLARATION.match(text) else text

    def _image(self, n: int) -> str:
        a = self.tree.attrs[n]
        return f"![{a.get('alt', '')}]({a['src']})" if self.images and a.get("src") else ""

    def render(self, node: int) -> str:
        """A node and all below it as Markdown, children before parents."""
        t, done = self.tree, {}
        stack = [(node, False)]
        while stack:
            n, ready = stack.pop()
            tag = t.tag[n]
            if tag in (TEXT, COMMENT):
                done[n] = self._string(n)
            elif tag == "img":
                done[n] = self._image(n)
            elif tag == "table":
                done[n] = self.table(n)
            elif not ready:
                stack.append((n, True))
                stack += [(c, False) for c in t.children[n]]
            elif tag in ("ul", "ol"):
                items = [done[c].strip().lstrip(LIST_MARKS).strip() for c in t.children[n] if t.tag[c] == "li" and done[c].strip()]
                done[n] = "\n".join((f"{i}. " if tag == "ol" else "- ") + x for i, x in enumerate(items, 1))
            else:
                text = " ".join(done[c] for c in t.children[n] if done[c]).strip()
                mark = "" if tag == "li" or not text else self._mark(n)
                done[n] = mark + text + mark
        return done[node]

    def _cells(self, row: int, direct: bool = True) -> list[int]:
        t = self.tree
        own = [c for c in t.children[row] if t.tag[c] in ("td", "th")] if direct else []
        return own or [c for c in t.descend(row) if t.tag[c] in ("td", "th")]

    def table(self, n: int) -> str:
        """Markdown of a table; one with a single row of text is a line of text."""
        t = self.tree
        rows = [r for r in t.descend(n) if t.tag[r] == "tr"]
        full = [texts for r in rows if any(texts := [clean(t.plain(c)) for c in self._cells(r)])]
        if len(full) <= 1:
            return one_row(full[0]) if full else ""
        cells = []
        for r in rows:
            row = []
            for c in self._cells(r, direct=False):
                text = t.plain(c).replace("\xa0", " ") or ("●" if any(t.tag[x] == "img" for x in t.descend(c)) else "")
                row.append((text, tables.span(t.attrs[c].get("rowspan")), tables.span(t.attrs[c].get("colspan"))))
            if row:
                cells.append(row)
        return tables.markdown(cells).strip()

    # positioned containers

    def _box(self, n: int) -> positioned.Box:
        raw, style = self.tree.attrs[n].get("style", ""), self._compact(n)

        def px(pattern: str, text: str) -> float | None:
            m = re.search(pattern + r":\s*(\d+(?:\.\d+)?)px", text)
            return float(m[1]) if m else None

        left, y, low = px("left", raw), px("top", raw), px("bottom", style)
        bare = self.tree.plain(n)
        width = re.search(r"width:(\d+)px", style)
        blank = not bare.replace("\xa0", "").strip() or any("\xa0" in self.tree.text[x] for x in self.tree.descend(n))
        spacer = "display:inline-block" in style and blank and width is not None and int(width[1]) < 30
        both = left is not None and y is not None
        top = px("top", style)
        return positioned.Box(
            left if both else None, y if both else None, top if top is not None else 10000 - low if low is not None else None, clean(bare), "font-weight:700" in self.tree.style(n) or "font-weight:bold" in self.tree.style(n), spacer, n
        )

    def _is_footer(self, n: int) -> bool:
        style, text = self._compact(n), self.tree.plain(n).lower()
        if "position:absolute" not in style or "bottom:0" not in style:
            return False
        return "width:100%" in style or 0 < len(text) < 200 and any(k in text for k in ("form 10-k", "form 10-q", "form 8-k", "page"))

    def _container(self, n: int) -> bool:
        """Positioned children as tables and text; false where there is none with content."""
        boxes = [b for c in self.tree.children[n] if self.tree.tag[c] not in (TEXT, COMMENT) and self._is_placed(c) and ((b := self._box(c)).text or b.spacer)]
        if not boxes:
            return False
        footers = [b for b in boxes if self._is_footer(b.node)]
        for b in footers:
            number = footer_number(self.tree.plain(b.node))
            if number is not None:
                self._at().footer = number
        for i, group in enumerate(positioned.split_groups([b for b in boxes if b not in footers])):
            layout = positioned.Layout(group)
            if layout.is_table():
                self._emit(layout.markdown(), group[0].node)
                self._blank()
            elif text := layout.text():
                if i:
                    self._blank()
                self._emit(text, group[0].node)
        return True

    # the walk

    def _walk(self) -> None:
        t = self.tree
        stack: list[tuple] = [(c, None) for c in t.children[0][::-1]]
        if any(b in self._compact(0) for b in BREAKS["before"]):
            self.page += 1
        while stack:
            n, leave = stack.pop()
            if leave is not None:
                self._leave(n, *leave)
                continue
            tag = t.tag[n]
            if tag in (TEXT, COMMENT):
                if text := self._string(n):
                    self._emit(text + " ", t.parent[n] if t.parent[n] else None)
                continue
            if t.is_unseen(n):
                continue
            style = self._compact(n)
            if any(b in style for b in BREAKS["before"]):
                self.page += 1
            if "display:none" in style:
                continue
            if tag == "img" and self.images:
                if image := self._image(n):
                    self._blank()
                    self._emit(image, n)
                    self._blank()
                continue
            before, restore = self.note, False
            after: tuple[str, str | None] | None = before
            if tag == "ix:continuation" and t.attrs[n].get("id") in self.continued:
                self.note = self.continued[t.attrs[n]["id"]]
                if goes_on := t.attrs[n].get("continuedat"):
                    self.continued[goes_on] = self.note
                else:
                    restore, after = True, None
            placed = "position:absolute" in style
            if tag == "div" and not placed and any(t.tag[c] not in (TEXT, COMMENT) and self._is_placed(c) for c in t.children[n]) and self._container(n):
                self._leave(n, False, restore, after)
                continue
            inline = "display:inline-block" in style or "display:inline;" in style
            block = tag in BLOCKS and not inline and not placed
            if block and (at := self._note_of(n)) is not None:
                info = self._note_info(at)
                if self.note is None or self.note[0] != info[0]:
                    self.note = info
                    if goes_on := t.attrs[at].get("continuedat"):
                        self.continued[goes_on] = info
                        restore = False
                    else:
                        restore, after = True, before
            if block:
                self._blank()
            if tag in ("table", "ul", "ol"):
                self._emit(self.render(n), n)
                self._blank()
                self._leave(n, False, restore, after)
            elif self._mark(n) and not block:
                if text := self.render(n):
                    self._emit(text + " ", n)
                self._leave(n, False, restore, after)
            else:
                stack.append((n, (block, restore, after)))
                stack += [(c, None) for c in t.children[n][::-1]]

    def _leave(self, n: int, block: bool, restore: bool, note: tuple | None) -> None:
        if block:
            self._blank()
        if any(b in self._compact(n) for b in BREAKS["after"]):
            self.page += 1
        if restore:
            self.note = note


def table_markdown(html: str) -> str:
    """Markdown of a document that is one table; anything else raises ValueError."""
    r = Renderer(html)
    top = [n for n in r.tree.children[0] if r.tree.tag[n] not in (TEXT, COMMENT)]
    if [r.tree.tag[n] for n in top] != ["table"]:
        raise ValueError("not a table")
    return r.table(top[0])


def _join_marks(left: str, right: str) -> str | None:
    """Two spans of the same emphasis as one; None if they aren't."""
    a, b = left.rstrip(), right.lstrip()
    for mark in ("**", "*"):
        if a.endswith(mark) and b.startswith(mark) and (mark == "**" or not a.endswith("**")):
            return a[: -len(mark)] + left[len(a) :] + right[: len(right) - len(b)] + b[len(mark) :]
    return None


def one_row(texts: list[str]) -> str:
    """A table of one row: a heading where its first cell is one, else its texts."""
    if m := re.match(r"^Item\s+(\d{1,2}[A-Z]?)\.?$", texts[0], re.I):
        return f"ITEM {m[1].upper()}. {next((t for t in texts[1:] if t), '')}".strip()
    if m := re.match(r"^Part\s+([IVXLC]+)$", texts[0], re.I):
        return f"PART {m[1].upper()}"
    return " ".join(t for t in texts if t).strip()


# The forms of page numbers in footers, with the least number of each, and of a bare heading at the top.
FOOTERS = ((r"\|\s*(\d{1,4})\s*$", 1), (r"(?i)\bPage\s+(\d{1,4})\b", 1), (r"\b(\d{1,4})\s*$", 10))
BREADCRUMBS = re.compile(
    r"\A\s*(?:\*\*|__)?[^\S\n]*PART[^\S\n]+[IVXLC]+[^\S\n]*(?:\*\*|__)?[^\S\n]*\n\s*(?:\*\*|__)?[^\S\n]*ITEM[^\S\n]+\d{1,2}[A-Z]?(?:[^\S\n]*,[^\S\n]*\d{1,2}[A-Z]?)*[^\S\n]*(?:\*\*|__)?[^\S\n]*(?:\n\s*|\Z)", re.I
)


def plausible(n: int, least: int = 1) -> bool:
    return least <= n <= 9999 and not 1900 <= n <= 2100


def footer_number(text: str) -> int | None:
    """The page number in a footer."""
    for pattern, least in FOOTERS:
        if (m := re.search(pattern, text)) and plausible(int(m[1]), least):
            return int(m[1])
    return None


def content_of(segments: list[Segment]) -> str:
    """A page's text: lines trimmed, no more than one blank line in a row, bare headings at the top dropped."""
    lines: list[str] = []
    for line in "".join(s.text for s in segments).split("\n"):
        line = line.strip()
        if line or lines and lines[-1]:
            lines.append(line)
    return without_breadcrumbs("\n".join(lines).strip()).strip()


def without_breadcrumbs(content: str) -> str:
    """Without a bare PART line that a bare ITEM line follows, at the very top."""
    return BREADCRUMBS.sub("", content, count=1)
