"""A tree for malformed HTML, built on the standard library's tokenizer.

Nodes are rows of parallel lists, so a document is a few flat lists and any walk is a loop.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Elements without content, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
UNSEEN = frozenset(("script", "style", "template"))
TEXT, COMMENT = "#text", "#comment"


class Tree(HTMLParser):
    """Lists by node number: ``tag``, ``attrs``, ``parent``, ``children``, ``text`` (of text nodes). Node 0 is the root."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.children, self.text = ["#root"], [{}], [-1], [[]], [""]
        self.open = [0]
        self.in_head = self.seen_head = False
        self.head: set[int] = set()  # nodes of the document's head
        self.feed(html)
        self.close()

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted, as nothing asks for positions."""
        return j

    def add(self, tag: str, attrs: dict, text: str = "") -> int:
        node, parent = len(self.tag), self.open[-1]
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.children.append([])
        self.text.append(text)
        self.children[parent].append(node)
        if self.in_head or parent in self.head:
            self.head.add(node)
        return node

    def end_open(self, tags: tuple[str, ...] | frozenset, stops: tuple[str, ...] = ()) -> None:
        """Close the nearest open element of ``tags`` and all within, unless one of ``stops`` comes first."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in tags:
                del self.open[at:]
                return
            if tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            self.in_head = False
            if attrs and tag == "body":
                self.attrs[0].update({k: v or "" for k, v in attrs})
            return
        if tag == "head":
            self.in_head = not self.seen_head
            self.seen_head = True
            return
        if self.in_head and tag not in ("title", "meta", "link", "script", "style", "base", "noscript"):
            self.in_head = False
        if tag in CLOSES_P:
            self.end_open(("p",), ("td", "th", "table", "li", "div", "button"))
        if tag in ENDS:
            for _ in range(2 if tag in ("tr", "tbody", "tfoot") else 1):
                self.end_open(ENDS[tag], STOPS.get(tag, ()))
        node = self.add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag.startswith("ix:") and len(self.open) >= depth:
            self.end_open((tag,))

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        elif tag not in ("html", "body") and tag not in VOID:
            self.end_open((tag,), ("table",) if tag not in ("table", "div") else ())

    def handle_data(self, data: str) -> None:
        if self.in_head and not data.strip():
            return
        if len(self.open) == 1:
            self.in_head = False
        self.add(TEXT, {}, data)

    def handle_comment(self, data: str) -> None:
        self.add(COMMENT, {}, data)

    def is_unseen(self, node: int) -> bool:
        """In a head element that slipped in, or one whose text isn't read."""
        return node in self.head or self.tag[node] in ("title", "meta", "link", "base")

    def descend(self, node: int):
        """Nodes below, in document order."""
        stack = self.children[node][::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += self.children[n][::-1]

    def plain(self, node: int) -> str:
        """The stripped texts below, joined by a blank, without comments, scripts and styles."""
        if self.tag[node] == TEXT:
            return self.text[node].strip()
        parts = (self.text[n].strip() for n in self.descend(node) if self.tag[n] == TEXT and self.tag[self.parent[n]] not in UNSEEN)
        return " ".join(p for p in parts if p)

    def style(self, node: int) -> str:
        return self.attrs[node].get("style", "").lower()
