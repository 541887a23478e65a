"""Blocks and retrieval chunks: token-budgeted packing with overlap, whole tables with their context, one pass per key.

Packing depends on the previous cut, so it runs in Python, a key (a filing or a section) at a time; blocks before it and
all properties of chunks after it are columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from filingloom.functions.text import embedding_text, minify_table, stripped, tokens

SIZE, OVERLAP, MAX_TABLE, CONTEXT, CONTEXT_TEXTS = 512, 128, 2048, 128, 2
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


@dataclass
class Block:
    kind: str
    content: str
    page: int
    ids: list[str] = field(default_factory=list)

    @property
    def tokens(self) -> int:
        return estimate(self.content)

    def sentences(self) -> list[str]:
        return [s.strip() for s in SENTENCE.split(self.content) if s.strip()]


def split_table(content: str, limit: int = MAX_TABLE) -> list[str]:
    """Parts of a table within the limit, each with the header and ``...`` rows where it is cut.

    A table within the limit, or of no rows, is one part; so is a row that alone is above it.
    """
    lines = [x for x in content.split("\n") if x.strip()]
    if not limit or estimate(content) <= limit or len(lines) <= 2:
        return [content]
    head, rows = lines[:2], lines[2:]
    dots = "|" + "|".join(["..."] * max(1, sum(bool(c.strip()) for c in head[0].split("|")))) + "|"
    parts, at = [], 0
    while at < len(rows):
        start = head + [dots] * (at > 0)
        length = sum(len(x) + 1 for x in start) - 1
        end = at
        while end < len(rows):
            length += len(rows[end]) + 1
            last = end + 1 == len(rows)
            if max(1, (length + (0 if last else len(dots) + 1)) // 4) > limit and end > at:
                break
            end += 1
            if max(1, (length + (0 if last else len(dots) + 1)) // 4) > limit:
                break
        parts.append("\n".join(start + rows[at:end] + [dots] * (end < len(rows))))
        at = end
    return parts


def minified(content: str) -> str:
    """As :func:`filingloom.functions.text.minify_table`."""
    out = []
    for i, line in enumerate(content.split("\n")):
        if line.strip():
            parts = [re.sub(r"\s+", " ", p.strip()) for p in line.split("|")]
            out.append("|" + "|".join(["---"] * (len(parts) - 1)) + "|" if i == 1 else "|".join(parts))
    return "\n".join(out)


class Packer:
    """Packs the blocks of one key."""

    def __init__(self, blocks: list[Block], size: int = SIZE, overlap: int = OVERLAP) -> None:
        self.blocks, self.size, self.overlap = blocks, size, overlap
        self.done: list[list[Block]] = []
        self.open: list[Block] = []
        self.load = 0
        for i, b in enumerate(blocks):
            {"Text": self._text, "Table": self._table}.get(b.kind, self._header)(b, i)
        if self.open:
            self.done.append(self.open)

    def _put(self, *blocks: Block) -> None:
        self.open += blocks
        self.load += sum(b.tokens for b in blocks)

    def _cut(self) -> None:
        """Close the chunk; the end of it that fits into the overlap begins the next.

        Parity: a text whose sentences all fit is counted, but only one that fits in part is carried; if everything fits,
        nothing is.
        """
        self.done.append(self.open)
        carried: list[Block] = []
        load = 0
        for b in reversed(self.open) if self.overlap else ():
            if b.kind != "Text":
                if load + b.tokens > self.overlap:
                    break
                carried.insert(0, b)
                load += b.tokens
                continue
            kept: list[str] = []
            full = False
            for s in reversed(b.sentences()):
                if load + estimate(s) > self.overlap:
                    full = True
                    break
                kept.insert(0, s)
                load += estimate(s)
            if full:
                if kept:
                    carried.insert(0, Block("Text", " ".join(kept), b.page, b.ids))
                break
        else:
            carried, load = [], 0
        self.open, self.load = carried, load

    def _text(self, b: Block, i: int) -> None:
        held: list[str] = []
        load = 0

        def put() -> None:
            if held:
                self.open.append(Block("Text", " ".join(held), b.page, b.ids))

        for s in b.sentences():
            n = estimate(s)
            if self.load + load + n > self.size:
                put()
                self.load += load
                if self.open:
                    self._cut()
                held, load = [s], n
            else:
                held.append(s)
                load += n
        put()
        self.load += load

    def _context(self, i: int) -> list[Block]:
        """Short blocks before a table on its page: up to two texts, and the nearest header, which ends the search."""
        out: list[Block] = []
        load = texts = 0
        for b in reversed(self.blocks[:i]):
            if b.page != self.blocks[i].page:
                break
            if b.kind == "Table" or b.kind == "Text" and not b.content.strip():
                continue
            texts += b.kind == "Text"
            if texts > CONTEXT_TEXTS or load + b.tokens > CONTEXT:
                break
            out.insert(0, b)
            load += b.tokens
            if b.kind == "Header":
                break
        return out

    def _table(self, b: Block, i: int) -> None:
        context = self._context(i)
        if self.open[: len(context)] == context:
            context = []
        if self.load + sum(x.tokens for x in context) + b.tokens > self.size:
            if self.open:
                self._cut()
            if context and self.done and self.done[-1] == context:
                self.done.pop()
            self.open, self.load = [], 0
        self._put(*context, b)

    def _header(self, b: Block, i: int) -> None:
        stays = i + 1 < len(self.blocks) and self.blocks[i + 1].kind == "Table" and self.load < self.overlap
        if self.open and not stays and self.load + b.tokens > self.size:
            self._cut()
        self._put(b)


def text_blocks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, block_type, page, content) from the lines of pages: ``#`` a header, with a pipe a table, else text.

    A run of table lines is one block, on the page of the line that ends it.
    """
    lines = pages.select(*keys, "number", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    order = W.partitionBy(*keys).orderBy("number", "line_no")
    kind = F.when(F.col("line").startswith("#"), "Header").when(F.col("line").contains("|"), "Table").otherwise("Text")
    marked = lines.withColumn("block_type", kind)
    new = (F.col("block_type") != "Table") | (F.coalesce(F.lag("block_type").over(order), F.lit("")) != "Table")
    runs = marked.withColumns({"seq": F.sum(new.cast("int")).over(order), "after": F.lead("number").over(order)})
    listed = F.transform(F.sort_array(F.collect_list(F.struct("number", "line_no", "line"))), lambda x: x["line"])
    page = F.when(F.col("block_type") == "Table", F.max(F.coalesce("after", "number"))).otherwise(F.max("number"))
    text = F.array_join(listed, "\n")
    table = minify_table(F.concat(text, F.lit("\n")))
    grouped = runs.groupBy(*keys, "seq", "block_type").agg(page.alias("page"), F.when(F.col("block_type") == "Table", table).otherwise(text).alias("content"))
    return grouped.withColumn("element_ids", F.array().cast("array<string>"))


def blocks_of(text: str, page: int = 0) -> list[Block]:
    """The blocks of one text, as :func:`text_blocks` makes them of one page."""
    out: list[Block] = []
    for line in text.split("\n"):
        kind = "Header" if line.startswith("#") else "Table" if "|" in line else "Text"
        if kind == "Table" and out and out[-1].kind == "Table":
            out[-1].content += f"{line}\n"
        else:
            out.append(Block(kind, f"{line}\n" if kind == "Table" else line, page))
    for b in out:
        b.content = minified(b.content) if b.kind == "Table" else b.content
    return out


def element_blocks(elements: DataFrame, keys: list[str], max_table: int = MAX_TABLE, pages: DataFrame | None = None) -> DataFrame:
    """(keys, seq, block_type, page, content, element_ids) from elements, ordered by offset, those without one last.

    Tables above ``max_table`` tokens become parts with ids ``<id>:part-n``. ``pages`` of (keys, number, content): a page
    without an element gives the blocks of its text instead. Elements with a null content give none.
    """
    order = W.partitionBy(*keys).orderBy("page", F.col("start_offset").asc_nulls_last(), "seq")
    ranked = elements.where(F.col("content").isNotNull()).withColumn("at", F.row_number().over(order))
    kind = F.when(F.col("kind") == "table", "Table").when(F.col("kind") == "header", "Header").otherwise("Text")

    @F.pandas_udf("array<string>")
    def parts(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [minified(p) for p in split_table(t, max_table)], na_action="ignore")

    cut = ranked.withColumn("block_type", kind).withColumn("parts", F.coalesce(parts(F.when(F.col("kind") == "table", F.col("content"))), F.array("content")))
    rows = cut.select(*keys, "at", "page", "id", "block_type", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "content"))
    ident = F.when(F.col("n") > 1, F.concat("id", F.lit(":part-"), F.col("part").cast("string"))).otherwise(F.col("id"))
    rows = rows.select(*keys, "at", "part", "block_type", "page", "content", F.array(ident).alias("element_ids"))
    if pages is not None:
        bare = pages.select(*keys, F.col("number").alias("page"), "content").join(ranked.select(*keys, "page").distinct(), [*keys, "page"], "left_anti")
        lines = text_blocks(bare.select(*keys, F.col("page").alias("own_page"), F.col("page").alias("number"), "content"), [*keys, "own_page"])
        rows = rows.unionByName(lines.select(*keys, F.lit(0).alias("at"), F.col("seq").cast("int").alias("part"), "block_type", "page", "content", "element_ids"))
    seq = F.row_number().over(W.partitionBy(*keys).orderBy("page", "at", "part"))
    return rows.select(*keys, seq.alias("seq"), "block_type", "page", "content", "element_ids")


CHUNK = "index int, header string, blocks array<struct<block_type:string,page:int,content:string>>, element_ids array<string>"


def chunk(blocks: DataFrame, keys: list[str], size: int = SIZE, overlap: int = OVERLAP, header: Column | None = None) -> DataFrame:
    """(keys, index, header, blocks, element_ids) from (keys, seq, block_type, page, content, element_ids).

    Repeated blocks count once; those with a null content are left out. A key of any size is one task's work, as each cut
    depends on the one before.
    """
    rows = blocks.where(F.col("content").isNotNull()).select(*keys, F.struct("seq", F.col("block_type").alias("t"), F.col("page").alias("p"), F.col("content").alias("c"), F.coalesce("element_ids", F.array().cast("array<string>")).alias("e")).alias("b"), (F.lit(None).cast("string") if header is None else header).alias("header"))
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("b")).alias("b"), F.max("header").alias("header"))
    schema = StructType([*held.select(*keys).schema.fields, *_parse_datatype_string(CHUNK).fields])
    kinds = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *own, listed, head in zip(*(batch.column(c).to_pylist() for c in [*keys, "b", "header"])):
                packed = Packer([Block(x["t"], x["c"], x["p"], x["e"]) for x in listed], size, overlap).done
                for i, c in enumerate(packed):
                    ids = list(dict.fromkeys(e for b in c for e in b.ids))
                    out.append((*own, i, head, [{"block_type": b.kind, "page": b.page, "content": b.content} for b in c], ids))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return held.mapInArrow(pack, schema)


def chunk_notes(notes: DataFrame, elements: DataFrame, size: int = SIZE, overlap: int = OVERLAP, header: Column | None = None) -> DataFrame:
    """Chunks of notes (doc_id, name, element_ids), from their elements, grouped by the page on which each starts.

    Unknown ids are left out; a note without a known element has no chunk.
    """
    listed = notes.select("doc_id", "name", F.posexplode("element_ids").alias("seq", "id"))
    own = listed.join(elements.select("doc_id", "id", F.col("page_start").alias("page"), "content", "kind", "start_offset").distinct(), ["doc_id", "id"])
    return chunk(element_blocks(own, ["doc_id", "name"]), ["doc_id", "name"], size, overlap, header)


def chunk_columns(chunks: DataFrame, display: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """Chunks with content, pages, tokens, flags, the contents by page and the text to embed.

    display: (doc_id, number, display_page) adds the pages' printed numbers, those of the first and last too; null where
    none is known. elements: (id, kind, page_start, page_end, tags) adds tags and images, and gives the pages and whether
    there is an image from the elements; a part of a cut table has its pages, but no tags. Without them an image is its
    Markdown.
    """
    keys = [c for c in chunks.columns if c not in ("header", "blocks", "element_ids")]
    contents = F.transform("blocks", lambda b: b["content"])
    pages = F.array_distinct(F.transform("blocks", lambda b: b["page"]))
    by_page = F.transform(F.array_sort(pages), lambda p: F.struct(p.alias("page"), F.array_join(F.transform(F.filter("blocks", lambda b: b["page"] == p), lambda b: b["content"]), "\n").alias("content")))
    out = chunks.withColumns({
        "content": F.array_join(contents, "\n"), "start_page": F.array_min(pages), "end_page": F.array_max(pages),
        "num_tokens": F.aggregate(contents, F.lit(0), lambda a, c: a + tokens(c)),
        "has_table": F.exists("blocks", lambda b: b["block_type"] == "Table"), "has_image": F.exists(contents, lambda c: c.rlike("!\\[[^\\]]*\\]\\([^)]*\\)")),
        "page_contents": F.filter(by_page, lambda x: stripped(x["content"]) != ""),
    })
    out = out.withColumn("embedding_text", embedding_text(F.col("header"), F.col("content")))
    if elements is not None:
        part = F.regexp_extract("ref", "^(.*):part-\\d+$", 1)
        flat = chunks.select(*keys, F.posexplode(F.array_distinct("element_ids")).alias("place", "ref")).withColumn("id", F.when(part != "", part).otherwise(F.col("ref")))
        met = flat.join(elements.select("id", "kind", "page_start", "page_end", "tags").distinct(), "id")
        found = met.groupBy(*keys).agg(
            F.min("page_start").alias("first"), F.max("page_end").alias("last"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("id") == F.col("ref"), F.col("tags")))))).alias("tags"),
            F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "image", F.struct("place", "ref")))), lambda x: x["ref"]).alias("images"),
        )
        out = out.join(found, keys, "left").withColumns({
            "start_page": F.coalesce("first", "start_page"), "end_page": F.coalesce("last", "end_page"), "has_image": F.coalesce(F.size("images") > 0, F.lit(False)),
            "images": F.coalesce("images", F.array().cast("array<string>")), "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }).drop("first", "last")
    if display is not None:
        shown = display.where(F.col("display_page").isNotNull()).groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_set(F.struct("number", "display_page")))).alias("shown"))
        own = F.map_filter("shown", lambda k, _: F.array_contains(F.transform("blocks", lambda b: b["page"]), k))
        out = out.join(shown, "doc_id", "left").withColumn("display_page_map", F.when(F.size(own) > 0, own)).drop("shown")
        at = [F.try_element_at("display_page_map", F.col(c)) for c in ("start_page", "end_page")]
        out = out.withColumn("display_page_range", F.when(at[0].isNotNull() & at[1].isNotNull(), F.struct(at[0].alias("start"), at[1].alias("end"))))
    return out


def block_span(contents: Column, whole: Column) -> Column:
    """(start, end) in ``whole`` of texts that stand in it one after another; null where none is found.

    Each is looked for after the one before, else with any white space for its own, else from the start. Blank texts
    don't count.
    """
    def quoted(t: Column) -> Column:
        return F.concat(F.lit("(?U)"), F.regexp_replace(F.regexp_replace(t, "[^\\p{L}\\p{N}\\s]", r"\\$0"), "(?U)\\s+", r"\\s+"))

    def step(acc: Column, t: Column) -> Column:
        after, first, loose = F.position(t, whole, acc["at"] + 1), F.position(t, whole), F.regexp_instr(whole, quoted(t))
        start = F.when(after > 0, after).when(loose > 0, loose).when(first > 0, first)
        long = F.when((after > 0) | (loose <= 0), F.length(t)).otherwise(F.length(F.call_function("regexp_extract", whole, quoted(t), F.lit(0))))
        end = start - 1 + long
        return F.when(start.isNull(), acc).otherwise(
            F.struct(F.least(acc["start"], start - 1).alias("start"), F.greatest(acc["end"], end).alias("end"), end.alias("at"))
        )

    none = F.lit(None).cast("int")
    texts = F.filter(F.transform(contents, stripped), lambda t: t != "")
    found = F.aggregate(texts, F.struct(none.alias("start"), none.alias("end"), F.lit(0).alias("at")), step)
    return F.when(found["start"].isNotNull(), F.struct(found["start"].alias("start"), found["end"].alias("end")))


def located_elements(chunks: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """(chunk's keys, page, id) of the elements whose offsets lie within what a chunk's blocks span on their page.

    For chunks that carry no ids. pages: (doc_id, number, content); elements: (doc_id, page, id, start_offset, end_offset),
    those without offsets are never found. A join on document and page; a page meets its own elements only.
    """
    keys = [c for c in chunks.columns if c not in ("header", "blocks", "element_ids")]
    placed = chunks.select(*keys, F.posexplode("blocks").alias("place", "b"))
    own = placed.groupBy(*keys, F.col("b.page").alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "b.content"))), lambda x: x["content"]).alias("parts"))
    spans = own.join(pages.select("doc_id", F.col("number").alias("page"), F.col("content").alias("whole")).distinct(), ["doc_id", "page"]).withColumn("span", block_span(F.col("parts"), F.col("whole")))
    inside = (F.col("span.start") <= F.col("start_offset")) & (F.col("end_offset") <= F.col("span.end"))
    there = elements.select("doc_id", "page", "id", "start_offset", "end_offset").distinct()
    return spans.where("span IS NOT NULL").join(there, ["doc_id", "page"]).where(inside).select(*keys, "page", "id")


def chunk_json(chunks: DataFrame) -> DataFrame:
    """(json): a chunk with all its columns, nulls left out."""
    return chunks.select(F.to_json(F.struct(*chunks.columns)).alias("json"))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, on: str) -> DataFrame:
    """Chunks with the column vector of ``vectors`` (on, vector); null where there is none."""
    return chunks.join(vectors.select(on, "vector"), on, "left")


def with_tag(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows of which a tag matches a SQL LIKE pattern; null tags don't."""
    return rows.where(F.exists("tags", lambda t: t.like(pattern)))
