"""Filings to pages, elements and notes: one Python crossing for each document, the rest in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from filingloom.functions.text import is_pdf, plausible_page, tokens
from filingloom.operators import elements, render

ELEMENT = "seq:int,id:string,content:string,kind:string,start_offset:int,end_offset:int,tags:array<string>,note:string,note_title:string"
PAGE = "doc_id string, number int, content string, footer int, input_chars long"
SEGMENTS, ELEMENTS = "segments array<struct<text:string,tag:string,note:string>>", f"elements array<struct<{ELEMENT}>>"
#: Characters of documents after which their pages are handed over, so that a batch of large documents doesn't add up.
HELD_CHARS = 1 << 24


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` partitioned by ``key`` into ``spark.sql.shuffle.partitions`` partitions, however few bytes they hold.

    For steps that take far more time than their bytes suggest, parsing or many patterns a line: else adaptive execution
    would join small partitions into one task. Windows, groups and joins by ``key`` after it need no other shuffle.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def latest(df: DataFrame, key: str = "doc_id", order: str = "loaded_at") -> DataFrame:
    """One row for each key, the last delivered (ties: whichever is greatest as a whole); null keys are left out."""
    cols = [c for c in df.columns if c not in (key, order)]
    best = spread(df.where(F.col(key).isNotNull()), key).groupBy(key).agg(F.max(F.struct(order, *cols)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols], F.col(f"r.{order}").alias(order))


def parse_pages(
    df: DataFrame, doc: str = "doc_id", html: str = "html", with_elements: bool = True, images: bool = True, comments: bool = True, min_chars: int = elements.MIN_CHARS, with_segments: bool = False
) -> DataFrame:
    """A row per page: (doc_id, number, content, footer, input_chars), with elements and segments where asked for.

    Null and empty documents give no page; PDF bytes are refused beforehand by :func:`split_pdf`. Pages that hold nothing
    do not come out, so numbers may have gaps. Parsing is narrow: its tasks are the partitions of ``df``.
    """
    rows = df.where(F.col(html).isNotNull() & ~is_pdf(F.col(html))).select(F.col(doc).cast("string").alias("doc_id"), F.col(html).alias("html"))
    schema = ", ".join([PAGE] + [SEGMENTS] * with_segments + [ELEMENTS] * with_elements)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        for batch in batches:
            for key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "html"))):
                r = render.Renderer(text, images, comments)
                for number, page in sorted(r.pages.items()):
                    content = render.content_of(page.segments)
                    row = [key, number, content, page.footer, len(text)]
                    if with_segments:
                        row.append([{"text": s.text, "tag": r.tree.tag[s.node] if s.node is not None else None, "note": s.note[0] if s.note else None} for s in page.segments])
                    if with_elements:
                        row.append([{k: v for k, v in e.items() if k != "nodes"} for e in elements.build(page.segments, r, number, content, min_chars)])
                    out.append(tuple(row))
                held += len(text)
                if out and held >= HELD_CHARS:
                    yield full()
                    out, held = [], 0
        if out:
            yield full()

    return rows.mapInArrow(parse, schema)


def split_pdf(df: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """The documents to parse, and those refused because they are PDF files."""
    return df.where(~is_pdf(F.col(html))), df.where(is_pdf(F.col(html)))


def page_candidate(content: Column) -> Column:
    """A page number among the first and last three lines of a page: a bare one from 10, ``Page n``, ``n |`` or ``| n``."""
    lines = F.split(content, "\n")
    near = F.when(F.size(lines) >= 3, F.concat(F.slice(lines, 1, 3), F.slice(lines, -3, 3))).otherwise(lines)

    def one(raw: Column) -> Column:
        line = F.trim(raw)

        def number(pattern: str, least: int) -> Column:
            n = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("int")
            return F.when(plausible_page(n, least), n)

        found = F.coalesce(number("^(\\d{1,4})$", 10), number("(?i)\\bPage\\s+(\\d{1,4})\\b", 1), number("\\b(\\d{1,4})\\s*\\|", 1), number("\\|\\s*(\\d{1,4})\\b", 1))
        return F.when(F.length(line) <= 100, found)

    return F.get(F.filter(F.transform(near, one), lambda n: n.isNotNull()), F.lit(0))


def display_pages(pages: DataFrame) -> DataFrame:
    """``pages`` of (doc_id, number, content, footer) with the column display_page.

    Numbers found in footers win outright. Else the candidates in the texts count if there are five or more and they
    rise: steps of one count double, other rises once, and the sum must be 0.8 of the steps.
    """
    by_doc, in_order = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("number")
    found = pages.withColumns({"candidate": page_candidate(F.col("content")), "place": F.row_number().over(in_order)})
    before = F.last("candidate", ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    step = F.col("candidate") - before
    scored = found.withColumn("score", F.when(step == 1, 2).when(step > 1, 1).when(step.isNotNull(), 0))
    n, total, sum_ = F.count("candidate").over(by_doc), F.count("score").over(by_doc), F.sum("score").over(by_doc)
    judged = scored.withColumns({"valid": (n >= 5) & (sum_ >= 0.8 * total), "footers": F.count("footer").over(by_doc)})
    # parity: the candidate is looked up by position in the document's pages, not by number. Each page tells its position
    # what its candidate is and asks its number, so the lookup is a window in the same partitioning
    two = judged.withColumn("at", F.explode(F.array(F.struct(F.col("place").alias("slot"), F.lit(False).alias("asks")), F.struct(F.col("number").alias("slot"), F.lit(True).alias("asks")))))
    told = F.max(F.when(~F.col("at.asks"), F.col("candidate"))).over(W.partitionBy("doc_id", "at.slot"))
    shown = F.when(F.col("footers") > 0, F.col("footer")).when(F.col("valid"), told)
    return two.withColumn("display_page", shown).where("at.asks").drop("candidate", "place", "score", "valid", "footers", "at")


def to_pages(df: DataFrame, **options) -> DataFrame:
    """(doc_id, number, content, display_page, tokens, elements) of filings."""
    return display_pages(parse_pages(df, **options)).select("doc_id", "number", "content", "display_page", tokens(F.col("content")).alias("tokens"), "elements")


def to_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): the contents that aren't empty, joined by an empty line."""
    parts = F.sort_array(F.collect_list(F.when(F.length("content") > 0, F.struct("number", "content"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("markdown"))


def to_elements(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, id, content, kind, page_start, page_end, start_offset, end_offset, tags, note, note_title, char_count)"""
    rows = pages.select("doc_id", F.col("number").alias("page"), F.explode("elements").alias("e"))
    return rows.select("doc_id", "page", "e.seq", "e.id", "e.content", "e.kind", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "e.start_offset", "e.end_offset", "e.tags", "e.note", "e.note_title", F.length("e.content").alias("char_count"))


def page_notes(elements_df: DataFrame) -> DataFrame:
    """(doc_id, page, name, title, element_ids) of the notes on each page: the first title, elements in order."""
    own = elements_df.where(F.col("note").isNotNull())
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"])
    first = F.min_by("note_title", F.when(F.col("note_title").isNotNull(), F.col("seq")))
    return own.groupBy("doc_id", "page", F.col("note").alias("name")).agg(first.alias("title"), listed.alias("element_ids"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """(doc_id, name, title, start_page, end_page, source_pages, element_ids): a note over its pages, with its last title."""
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "element_ids"))), lambda x: x["element_ids"]))
    return notes.groupBy("doc_id", "name").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("page"))).alias("title"),
        F.min("page").alias("start_page"),
        F.max("page").alias("end_page"),
        F.sort_array(F.collect_set("page")).alias("source_pages"),
        ids.alias("element_ids"),
    )


def retention(parsed: DataFrame) -> DataFrame:
    """(doc_id, input_chars, output_chars, retention) of :func:`parse_pages`."""
    out = parsed.groupBy("doc_id").agg(F.max("input_chars").alias("input_chars"), F.sum(F.length("content")).cast("long").alias("output_chars"))
    return out.withColumn("retention", F.when(F.col("input_chars") > 0, F.col("output_chars") / F.col("input_chars")))
