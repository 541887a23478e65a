"""The functions for use in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.operators import annotate, chunks, render, sections


@F.pandas_udf(T.StringType())
def html_to_markdown(s: pd.Series) -> pd.Series:
    def one(html: str) -> str:
        pages = render.Renderer(html).pages
        return "\n\n".join(c for _, p in sorted(pages.items()) if (c := render.content_of(p.segments)))

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_text(s: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    def one(text: str | None, size: int, overlap: int) -> list[str] | None:
        if text is None:
            return None
        return ["\n".join(b.content for b in c) for c in chunks.Packer(chunks.blocks_of(text), size, overlap).done]

    return pd.Series([one(*x) for x in zip(s, size, overlap)])


@F.pandas_udf(T.StringType())
def flatten_note(s: pd.Series) -> pd.Series:
    return s.map(annotate.flatten_note, na_action="ignore")


@F.pandas_udf(T.StringType())
def table_markdown(s: pd.Series) -> pd.Series:
    """Markdown of a document that is one table; what isn't one is an error."""
    return s.map(render.table_markdown, na_action="ignore")


@F.udtf(returnType="exhibit_no string, description string")
class Exhibits:
    """The exhibits that the text of an item 9.01 lists, for LATERAL joins."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from sections.exhibit_rows(text or "")


@F.udtf(returnType="page int, seq int, text string, tag string, note string")
class ParseSegments:
    """The segments of a document, for LATERAL joins."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            r = render.Renderer(html)
            for number, page in sorted(r.pages.items()):
                for i, s in enumerate(page.segments):
                    yield number, i, s.text, r.tree.tag[s.node] if s.node is not None else None, s.note[0] if s.note else None


@F.udtf(returnType="r int, c int, text string, rowspan int, colspan int")
class TableRows:
    """The cells of a document's first table, for LATERAL joins."""

    def eval(self, html: str) -> Iterator[tuple]:
        from filingloom.operators.tables import span

        t = render.Renderer(html or "").tree
        table = next((n for n in t.descend(0) if t.tag[n] == "table"), None)
        rows = [n for n in t.descend(table) if t.tag[n] == "tr"] if table is not None else []
        for i, row in enumerate(rows):
            for j, c in enumerate(c for c in t.descend(row) if t.tag[c] in ("td", "th")):
                yield i, j, t.plain(c), span(t.attrs[c].get("rowspan")), span(t.attrs[c].get("colspan"))


def register(spark: SparkSession) -> None:
    spark.udf.register("html_to_markdown", html_to_markdown)
    spark.udf.register("chunk_text", chunk_text)
    spark.udf.register("flatten_note", flatten_note)
    spark.udf.register("table_markdown", table_markdown)
    spark.udtf.register("exhibits", Exhibits)
    spark.udtf.register("parse_segments", ParseSegments)
    spark.udtf.register("table_rows", TableRows)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS INT RETURN greatest(1, cast(floor(coalesce(length(t), 0) / 4) AS INT))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION split_sentences(t STRING) RETURNS ARRAY<STRING> RETURN filter(transform(split(t, '(?<=[.!?])\\\\s+(?=[A-Z])'), x -> trim(x)), x -> x <> '')")
