"""Documents annotated with the ids of pages and elements, and highlighting of some of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import is_url, mime_type
from filingloom.operators import elements, render
from filingloom.operators.dom import COMMENT, TEXT, VOID

STYLE = "background-color: #ffe58f; outline: 2px solid #d48806;"


def annotated(html: str) -> str:
    """The document with ``page-n`` on the first node of each page, and each element's id on its first and its name on all nodes."""
    r = render.Renderer(html)
    ids: dict[int, str] = {}
    of: dict[int, str] = {}
    pages: dict[int, int] = {}
    for number, page in sorted(r.pages.items()):
        for e in elements.build(page.segments, r, number, render.content_of(page.segments)):
            for n in e["nodes"]:
                pages.setdefault(number, n)
                of[n] = e["id"]
            if e["nodes"]:
                ids.setdefault(e["nodes"][0], e["id"])
    t, out = r.tree, []
    first = {n: p for p, n in pages.items()}
    stack: list[int | str] = t.children[0][::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif t.tag[n] == TEXT:
            raw = t.parent[n] and t.tag[t.parent[n]] in ("script", "style")
            out.append(t.text[n] if raw else escape(t.text[n], quote=False))
        elif t.tag[n] == COMMENT:
            out.append(f"<!--{t.text[n]}-->")
        else:
            attrs = dict(t.attrs[n])
            if n in first:
                attrs["class"] = f"{attrs.get('class', '')} page-{first[n]}".strip()
            if n in ids or n in first:
                attrs.setdefault("id", ids.get(n) or f"page-{first[n]}")
            if n in of:
                attrs["data-element"] = of[n]
            out.append(f"<{t.tag[n]}" + "".join(f' {k}="{escape(v)}"' for k, v in attrs.items()) + ">")
            if t.tag[n] not in VOID:
                stack.append(f"</{t.tag[n]}>")
                stack += t.children[n][::-1]
    return f"<html><body>{''.join(out)}</body></html>"


def annotate(df: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc_id, html) of documents with ids; null documents stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(html=pdf["html"].map(annotated, na_action="ignore"))

    rows = df.select(F.col(doc).cast("string").alias("doc_id"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "doc_id string, html string")


def highlighted(html: Column, ids: Column) -> Column:
    """The document with a style for the given ids and a script that shows the first; unchanged without ids.

    The style goes before the end of the head, else after the start of the body, else first; the script before the end
    of the body, else last.
    """
    names = F.transform(ids, lambda i: F.concat(F.lit('[data-element="'), i, F.lit('"], [id="'), i, F.lit('"]')))
    style = F.concat(F.lit("<style>"), F.array_join(names, ", "), F.lit(f" {{ {STYLE} }}</style>"))
    script = F.concat(F.lit("<script>document.querySelector('"), F.element_at(names, 1), F.lit("').scrollIntoView();</script>"))
    low = F.lower(html)
    head, body, end = F.locate("</head>", low), F.regexp_instr(low, F.lit("<body[^>]*>")), F.locate("</body>", low)
    start = F.when(head > 0, head).when(body > 0, body + F.length(F.regexp_extract(low, "(<body[^>]*>)", 1))).otherwise(1)
    stop = F.when(end > 0, end).otherwise(F.length(html) + 1)
    text = F.concat(html.substr(F.lit(1), start - 1), style, html.substr(start, stop - start), script, html.substr(stop, F.length(html)))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, html).otherwise(text)


def image_refs(df: DataFrame, doc: str = "doc_id", html: str = "html", url: str = "url") -> DataFrame:
    """(doc_id, src, resolved): a row per distinct image address, resolved against the document's folder; data URIs left out."""
    refs = df.select(F.col(doc).alias("doc_id"), F.col(url).alias("url"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1)))).alias("src"))
    folder = F.regexp_extract("url", "^(.*/)", 1)
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    full = F.when(F.col("src").rlike("(?i)^https?://"), F.col("src")).when(F.col("src").startswith("//"), F.concat(F.lit("https:"), "src")).when(F.col("src").startswith("/"), F.concat(host, "src")).otherwise(F.concat(folder, "src"))
    return refs.where(~F.lower("src").startswith("data:")).select("doc_id", "src", full.alias("resolved")).distinct()


def embed_images(df: DataFrame, assets: DataFrame, doc: str = "doc_id", html: str = "html", url: str = "url") -> DataFrame:
    """(doc_id, html) with images as data URIs; ``assets`` has (path, content) as Spark reads binary files. Missing ones stay."""
    found = image_refs(df, doc, html, url).join(assets.select(F.col("path").alias("resolved"), "content"), "resolved")
    uris = found.select("doc_id", "src", F.concat(F.lit("data:"), mime_type(F.col("src")), F.lit(";base64,"), F.base64("content")).alias("uri"))
    by_doc = uris.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("src", "uri"))).alias("r"))
    joined = df.select(F.col(doc).alias("doc_id"), F.col(html).alias("html")).join(by_doc, "doc_id", "left")
    text = F.aggregate(F.coalesce("r", F.array().cast("array<struct<src:string,uri:string>>")), F.col("html"), lambda a, x: F.replace(F.replace(a, F.concat(F.lit('"'), x["src"], F.lit('"')), F.concat(F.lit('"'), x["uri"], F.lit('"'))), F.concat(F.lit("'"), x["src"], F.lit("'")), F.concat(F.lit("'"), x["uri"], F.lit("'"))))
    return joined.select("doc_id", text.alias("html"))


def fetch_images(refs: DataFrame, get: Callable[[str], bytes], parallel: int | None = None) -> DataFrame:
    """(path, content) of the addresses in ``resolved``, each fetched once, by the executors; those that fail are left out.

    With :func:`embed_images` this embeds images that no folder holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    yield pd.DataFrame({"path": [path], "content": [get(path)]})
                except OSError:  # one image that fails must not end the job
                    continue

    asked = refs.where(is_url(F.col("resolved"))).select(F.col("resolved").alias("path")).distinct()
    return (asked.repartition(parallel, "path") if parallel else asked).mapInPandas(run, "path string, content binary")


def write_highlighted(df: DataFrame, ids: DataFrame, path: str) -> None:
    """Documents (doc_id, html) with the elements of ``ids`` (doc_id, element_id) highlighted, one folder for each document.

    Documents without an id are written as they are; null documents are left out.
    """
    wanted = ids.groupBy("doc_id").agg(F.sort_array(F.collect_set("element_id")).alias("ids"))
    out = df.where(F.col("html").isNotNull()).select("doc_id", "html").join(wanted, "doc_id", "left")
    text = F.coalesce(highlighted(F.col("html"), F.col("ids")), F.col("html"))
    out.select("doc_id", text.alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("doc_id").text(path)


def flatten_note(html: str | None) -> str | None:
    """The cells of a note that is wrapped into a table, one after another; null if there is no such table."""
    if html is None:
        return None
    t = render.Renderer(html).tree
    table = next((n for n in t.descend(0) if t.tag[n] == "table"), None)
    if table is None:
        return None
    cells = [c for r in t.children[table] if t.tag[r] == "tr" for c in t.children[r] if t.tag[c] in ("td", "th")]
    return "".join(_serial(t, c) for c in cells) or None if cells else None


def _serial(t, node: int) -> str:
    out: list[str] = []
    stack: list[int | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif t.tag[n] == TEXT:
            out.append(escape(t.text[n], quote=False))
        elif t.tag[n] != COMMENT:
            out.append(f"<{t.tag[n]}" + "".join(f' {k}="{escape(v)}"' for k, v in t.attrs[n].items()) + ">")
            if t.tag[n] not in VOID:
                stack.append(f"</{t.tag[n]}>")
                stack += t.children[n][::-1]
    return "".join(out)
