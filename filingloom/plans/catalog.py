"""The queries of the engine's own operators, by name, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import text as X
from filingloom.operators import annotate, chunks, filings, sections
from filingloom.plans import dimensions, shapes


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def typed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each page once, with its filing's type, partitioned by document for the windows that follow."""
    pages = filings.spread(read(spark, sf, "doc_pages").select("doc_id", "number", "content", "display_page"), "doc_id").distinct()
    return pages.join(read(spark, sf, "filings").select("doc_id", "filing_type").distinct(), "doc_id")


def parsed(spark: SparkSession, sf: str, with_elements: bool = True) -> DataFrame:
    return filings.parse_pages(filings.latest(read(spark, sf, "filings")).select("doc_id", "html"), with_elements=with_elements)


def _elements(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return read(spark, sf, "elements").select(*cols).distinct()


def q_clean_text(spark, sf):
    return _elements(spark, sf, "id", "content").select("id", X.clean_text(F.col("content")).alias("cleaned"))


def q_token_estimate(spark, sf):
    return _elements(spark, sf, "id", "content").select("id", X.tokens(F.col("content")).cast("long").alias("tokens"))


def q_sentences(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    return docs.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def q_page_tokens(spark, sf):
    pages = read(spark, sf, "doc_pages").select("doc_id", "number", "content").distinct()
    sites = read(spark, sf, "filings").select("doc_id", "site").distinct()
    return pages.join(sites, "doc_id").groupBy("site").agg(F.count("*").alias("pages"), F.sum(X.tokens(F.col("content"))).cast("long").alias("tokens"))


def q_block_types(spark, sf):
    pages = read(spark, sf, "doc_pages").select("doc_id", "number", "content").distinct()
    return chunks.text_blocks(pages, ["doc_id"]).groupBy("doc_id", "block_type").agg(F.count("*").alias("blocks"))


def q_table_minify(spark, sf):
    rows = _elements(spark, sf, "id", "kind", "content").where("kind = 'table' AND content IS NOT NULL")
    return rows.select("id", X.minify_table(F.col("content")).alias("minified"))


def q_element_id(spark, sf):
    rows = _elements(spark, sf, "id", "page", "seq", "content", "kind")
    return rows.select("id", X.element_id("fl", F.col("page"), F.col("seq"), F.col("content"), F.col("kind")).alias("made"))


def q_numeric_cells(spark, sf):
    rows = _elements(spark, sf, "id", "kind", "content").where("kind = 'table'")
    cells = rows.select("id", F.explode(F.split("content", "[|\n]")).alias("cell"))
    return cells.groupBy("id").agg(F.count("*").alias("cells"), F.count(F.when(X.is_numeric(F.col("cell")), 1)).alias("numeric_cells"))


def q_url_parts(spark, sf):
    rows = read(spark, sf, "filings").select("doc_id", "url").distinct()
    return rows.select("doc_id", "url", X.is_url(F.col("url")).alias("is_url"), X.is_regulator_url(F.col("url")).alias("is_regulator"))


def q_pdf_guard(spark, sf):
    """Every seventh filing by number is given the first bytes of a PDF file, after blanks."""
    rows = filings.latest(read(spark, sf, "filings")).select("doc_id", "html")
    mark = F.when(F.substring("doc_id", -1, 1) == "7", F.concat(F.lit(" \n%PDF-1.7 "), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    return rows.select("doc_id", X.is_pdf(mark).alias("is_pdf"))


def q_latest_filings(spark, sf):
    return filings.latest(read(spark, sf, "filings")).select("doc_id", "filing_type", "site", "cik", "loaded_at")


def q_html_headings(spark, sf):
    """The first bold text of each parsed filing."""
    pages = parsed(spark, sf, False).where("number = 1")
    return pages.select("doc_id", F.regexp_extract("content", "^\\*\\*(.*?)\\*\\*", 1).alias("heading"))


def q_parsed_pages(spark, sf):
    return filings.display_pages(parsed(spark, sf, False)).select("doc_id", "number", "content", "display_page")


def q_markdown(spark, sf):
    return filings.to_markdown(parsed(spark, sf, False))


def q_parsed_elements(spark, sf):
    return filings.to_elements(parsed(spark, sf)).select("doc_id", "page", "seq", "id", "kind", "content", "start_offset", "end_offset", "char_count")


def q_retention(spark, sf):
    return filings.retention(parsed(spark, sf, False))


def q_table_md(spark, sf):
    """The nations of each region as an HTML table, turned into Markdown by the parser."""
    n = read(spark, sf, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    rows = n.groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("r"))
    html = F.concat(F.lit("<table><tr><th>Key</th><th>Name</th></tr>"), F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("</table>"))
    return filings.parse_pages(rows.select("doc_id", html.alias("html")), with_elements=False).select("doc_id", "content")


def q_money_columns(spark, sf):
    """A currency column of suppliers' balances and the amount's are merged; the header of the left one stays, a blank here."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), "s_name", F.floor("s_acctbal").cast("string").alias("amount"))
    html = F.concat(F.lit("<table><tr><td>Name</td><td></td><td>Balance</td></tr><tr><td>"), "s_name", F.lit("</td><td>$</td><td>"), "amount", F.lit("</td></tr><tr><td>Total</td><td>$</td><td>"), "amount", F.lit("</td></tr></table>"))
    return filings.parse_pages(s.select("doc_id", html.alias("html")), with_elements=False).select("doc_id", "content")


def q_page_breaks(spark, sf):
    """Reviews as documents of three pages by styles, the second hidden."""
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("item_id"))
    html = F.concat(F.lit('<p>'), "item_id", F.lit('</p><p style="page-break-before:always; display: none">x</p><div style="break-after: page">mid</div><p>end</p>'))
    return filings.parse_pages(d.where("item_id IS NOT NULL").select("doc_id", html.alias("html")), with_elements=False).select("doc_id", "number", "content")


def q_toc(spark, sf):
    pages = typed_pages(spark, sf)
    return pages.select("doc_id", "number", F.coalesce(sections.is_toc(F.col("content"), F.col("number")), F.lit(False)).alias("is_toc"))


def q_display_candidates(spark, sf):
    pages = read(spark, sf, "doc_pages").select("doc_id", "number", "content").distinct()
    return pages.select("doc_id", "number", filings.page_candidate(F.col("content")).cast("long").alias("candidate"))


def q_display_pages(spark, sf):
    pages = read(spark, sf, "doc_pages").select("doc_id", "number", "content").distinct().withColumn("footer", F.lit(None).cast("int"))
    return filings.display_pages(pages).select("doc_id", "number", F.col("display_page").cast("long").alias("display_page"))


def _sections(spark, sf) -> DataFrame:
    return sections.sections(sections.section_pages(typed_pages(spark, sf)))


def q_sections(spark, sf):
    cols = ("doc_id", "filing_type", "part", "item", "item_title")
    return _sections(spark, sf).select(*cols, *(F.col(c).cast("long").alias(c) for c in ("section", "start_page", "end_page", "tokens")))


def q_section_pages(spark, sf):
    return sections.section_pages(typed_pages(spark, sf)).select("doc_id", "section", "number", "content")


def q_section_8k(spark, sf):
    return sections.sections(sections.fragments_8k(typed_pages(spark, sf))).select("doc_id", "item", "item_title", F.col("start_page").cast("long").alias("start_page"))


def q_section_13d(spark, sf):
    return sections.sections(sections.fragments_13d(typed_pages(spark, sf))).select("doc_id", "item", "item_title", F.col("start_page").cast("long").alias("start_page"))


def q_get_section(spark, sf):
    return sections.get_section(_sections(spark, sf), "item 2").select("doc_id", "item", "item_title")


def q_section_stats(spark, sf):
    return _sections(spark, sf).groupBy("filing_type", "part", "item").agg(F.count("*").alias("sections"), F.sum("tokens").cast("long").alias("tokens"))


def q_item_dimension(spark, sf):
    return dimensions.filing_items(spark)


def q_structure_dimension(spark, sf):
    return dimensions.filing_structure(spark)


def q_xbrl_tags(spark, sf):
    return _elements(spark, sf, "id", "tags").select("id", F.explode("tags").alias("tag")).distinct()


def q_tag_filter(spark, sf):
    return chunks.with_tag(_elements(spark, sf, "id", "tags"), "inv:%Text%").select("id")


def _notes(spark, sf) -> DataFrame:
    """Elements by their first tag, as if it named a note."""
    rows = _elements(spark, sf, "doc_id", "page", "seq", "id", "tags").where("page IS NOT NULL")
    return filings.page_notes(rows.select("doc_id", "page", "seq", "id", F.get("tags", F.lit(0)).alias("note"), F.get("tags", F.lit(1)).alias("note_title")))


def q_merge_notes(spark, sf):
    m = filings.merge_notes(_notes(spark, sf))
    return m.select("doc_id", "name", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"), F.size("source_pages").cast("long").alias("pages"), F.size("element_ids").cast("long").alias("elements"))


def q_chunk_pages(spark, sf):
    """Chunks of whole filings from their pages' texts."""
    pages = read(spark, sf, "doc_pages").select("doc_id", "number", "content", "display_page").distinct()
    made = chunks.chunk(chunks.text_blocks(pages, ["doc_id"]), ["doc_id"])
    cols = chunks.chunk_columns(made, display=pages)
    return cols.select("doc_id", "index", "content", "start_page", "end_page", "num_tokens", "has_table", "has_image")


def q_chunk_elements(spark, sf):
    """Chunks of whole filings from their elements, with the tags of these."""
    el = _elements(spark, sf, "doc_id", "page", "seq", "id", "content", "kind", "start_offset", "tags")
    made = chunks.chunk(chunks.element_blocks(el, ["doc_id"]), ["doc_id"])
    cols = chunks.chunk_columns(made, elements=el.select("id", "kind", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "tags"))
    return cols.select("doc_id", "index", "content", "element_ids", "num_tokens", "has_table", F.array_join("tags", ",").alias("tags"))


def q_chunk_sections(spark, sf):
    """Chunks of sections, headed by their item's title."""
    keys = ["doc_id", "section", "title"]  # the title is one for a section, so it is carried as a part of the key
    found = sections.section_pages(typed_pages(spark, sf)).withColumn("title", F.concat_ws(" ", "item", "item_title"))
    return chunks.chunk_columns(chunks.chunk(chunks.text_blocks(found, keys), keys)).select("doc_id", "section", "index", "title", "content", "num_tokens")


def q_chunk_blocks(spark, sf):
    """Chunks of the blocks table, packed without overlap."""
    rows = read(spark, sf, "blocks").select("doc_id", "seq", "block_type", "page", "content", "element_ids").distinct()
    return chunks.chunk_columns(chunks.chunk(rows, ["doc_id"], overlap=0)).select("doc_id", "index", "content", "num_tokens")


def q_chunk_flags(spark, sf):
    """Properties of the chunks table, from its blocks."""
    rows = read(spark, sf, "chunks").select("chunk_id", "header", "blocks").where("blocks IS NOT NULL").distinct()
    cols = chunks.chunk_columns(rows.withColumn("blocks", F.filter("blocks", lambda b: b["content"].isNotNull())))
    return cols.select("chunk_id", "content", F.col("num_tokens").cast("long").alias("num_tokens"), "has_table", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))


def q_embedding_text(spark, sf):
    rows = read(spark, sf, "chunks").select("chunk_id", "header", "content").distinct()
    return rows.select("chunk_id", X.embedding_text(F.col("header"), F.col("content")).alias("embedding_text"))


def q_chunk_vectors(spark, sf):
    rows = read(spark, sf, "chunks").select("chunk_id", F.col("index").cast("long").alias("vec_id")).distinct()
    vectors = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return chunks.attach_vectors(rows, vectors, "vec_id").select("chunk_id", F.size("vector").cast("long").alias("dims"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("v0"))


def q_chunk_elements_of(spark, sf):
    """How many elements of each chunk are known, and how many of them are tables."""
    rows = read(spark, sf, "chunks").select("chunk_id", F.explode("element_ids").alias("id")).distinct()
    return rows.join(_elements(spark, sf, "id", "kind"), "id").groupBy("chunk_id").agg(F.count("*").alias("elements"), F.count(F.when(F.col("kind") == "table", 1)).alias("tables"))


def q_element_offsets(spark, sf):
    """Whether the offsets of each element find it in its page's content."""
    e = _elements(spark, sf, "id", "doc_id", "page", "content", "start_offset", "end_offset").where("start_offset IS NOT NULL AND end_offset IS NOT NULL AND content IS NOT NULL")
    p = read(spark, sf, "doc_pages").select("doc_id", F.col("number").alias("page"), F.col("content").alias("whole")).distinct()
    found = F.substring(F.col("whole"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return e.join(p, ["doc_id", "page"]).select("id", (found == F.col("content")).alias("matches"))


def q_highlight(spark, sf):
    rows = filings.latest(read(spark, sf, "filings")).where("html IS NOT NULL").select("doc_id", "html")
    out = annotate.highlighted(F.col("html"), F.array(F.col("doc_id")))
    return rows.select("doc_id", F.length(out).cast("long").alias("chars"), (F.locate("<style>", out) < F.locate("<script>", out)).alias("in_order"))


def q_annotated(spark, sf):
    return annotate.annotate(filings.latest(read(spark, sf, "filings")).where("html IS NOT NULL"))


def q_corpus_report(spark, sf):
    rows = filings.latest(read(spark, sf, "filings"))
    return rows.rollup("filing_type", "site").agg(F.count("*").alias("docs"), F.countDistinct("cik").alias("filers"), F.grouping_id().cast("long").alias("level"))


QUERIES = {**{k: f for k, f in globals().items() if k.startswith("q_")}, **shapes.QUERIES}
