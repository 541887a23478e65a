"""Queries that build documents of every shape from the star tables, and the SQL that says what must come out of them.

The documents are made by SQL expressions that both engines read; the results are stated by the SQL below, which knows
nothing of the operators. In them ``nl`` is a line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import register
from filingloom.functions import text as X
from filingloom.operators import annotate, chunks, filings, sections
from filingloom.plans.scratch import folder_for
from filingloom.sources import readers
from filingloom.streaming import pages as streaming


def made(spark: SparkSession, sf: str, table: str, key: str, html: str) -> DataFrame:
    """(doc_id, html): a document for each row of a table, spread over tasks, as a small table may make very many."""
    return filings.spread(spark.read.parquet(f"{sf}/{table}.parquet"), key).selectExpr(f"cast({key} as string) AS doc_id", f"{html} AS html")


def contents(spark: SparkSession, sf: str, table: str, key: str, html: str) -> DataFrame:
    return filings.parse_pages(made(spark, sf, table, key, html), with_elements=False).select("doc_id", "number", "content")


def box(x: str, y: str, text: str, extra: str = "") -> str:
    """An expression for a positioned element."""
    return f"""concat('<div style="position:absolute;left:', {x}, 'px;top:', {y}, 'px;{extra}">', {text}, '</div>')"""


# HTML: (table, key, document, pages as (number, content))
NL = "chr(10)"
DOCUMENTS: dict[str, tuple[str, str, str, list[tuple[int, str]]]] = {
    "q_html_inline": (
        "customer", "c_custkey",
        """concat('<p>Seen <b>', c_name, '</b> in <span style="font-style:italic">', c_mktsegment, '</span> with <span style="font-weight:700; font-style:italic">x', cast(c_custkey as string),
          '</span></p><p style="font-weight: bold">not bold by a blank</p><div><em>a</em><strong>b</strong> c</div>')""",
        [(1, "concat('Seen **', c_name, '** in *', c_mktsegment, '* with ***x', cast(c_custkey as string), '***', nl, nl, 'not bold by a blank', nl, nl, '*a *b** c')")],
    ),
    "q_html_lists": (
        "nation", "n_nationkey",
        "concat('<ul><li>• ', n_name, '</li><li>- second<li> </li></ul><ol><li>', n_name, '<li><b>two</b></ol>')",
        [(1, "concat('- ', n_name, nl, '- second', nl, nl, '1. ', n_name, nl, '2. **two**')")],
    ),
    "q_html_images": (
        "part", "p_partkey",
        """concat('<p>', p_name, '</p><img src="p', cast(p_partkey as string), '.png" alt="', p_brand, '"><img alt="no source"><p>end</p>')""",
        [(1, "concat(p_name, nl, nl, '![', p_brand, '](p', cast(p_partkey as string), '.png)', nl, nl, 'end')")],
    ),
    "q_html_hidden": (
        "supplier", "s_suppkey",
        """concat('<html><head><title>T</title><style>p {}</style></head><body><div style="DISPLAY: none">no<p>no</p></div><p>color: red;</p><p>a\u200bb', chr(160), ' ', chr(10), ' ', s_name, '</p></body>')""",
        [(1, "concat('ab ', s_name)")],
    ),
    "q_html_breaks": (
        "nation", "n_nationkey",
        """concat('<p>', n_name, '</p><div style="break-before: page"><p>2</p></div><p style="page-break-after : always">3?</p><hr style="page-break-before:always"><p>4</p><p style="page-break-after:always"></p><p style="break-before:always">6</p>')""",
        [(1, "n_name"), (2, "concat('2', nl, nl, '3?')"), (4, "'4'"), (6, "'6'")],
    ),
    "q_html_breadcrumbs": (
        "region", "r_regionkey",
        """concat('<p>PART II</p><p>Item 7</p><p>', r_name, '</p><p style="page-break-before:always"><b>Part iv</b></p><p>Item 9, 9A</p><p>kept</p><p style="page-break-before:always">PART II</p><p>Item 7. Title</p>')""",
        [(1, "r_name"), (2, "'kept'"), (3, "concat('PART II', nl, nl, 'Item 7. Title')")],
    ),
    "q_table_spans": (
        "supplier", "s_suppkey",
        """concat('<table><tr><td colspan="2">', s_name, '</td><td>h3</td></tr><tr><td rowspan="2">r</td><td>a', cast(s_suppkey as string), '</td><td rowspan="abc">b</td></tr><tr><td>c|d</td><td>e</td></tr></table>')""",
        [(1, "concat('| ', s_name, ' |  | h3 |', nl, '| --- | --- | --- |', nl, '| r | a', cast(s_suppkey as string), ' | b |', nl, '|  | c\\|d | e |')")],
    ),
    "q_table_fused": (
        "part", "p_partkey",
        """concat('<table><tr><td></td><td></td><td>', p_brand, '</td></tr><tr><td>u</td><td>v</td><td>w</td></tr><tr><td>1</td><td>', p_type, '</td><td>3</td></tr><tr><td></td><td></td><td></td></tr></table>')""",
        [(1, "concat('| u | v | ', p_brand, ' — w |', nl, '| --- | --- | --- |', nl, '| 1 | ', p_type, ' | 3 |')")],
    ),
    "q_table_marks": (
        "part", "p_partkey",
        """concat('<table><tr><td>Name</td><td>Rate</td><td></td><td>Note</td><td></td><td></td></tr><tr><td>', p_brand, '</td><td>', cast(p_size as string), '</td><td>%</td><td>text</td><td>[1a]</td><td> </td></tr><tr><td>b</td><td>7</td><td>%</td><td>other</td><td></td><td></td></tr></table>')""",
        [(1, "concat('| Name | Rate | Note |', nl, '| --- | --- | --- |', nl, '| ', p_brand, ' | ', cast(p_size as string), ' % | text [1a] |', nl, '| b | 7 % | other |')")],
    ),
    "q_table_rows": (
        "nation", "n_nationkey",
        """concat('<table><tr><td>Item 1a.</td><td></td><td>', n_name, '</td></tr></table><table><tr><td>Part ii</td></tr><tr><td> </td></tr></table><table><tr><td>plain</td><td>', n_name, '</td></tr></table><table></table>')""",
        [(1, "concat('ITEM 1A. ', n_name, nl, nl, 'PART II', nl, nl, 'plain ', n_name)")],
    ),
    "q_positioned_text": (
        "nation", "n_nationkey",
        "concat('<div>', " + ", ".join([
            box("'10'", "'10'", "'The word is hyphen-'"), box("'10'", "'25'", "'ated in'"), box("'10'", "'40'", "n_name"), box("'60'", "'40'", "'&nbsp;'", "display:inline-block;width:5px"),
            box("'70'", "'40'", "'ends.'"), box("'10'", "'55'", "'Heading'", "font-weight:bold"), box("'10'", "'70'", "'After it.'"), box("'10'", "'170'", "'Far below'"),
        ]) + """, '<div style="position:absolute;bottom:0;width:100%">Acme | 2024 Form 10-K | 17</div></div>')""",
        [(1, "concat('The word is hyphenated in ', n_name, ' ends.', nl, nl, '**Heading** After it.', nl, nl, 'Far below')")],
    ),
}


def _documents(name: str):
    table, key, html, pages = DOCUMENTS[name]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return contents(spark, sf, table, key, html)

    sql = " UNION ALL ".join(f"SELECT {key}::VARCHAR AS doc_id, {n} AS number, {c.replace('nl', NL)} AS content FROM {table}" for n, c in pages)
    return query, sql


QUERIES, ORACLE = {}, {}
for _name in DOCUMENTS:
    QUERIES[_name], ORACLE[_name] = _documents(_name)


def q_footer_pages(spark, sf):
    """The page number of a positioned footer is the page's printed one."""
    html = """concat('<div><div style="position:absolute;left:1px;top:9px">', n_name, '</div><div style="position:absolute;bottom:0;width:100%">', n_name, ' | Page ', cast(n_nationkey + 3 as string), '</div></div>')"""
    return filings.display_pages(filings.parse_pages(made(spark, sf, "nation", "n_nationkey", html), with_elements=False)).select("doc_id", "content", "footer", "display_page")


ORACLE["q_footer_pages"] = "SELECT n_nationkey::VARCHAR AS doc_id, n_name AS content, n_nationkey + 3 AS footer, n_nationkey + 3 AS display_page FROM nation"


def q_positioned_table(spark, sf):
    """Six suppliers of a nation at most, as a grid of positioned boxes with junk rows and an empty column."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey", "s_suppkey", "s_name", "row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r").where("r <= 6")
    row = F.expr("concat(" + ", ".join([box("'10'", "cast(20 * r + r % 3 as string)", "s_name"), box("'200'", "cast(20 * r as string)", "cast(s_suppkey as string)"), box("'205'", "cast(20 * r + 1 as string)", "'%'"), box("'350'", "cast(20 * r as string)", "concat('(', cast(s_suppkey + 1 as string), ')')")]) + ")")
    junk = F.expr(box("'10'", "cast(20 * (n + 1) as string)", "'(a) a note in a row'"))
    docs = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("r", row.alias("h")))).alias("rows"), F.count("*").alias("n")).where("n >= 3")
    html = docs.select(F.col("s_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("<div>"), F.array_join(F.transform("rows", lambda x: x["h"]), ""), junk, F.lit("</div>")).alias("html"))
    return filings.parse_pages(html, with_elements=False).select("doc_id", "content")


ORACLE["q_positioned_table"] = """SELECT s_nationkey::VARCHAR AS doc_id, string_agg(line, chr(10) ORDER BY r) AS content FROM (
  SELECT s_nationkey, r, count(*) OVER (PARTITION BY s_nationkey) AS n, '| ' || s_name || ' | ' || s_suppkey || '% | (' || (s_suppkey + 1) || ') |' || CASE WHEN r = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r <= 6) WHERE n >= 3 GROUP BY s_nationkey"""


NOTE = """concat('<div><ix:nonNumeric name="us-gaap:LeaseCostsTextBlock" id="n" continuedat="c"><p>Lease of ', s_name, ' <ix:nonFraction name="us-gaap:Rent">', cast(s_suppkey as string), '</ix:nonFraction> and <ix:nonFraction name="us-gaap:Term">5</ix:nonFraction></p><p>',
  repeat('long ', 60), '</p></ix:nonNumeric></div><p style="page-break-before:always">between</p><ix:continuation id="c"><p>more <ix:nonFraction name="us-gaap:Rent">7</ix:nonFraction></p></ix:continuation><p style="page-break-before:always">after</p>')"""


def q_facts_notes(spark, sf):
    """Facts and the notes they stand in, over a page break."""
    e = filings.to_elements(filings.parse_pages(made(spark, sf, "supplier", "s_suppkey", NOTE)))
    return e.select("doc_id", "page", "kind", F.array_join("tags", ",").alias("tags"), "note", "note_title")


ORACLE["q_facts_notes"] = """SELECT s_suppkey::VARCHAR AS doc_id, page, 'paragraph' AS kind, tags, note, title AS note_title FROM supplier,
  (VALUES (1, 'us-gaap:Rent,us-gaap:Term', 'us-gaap:LeaseCostsTextBlock', 'Lease Costs'), (2, 'us-gaap:Rent', 'us-gaap:LeaseCostsTextBlock', 'Lease Costs'), (3, NULL, NULL, NULL)) v(page, tags, note, title)"""


def q_notes_of_pages(spark, sf):
    """Notes merged over the pages they continue on, and their chunks."""
    e = filings.to_elements(filings.parse_pages(made(spark, sf, "supplier", "s_suppkey", NOTE)))
    notes = filings.merge_notes(filings.page_notes(e))
    made_ = chunks.chunk_columns(chunks.chunk_notes(notes, e))
    kept = notes.select("doc_id", "name", "title", "start_page", "end_page", F.array_join("source_pages", ",").alias("pages"))
    return kept.join(made_.select("doc_id", "name", "index", "content", "num_tokens", F.col("end_page").alias("last")), ["doc_id", "name"])


ORACLE["q_notes_of_pages"] = """SELECT s_suppkey::VARCHAR AS doc_id, 'us-gaap:LeaseCostsTextBlock' AS name, 'Lease Costs' AS title, 1 AS start_page, 2 AS end_page, '1,2' AS pages, 0 AS index, content,
  greatest(1, length(a) // 4) + greatest(1, length(b) // 4) AS num_tokens, 2 AS last FROM (SELECT *, a || chr(10) || b AS content FROM (
    SELECT s_suppkey, 'Lease of ' || s_name || ' ' || s_suppkey || ' and 5' || chr(10) || chr(10) || rtrim(repeat('long ', 60)) AS a, 'between' || chr(10) || chr(10) || 'more 7' AS b FROM supplier))"""


PARTS = """concat('<p>', repeat('a', 300), '</p><p>', repeat('b', 150 + 10 * cast(floor(p_size / 10) as int)), '</p><p>short</p><table><tr><td>k</td><td>v</td></tr><tr><td>', p_brand, '</td><td>1</td></tr></table><p><b>Head</b></p><p>', repeat('c', 600), '</p><p>tail</p>')"""


def q_element_merge(spark, sf):
    """Short neighbours are merged up to 500 characters, a table ends what stands before it, a bold heading waits for its text."""
    e = filings.to_elements(filings.parse_pages(made(spark, sf, "part", "p_partkey", PARTS)))
    return e.select("doc_id", "seq", "kind", "content", "start_offset", "end_offset")


ORACLE["q_element_merge"] = """WITH t AS (SELECT p_partkey::VARCHAR AS doc_id, repeat('a', 300) || chr(10) || chr(10) || repeat('b', 150 + 10 * (p_size // 10)::INT) AS ab, 'short' || chr(10) || chr(10) AS s,
    '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' | 1 |' AS tab, '**Head**' || chr(10) || chr(10) || repeat('c', 600) AS h, p_size >= 50 AS fits FROM part),
  e AS (SELECT doc_id, 0 AS seq, CASE WHEN fits THEN 'paragraph' ELSE 'table' END AS kind, CASE WHEN fits THEN ab ELSE ab || chr(10) || chr(10) || s || tab END AS content FROM t
    UNION ALL SELECT doc_id, 1, CASE WHEN fits THEN 'table' ELSE 'text' END, CASE WHEN fits THEN s || tab ELSE h END FROM t
    UNION ALL SELECT doc_id, 2, CASE WHEN fits THEN 'text' ELSE 'paragraph' END, CASE WHEN fits THEN h ELSE 'tail' END FROM t
    UNION ALL SELECT doc_id, 3, 'paragraph', 'tail' FROM t WHERE fits),
  o AS (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_offset FROM e)
  SELECT doc_id, seq, kind, content, start_offset, (start_offset + length(content))::INT AS end_offset FROM o"""


def q_annotated_pages(spark, sf):
    """Ids of elements and pages in the document itself."""
    return annotate.annotate(made(spark, sf, "supplier", "s_suppkey", """concat('<p title="&lt;">', s_name, ' &amp; co</p><br><p style="break-before:page">two')"""))


ORACLE["q_annotated_pages"] = """SELECT doc_id, '<html><body><p title="&lt;" class="page-1" id="' || a || '" data-element="' || a || '">' || s_name || ' &amp; co</p><br><p style="break-before:page" class="page-2" id="' || b || '" data-element="' || b || '">two</p></body></html>' AS html
  FROM (SELECT s_suppkey::VARCHAR AS doc_id, s_name, 'fl-p1-p0-' || substr(sha1(lower(s_name || ' & co')), 1, 8) AS a, 'fl-p2-p0-' || substr(sha1('two'), 1, 8) AS b FROM supplier)"""


def q_embedded_images(spark, sf):
    """Images fetched by the executors and put into their documents; those that fail stay."""
    docs = made(spark, sf, "part", "p_partkey", """concat('<img src="a/', cast(p_partkey as string), '.gif"><img src="/top.PNG"><img src=', chr(39), 'https://x.org/gone.svg', chr(39), '><img src="data:x">')""").withColumn("url", F.lit("https://h.org/f/doc.htm"))

    def get(url: str) -> bytes:
        if "gone" in url:
            raise OSError("gone")
        return url.encode()

    return annotate.embed_images(docs, annotate.fetch_images(annotate.image_refs(docs), get))


ORACLE["q_embedded_images"] = """SELECT p_partkey::VARCHAR AS doc_id, '<img src="data:image/gif;base64,' || to_base64(encode('https://h.org/f/a/' || p_partkey || '.gif')) || '"><img src="data:image/png;base64,' || to_base64(encode('https://h.org/top.PNG')) || '"><img src=' || chr(39) || 'https://x.org/gone.svg' || chr(39) || '><img src="data:x">' AS html FROM part"""


def q_sql_functions(spark, sf):
    """The functions registered for SQL."""
    register.register(spark)
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("filingloom_nations")
    return spark.sql("""SELECT n_nationkey, flatten_note(concat('<p>x</p><table><tr><td>', n_name, '</td></tr><tr><th>b</th></tr></table>')) AS flat, flatten_note('<p>no table</p>') AS none,
      table_markdown(concat('<table><tr><td>', n_name, '</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>')) AS md, array_join(chunk_text(concat('# H', chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| ', n_name, ' | 2 |', chr(10), 'One.'), 512, 0), '#') AS packed,
      e.exhibit_no, e.description FROM filingloom_nations, LATERAL exhibits(concat('x 1 | 2', chr(10), '(d) Exhibits', chr(10), '| 99.1 | ', n_name, ' |', chr(10), '| --- | --- |', chr(10), '104  Cover')) e""")


ORACLE["q_sql_functions"] = """SELECT n_nationkey, '<td>' || n_name || '</td><th>b</th>' AS flat, NULL AS none, '| ' || n_name || ' | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' AS md,
  '# H' || chr(10) || '|a|b|' || chr(10) || '|---|---|---|' || chr(10) || '|' || n_name || '|2|' || chr(10) || 'One.' AS packed, '99.1' AS exhibit_no, n_name AS description FROM nation"""


def _eight_k(spark, sf) -> DataFrame:
    """A filing for each part: a cover, and a page of items with exhibits, in one of the three forms of rows."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    rows = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('| 99.1 | ', p_name, ' |', chr(10), '|---|---|', chr(10), '| 104 | Cover |') WHEN 1 THEN concat('99.1   ', p_name, chr(10), '104    Cover')
      ELSE concat('<tr><td>99.1</td><td>', p_name, '</td></tr><tr> <td>104</td> <td>Cover</td></tr><tr><td>x</td><td>no</td></tr>') END""")
    body = F.concat(F.lit("| ITEM 5.02 | row |\nITEM 5.02 Departure\nHe left.\n**Item 9.01**\n(d) Exhibits.\n"), rows)
    pages = p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit("8-K").alias("filing_type"), F.posexplode(F.array(F.lit("cover"), body)).alias("at", "content"))
    return sections.section_pages(pages.select("doc_id", "filing_type", (F.col("at") + 1).alias("number"), "content"))


def q_exhibit_rows(spark, sf):
    return sections.exhibits(_eight_k(spark, sf)).select("doc_id", "exhibit_no", "description")


ORACLE["q_exhibit_rows"] = "SELECT p_partkey::VARCHAR AS doc_id, unnest(['99.1', '104']) AS exhibit_no, unnest([p_name, 'Cover']) AS description FROM part"


def q_section_part(spark, sf):
    """The first section of a part, and the texts of each section over its pages."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    pages = p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit("10-K").alias("filing_type"), F.posexplode(F.array(F.concat(F.lit("PART I\nItem 1. Business\n"), "p_name"), F.lit("more\nPART II\n" + "x" * 40), F.lit("**ITEM 7. MD&A**\ntext\n\n7\nAcme | 2024 Form 10-K | 9"))).alias("at", "content"))
    found = sections.section_pages(pages.withColumn("number", F.col("at") + 1))
    second = sections.get_section(sections.sections(found), part="part  ii")
    return second.select("doc_id", "section", "part", "item", "item_title").join(sections.section_markdown(found, rule=True).withColumnRenamed("section", "own").where("own = 2"), "doc_id").select("doc_id", "part", "item", "item_title", "markdown")


ORACLE["q_section_part"] = "SELECT p_partkey::VARCHAR AS doc_id, 'PART II' AS part, 'ITEM 7' AS item, 'MD&A' AS item_title, 'Item 1. Business' || chr(10) || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'more' AS markdown FROM part"


def q_item_codes(spark, sf):
    """Codes of 8-K items in their padded form."""
    d = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "concat(' ', cast(1 + p_partkey % 9 as string), '.', cast(p_size as string), if(p_size % 2 = 0, 'a', '')) AS code")
    return d.select("p_partkey", sections.item_code_8k(F.col("code")).alias("code"))


ORACLE["q_item_codes"] = "SELECT p_partkey, (1 + p_partkey % 9) || '.' || lpad(p_size::VARCHAR, 2, '0') || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END AS code FROM part"


# chunks


def q_table_parts(spark, sf):
    """A table of rows of equal length, far above the limit, in parts that each are as long as they may be."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    row = F.expr("concat('| ', lpad(cast(p_partkey as string), 12, '0'), ' | ', lpad(cast(p_size as string), 85, '.'), ' |')")
    t = p.groupBy(F.lit("d").alias("doc_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    el = t.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("seq"), F.lit("e").alias("id"), F.concat(F.lit("| k | v |\n| --- | --- |\n"), F.array_join("rows", "\n")).alias("content"), F.lit("table").alias("kind"), F.lit(0).alias("start_offset"))
    b = chunks.element_blocks(el, ["doc_id"])
    return b.select(F.col("seq").cast("long").alias("seq"), F.get("element_ids", F.lit(0)).alias("ref"), F.size(F.split("content", "\n")).cast("long").alias("lines"), F.length("content").cast("long").alias("chars"))


# a part holds head, dots and rows of 104 characters, of which 100 are left when blanks are cut; 8195 characters are 2048 tokens
ORACLE["q_table_parts"] = """WITH n AS (SELECT count(*) AS n FROM part), k AS (SELECT n, (8195 - 25 - 10) // 105 AS first, (8195 - 25 - 20) // 105 AS mid FROM n),
  parts AS (SELECT i, CASE WHEN i = 0 THEN least(first, n) ELSE least(mid, n - first - (i - 1) * mid) END AS rows, first + i * mid < n AS goes_on FROM k, unnest(range(0, 1000000)) r(i) WHERE i = 0 OR first + (i - 1) * mid < n)
  SELECT (i + 1)::BIGINT AS seq, 'e:part-' || i AS ref, (2 + (i > 0)::INT + rows + goes_on::INT)::BIGINT AS lines, (19 + 101 * rows + 10 * ((i > 0)::INT + goes_on::INT))::BIGINT AS chars FROM parts"""


def _packing(spark, sf, overlap: int) -> DataFrame:
    """Each order's lines as sentences of 40 characters, which are ten tokens, in one text block."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_partkey % 50 AS k", "concat('S', lpad(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string)), 38, 'x'), '.') AS s").distinct()
    t = li.groupBy(F.col("k").cast("string").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list("s")), " ").alias("content"))
    rows = t.select("doc_id", F.lit(1).alias("seq"), F.lit("Text").alias("block_type"), F.lit(1).alias("page"), "content", F.lit(None).cast("array<string>").alias("element_ids"))
    return chunks.chunk_columns(chunks.chunk(rows, ["doc_id"], size=512, overlap=overlap)).select("doc_id", F.col("index").cast("long").alias("index"), "content")


def q_packing(spark, sf):
    return _packing(spark, sf, 0)


def q_packing_overlap(spark, sf):
    return _packing(spark, sf, 128)


def _packing_sql(first: int, step: int) -> str:
    """Chunks of ``first`` sentences, each beginning ``step`` after the one before; what is repeated is a block of its own."""
    return f"""WITH s AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM (
      SELECT DISTINCT l_partkey % 50 AS k, 'S' || lpad(l_orderkey || '-' || l_linenumber || '-' || l_suppkey, 38, 'x') || '.' AS s FROM lineitem)),
    c AS (SELECT *, unnest(range(CASE WHEN i < {first} THEN 0 ELSE (i - {first}) // {step} + 1 END, i // {step} + 1)) AS c FROM s)
    SELECT k::VARCHAR AS doc_id, c::BIGINT AS index, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (WHERE c > 0 AND i < c * {step} + {first - step}) || chr(10), '')
      || string_agg(s, ' ' ORDER BY i) FILTER (WHERE c = 0 OR i >= c * {step} + {first - step}) AS content FROM c WHERE i >= c * {step} AND i < c * {step} + {first} AND (c = 0 OR c * {step} + {first - step} < n) GROUP BY k, c"""


ORACLE["q_packing"] = _packing_sql(51, 51)
ORACLE["q_packing_overlap"] = _packing_sql(51, 39)


def q_packing_reviews(spark, sf):
    """Real texts, sentence by sentence, in chunks of 32 tokens."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit(1).alias("seq"), F.lit("Text").alias("block_type"), F.lit(1).alias("page"), F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("element_ids"))
    cols = chunks.chunk_columns(chunks.chunk(d, ["doc_id"], size=32, overlap=0))
    return cols.select("doc_id", F.col("index").cast("long").alias("index"), "content", F.col("num_tokens").cast("long").alias("num_tokens"))


_BLANK = "[\\t\\n\\x0b\\x0c\\r\\x{85}\\p{Z}]"
ORACLE["q_packing_reviews"] = f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_BLANK}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
  u AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(ps), '^{_BLANK}+', ''), '{_BLANK}+$', '') AS s, generate_subscripts(ps, 1) AS k FROM p),
  s AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, greatest(1, length(s) // 4) AS n FROM u WHERE s <> ''),
  r AS (SELECT doc_id, i, 0::BIGINT AS c, n AS load FROM s WHERE i = 1 UNION ALL
    SELECT s.doc_id, s.i, CASE WHEN r.load + s.n > 32 THEN r.c + 1 ELSE r.c END, CASE WHEN r.load + s.n > 32 THEN s.n ELSE r.load + s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
  SELECT doc_id, c AS index, content, greatest(1, length(content) // 4)::BIGINT AS num_tokens FROM (SELECT r.doc_id, r.c, string_agg(s.s, ' ' ORDER BY s.i) AS content FROM r JOIN s USING (doc_id, i) GROUP BY r.doc_id, r.c)"""


def q_table_context(spark, sf):
    """A table that doesn't fit opens a chunk with its heading and the texts between; what it leaves ends the one before."""
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("cast(p_partkey as string) AS doc_id", "p_name")
    kinds = [("Text", "concat(repeat('x', 1600), '.')"), ("Header", "'# Sales'"), ("Text", "concat('In ', p_name)"), ("Table", "concat('|a|', chr(10), '|---|', chr(10), repeat('|1|', 200))"), ("Text", "'Tail.'")]
    rows = p.select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("block_type"), F.expr(c).alias("content")) for k, c in kinds])).alias("seq", "b"))
    blocks = rows.select("doc_id", "seq", "b.block_type", F.lit(1).alias("page"), "b.content", F.lit(None).cast("array<string>").alias("element_ids"))
    cols = chunks.chunk_columns(chunks.chunk(blocks, ["doc_id"], overlap=0))
    return cols.select("doc_id", F.col("index").cast("long").alias("index"), "content", "has_table")


ORACLE["q_table_context"] = """SELECT p_partkey::VARCHAR AS doc_id, unnest([0, 1])::BIGINT AS index, unnest([repeat('x', 1600) || '.' || chr(10) || '# Sales' || chr(10) || 'In ' || p_name,
  '# Sales' || chr(10) || 'In ' || p_name || chr(10) || '|a|' || chr(10) || '|---|' || chr(10) || repeat('|1|', 200) || chr(10) || 'Tail.']) AS content, unnest([false, true]) AS has_table FROM part"""


def q_chunk_page_contents(spark, sf):
    """The contents of a chunk by page, and the printed numbers of its pages."""
    rows = spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id", "doc_id", "header", "blocks").where("blocks IS NOT NULL").distinct()
    shown = spark.read.parquet(f"{sf}/doc_pages.parquet").select("doc_id", "number", "display_page").distinct()
    cols = chunks.chunk_columns(rows.withColumn("blocks", F.filter("blocks", lambda b: b["content"].isNotNull())), display=shown)
    seen = F.array_join(F.transform("page_contents", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["content"])), "#")
    return cols.select("chunk_id", seen.alias("by_page"), F.array_join(F.transform(F.array_sort(F.map_keys("display_page_map")), lambda k: F.concat(k.cast("string"), F.lit("="), F.try_element_at("display_page_map", k).cast("string"))), ",").alias("shown"), F.col("display_page_range.start").alias("first_shown"), F.col("display_page_range.end").alias("last_shown"))


ORACLE["q_chunk_page_contents"] = """WITH c AS (SELECT DISTINCT chunk_id, doc_id, header, list_filter(blocks, lambda b: b.content IS NOT NULL) AS bl FROM chunks WHERE blocks IS NOT NULL),
  b AS (SELECT chunk_id, doc_id, unnest(bl) AS x, generate_subscripts(bl, 1) AS i FROM c),
  p AS (SELECT chunk_id, doc_id, x.page AS page, string_agg(x.content, chr(10) ORDER BY i) AS content FROM b GROUP BY ALL),
  d AS (SELECT DISTINCT doc_id, number, display_page FROM doc_pages WHERE display_page IS NOT NULL),
  m AS (SELECT chunk_id, string_agg(p.page || ':' || p.content, '#' ORDER BY p.page) FILTER (WHERE regexp_matches(p.content, '[^\\s]')) AS by_page, string_agg(p.page || '=' || d.display_page, ',' ORDER BY p.page) AS shown,
    arg_min(d.display_page, p.page) FILTER (WHERE true) AS f0, min(p.page) AS lo, max(p.page) AS hi, any_value(p.doc_id) AS doc_id FROM p LEFT JOIN d ON d.doc_id = p.doc_id AND d.number = p.page GROUP BY chunk_id)
  SELECT c.chunk_id, coalesce(m.by_page, '') AS by_page, m.shown, CASE WHEN a.display_page IS NOT NULL AND z.display_page IS NOT NULL THEN a.display_page END AS first_shown, CASE WHEN a.display_page IS NOT NULL AND z.display_page IS NOT NULL THEN z.display_page END AS last_shown
  FROM c LEFT JOIN m USING (chunk_id) LEFT JOIN d a ON a.doc_id = m.doc_id AND a.number = m.lo LEFT JOIN d z ON z.doc_id = m.doc_id AND z.number = m.hi"""


def q_chunk_images(spark, sf):
    """Pages, images and tags of the chunks table, from the elements it names."""
    rows = spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id", "header", "blocks", "element_ids").where("blocks IS NOT NULL").distinct()
    known = spark.read.parquet(f"{sf}/elements.parquet").selectExpr("id", "if(seq % 7 = 0, 'image', kind) AS kind", "page_start", "page_end", "tags").distinct()
    cols = chunks.chunk_columns(rows, elements=known)
    return cols.select("chunk_id", "has_image", F.array_join(F.array_sort("images"), ",").alias("images"), F.array_join("tags", ",").alias("tags"), "start_page", "end_page")


ORACLE["q_chunk_images"] = """WITH c AS (SELECT DISTINCT chunk_id, header, blocks, element_ids FROM chunks WHERE blocks IS NOT NULL), e AS (SELECT DISTINCT id, seq % 7 = 0 OR kind = 'image' AS img, page_start, page_end, tags FROM elements),
  r AS (SELECT chunk_id, x.* FROM (SELECT DISTINCT chunk_id, unnest(element_ids) AS id FROM c) JOIN e x USING (id)),
  g AS (SELECT chunk_id, string_agg(id, ',' ORDER BY id) FILTER (WHERE img) AS images, min(page_start) AS lo, max(page_end) AS hi FROM r GROUP BY chunk_id),
  t AS (SELECT chunk_id, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT chunk_id, unnest(tags) AS t FROM r) GROUP BY chunk_id)
  SELECT c.chunk_id, g.images IS NOT NULL AS has_image, coalesce(g.images, '') AS images, coalesce(t.tags, '') AS tags, coalesce(g.lo, list_min(list_transform(c.blocks, lambda b: b.page))) AS start_page,
    coalesce(g.hi, list_max(list_transform(c.blocks, lambda b: b.page))) AS end_page FROM c LEFT JOIN g USING (chunk_id) LEFT JOIN t USING (chunk_id)"""


def q_located_elements(spark, sf):
    """Elements that lie within the text that a chunk of one block covers: each element taken for a chunk that carries no id."""
    el = spark.read.parquet(f"{sf}/elements.parquet").select("doc_id", "page", "id", "content", "start_offset", "end_offset").distinct()
    made_ = el.where("content IS NOT NULL AND page IS NOT NULL AND trim(content) <> ''").select("doc_id", F.col("id").alias("chunk_id"), F.array(F.struct(F.lit("Text").alias("block_type"), "page", "content")).alias("blocks"))
    pages = spark.read.parquet(f"{sf}/doc_pages.parquet").select("doc_id", "number", "content")
    return chunks.located_elements(made_, pages, el).select("chunk_id", "page", "id")


_WS = "[\\t\\n\\x0b\\x0c\\r\\x{85}\\p{Z}]"
ORACLE["q_located_elements"] = f"""WITH e AS (SELECT DISTINCT doc_id, page, id, content, start_offset, end_offset FROM elements), p AS (SELECT DISTINCT doc_id, number AS page, content AS whole FROM doc_pages),
  s AS (SELECT doc_id, page, id AS chunk_id, whole, regexp_replace(regexp_replace(content, '^{_WS}+', ''), '{_WS}+$', '') AS t FROM e JOIN p USING (doc_id, page) WHERE content IS NOT NULL AND trim(content) <> ''),
  f AS (SELECT *, instr(whole, t) - 1 AS a FROM s WHERE t <> '' AND instr(whole, t) > 0)
  SELECT f.chunk_id, f.page, e.id FROM f JOIN e ON e.doc_id = f.doc_id AND e.page = f.page AND e.start_offset >= f.a AND e.end_offset <= f.a + length(f.t)"""


# sources and sinks


def q_fetched(spark, sf):
    """Addresses fetched by the executors; one that fails has its error."""

    def get(url: str, agent: str | None) -> str:
        if url.endswith("0"):
            raise OSError("refused")
        return f"<p>{url} {agent}</p>"

    urls = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("if(s_suppkey % 5 = 1, 'ftp://x', concat('https://h.org/', cast(s_suppkey as string))) AS url")
    return readers.fetch(urls, agent="me", get=get)


ORACLE["q_fetched"] = """SELECT url, CASE WHEN url NOT LIKE '%0' THEN '<p>' || url || ' me</p>' END AS html, CASE WHEN url LIKE '%0' THEN 'refused' END AS error FROM (SELECT 'https://h.org/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 5 <> 1)"""


def q_exports(spark, sf):
    """Pages as nested JSON, and previews of their contents."""
    pages = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_name AS doc_id", "n_nationkey AS number", "concat(n_name, ' ', repeat('word  ', 40)) AS content", "1 AS tokens")
    return readers.page_json(pages, essentials=True).join(pages.select("doc_id", readers.preview(F.col("content"), 50).alias("preview")), "doc_id")


ORACLE["q_exports"] = """SELECT n_name AS doc_id, '{"number":' || n_nationkey || ',"content":"' || n_name || ' ' || repeat('word  ', 40) || '"}' AS json, substr(n_name || ' ' || repeat('word ', 40), 1, 50) || '...' AS preview FROM nation"""


def q_labels(spark, sf):
    """Elements, pages, sections and chunks in a line each, for display."""
    e = spark.read.parquet(f"{sf}/elements.parquet").select("id", "kind", "page_start", "page_end", "content").where("content IS NOT NULL").distinct()
    p = spark.read.parquet(f"{sf}/doc_pages.parquet").selectExpr("doc_id", "number", "display_page", "content", "greatest(1, length(content) div 4) AS tokens").distinct()
    s = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("concat('ITEM ', n_nationkey) AS item", "n_name AS item_title", "n_regionkey AS start_page", "n_nationkey AS end_page", "7 AS tokens")
    c = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey AS index", "n_regionkey AS start_page", "n_nationkey AS end_page", "if(n_nationkey = 3, NULL, struct(n_regionkey AS start, n_nationkey AS end)) AS display_page_range", "array(1, 2) AS blocks", "9 AS num_tokens")
    return e.select(F.col("id").alias("key"), readers.element_label().alias("label")).unionByName(p.select(F.concat("doc_id", F.lit("#"), F.col("number").cast("string")).alias("key"), readers.page_label().alias("label"))).unionByName(
        s.select(F.col("item_title").alias("key"), readers.section_label().alias("label"))
    ).unionByName(c.select(F.concat(F.lit("chunk "), F.col("index").cast("string")).alias("key"), readers.chunk_label().alias("label")))


ORACLE["q_labels"] = """SELECT id AS key, 'Element(id=''' || id || ''', kind=''' || kind || ''', p' || CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END || ', chars=' || length(content) || ', preview=''' || replace(substr(content, 1, 80), chr(10), ' ') || '...'')' AS label
    FROM (SELECT DISTINCT id, kind, page_start, page_end, content FROM elements WHERE content IS NOT NULL)
  UNION ALL SELECT doc_id || '#' || number, 'Page(number=' || number || CASE WHEN display_page > 0 THEN ', display_page=' || display_page ELSE '' END || ', tokens=' || greatest(1, length(content) // 4) || ', preview=''' || replace(substr(content, 1, 100), chr(10), ' ') || '...'')' FROM (SELECT DISTINCT doc_id, number, display_page, content FROM doc_pages)
  UNION ALL SELECT n_name, 'Section(item=''ITEM ' || n_nationkey || ''', title=''' || n_name || ''', pages=' || n_regionkey || '-' || n_nationkey || ', tokens=7)' FROM nation
  UNION ALL SELECT 'chunk ' || n_nationkey, 'Chunk[' || n_nationkey || '] (pages=' || CASE WHEN n_regionkey = n_nationkey THEN n_nationkey::VARCHAR ELSE n_regionkey || '-' || n_nationkey END ||
    CASE WHEN n_nationkey = 3 THEN '' WHEN n_regionkey = n_nationkey THEN ', display_page=' || n_nationkey ELSE ', display_pages=' || n_regionkey || '-' || n_nationkey END || ', blocks=2, tokens=9)' FROM nation"""


def q_nested(spark, sf):
    """Nations as an ordered array on their regions."""
    r = spark.read.parquet(f"{sf}/region.parquet").selectExpr("r_regionkey AS k", "r_name")
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey < 4").selectExpr("n_regionkey AS k", "n_nationkey", "n_name")
    return readers.nest(r, n, ["k"], "nations", "n_nationkey").select("r_name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("names"))


ORACLE["q_nested"] = "SELECT r_name, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_regionkey < 4 GROUP BY r_name"


def q_observed(spark, sf):
    """What an observation counted while the parse ran."""
    docs = made(spark, sf, "nation", "n_nationkey", "concat('<p>', n_name, '</p>')")
    seen, got = readers.observed(filings.parse_pages(docs, with_elements=False), "pages", chars=F.sum(F.length("content")))
    seen.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(got.get["rows"], got.get["chars"])], "rows long, chars long")


ORACLE["q_observed"] = "SELECT count(*) AS rows, sum(length(n_name))::BIGINT AS chars FROM nation"


def q_streamed_pages(spark, sf):
    """Filings as a stream, each once, their pages written exactly once."""
    rows = spark.read.parquet(f"{sf}/filings.parquet")
    folder, single = folder_for(spark, "streamed"), rows.inputFiles()[0].endswith("/filings.parquet")
    source = streaming.filings_stream(spark, sf if single else f"{sf}/filings.parquet", rows.schema, pattern="filings.parquet" if single else "*")
    query = streaming.write_pages(streaming.stream_pages(streaming.first_deliveries(source)).select("doc_id", "number", "content"), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return spark.read.schema("doc_id string, number int, content string").parquet(f"{folder}/out")


for _name, _f in list(globals().items()):
    if _name.startswith("q_"):
        QUERIES[_name] = _f
