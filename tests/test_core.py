"""The reference cases of parsing, tables, positions, elements, sections, chunks and sources, with exact results."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions import register, text
from filingloom.operators import annotate, chunks, elements, filings, positioned, render, sections, tables
from filingloom.plans import dimensions, shapes
from filingloom.sources import readers
from filingloom.streaming import pages as streaming


def pages_of(html, **options):
    return {n: render.content_of(p.segments) for n, p in sorted(render.Renderer(html, **options).pages.items())}


def elements_of(html):
    r = render.Renderer(html)
    return [e for n, p in sorted(r.pages.items()) for e in elements.build(p.segments, r, n, render.content_of(p.segments))]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>One</p><p>Two</p>", {1: "One\n\nTwo"}),
        ("<p><b><i>x</i></b></p>", {1: "***x***"}),
        ("<b>a</b><b>b</b>", {1: "**a b**"}),
        ("<ul><li>• a</li><li>b</ul><ol><li>c<li>d</ol>", {1: "- a\n- b\n\n1. c\n2. d"}),
        ('<div style="display: none">no</div><p>yes</p>', {1: "yes"}),
        ("<p>a b​c</p>", {1: "a bc"}),
        ('<p>1</p><p style="page-break-before: always">2</p>', {1: "1", 2: "2"}),
        ('<p style="page-break-after:always">1</p><p>2</p>', {1: "1", 2: "2"}),
        ('<p>1</p><p style="break-before:page">2</p><p style="break-before:page">3</p>', {1: "1", 2: "2", 3: "3"}),
        ("<p>PART II</p><p>Item 7</p><p>text</p>", {1: "text"}),
        ("<p>PART II</p><p>Item 7. Title</p><p>text</p>", {1: "PART II\n\nItem 7. Title\n\ntext"}),
        ("<p>**PART II**</p><p>Item 9, 9A</p><p>text</p>", {1: "text"}),
        ("<p>color: red;</p><p>x</p>", {1: "x"}),
        ('<p style="font-weight: 700">x</p><span style="font-weight:700">y</span>', {1: "x\n\n**y**"}),
        ("<table><tr><td>Item 1.</td><td>Business</td></tr></table>", {1: "ITEM 1. Business"}),
        ("<table><tr><td>Part II</td></tr></table>", {1: "PART II"}),
        ('<p>a</p><img src="x.png" alt="A">', {1: "a\n\n![A](x.png)"}),
        ("<p><b>open<br><p>next</body>", {1: "**open**\n\nnext"}),
        ("<html><head><title>T</title><style>p{}</style></head><body>x</body></html>", {1: "x"}),
        ("", {}),
    ],
)
def test_pages(html, want):
    got = pages_of(html)
    assert {k: v for k, v in got.items() if v} == want


def test_comments_are_text_only_if_wanted():
    assert pages_of("<p>x<!-- note --></p>")[1] == "x note" and pages_of("<p>x<!-- note --></p>", comments=False)[1] == "x"


def test_deep_nesting():
    assert "end" in pages_of("<div>" * 5000 + "end" + "</div>" * 5000)[1]


T3 = [[("", 1, 1), ("2024", 1, 1), ("", 1, 1)], [("Sales", 1, 1), ("$", 1, 1), ("100", 1, 1)], [("Cost", 1, 1), ("$", 1, 1), ("40", 1, 1)]]


@pytest.mark.parametrize(
    "cells, want",
    [
        ([[("a", 1, 1), ("b", 1, 1)], [("c", 1, 1), ("d", 1, 1)]], "| a | b |\n| --- | --- |\n| c | d |"),
        (T3, "|  | 2024 |\n| --- | --- |\n| Sales | $ 100 |\n| Cost | $ 40 |"),
        ([[("A|B", 1, 1), ("x", 1, 1)], [("c", 1, 1), ("d", 1, 1)]], "| A\\|B | x |\n| --- | --- |\n| c | d |"),
        ([[("•", 1, 1), ("text", 1, 1)]], "- text"),
        ([[("h", 1, 2)], [("c", 1, 1), ("d", 1, 1)]], "| h |  |\n| --- | --- |\n| c | d |"),
        ([[("r", 2, 1), ("b", 1, 1)], [("d", 1, 1)], [("e", 1, 1), ("f", 1, 1)]], "| r | b |\n| --- | --- |\n|  | d |\n| e | f |"),
        ([[("", 1, 1), ("", 1, 1), ("y", 1, 1)], [("u", 1, 1), ("v", 1, 1), ("w", 1, 1)], [("1", 1, 1), ("2", 1, 1), ("3", 1, 1)]], "| u | v | y — w |\n| --- | --- | --- |\n| 1 | 2 | 3 |"),
        ([[("", 1, 1)]], ""), ([], ""),
    ],
)
def test_tables(cells, want):
    assert tables.markdown(cells) == want


def test_spans():
    assert [tables.span(x) for x in ("2", "abc", None, "2.5", "0")] == [2, 1, 1, 25, 0]
    assert tables.spread([[("a", 2, 1), ("b", 1, 1)], [("c", 1, 1)]]) == [["a", "b"], ["", "c"]]


def grid(n_rows=6, xs=(10, 200, 350), word=str):
    return [positioned.Box(x, 20.0 * y, 20.0 * y, f"Row {y}" if i == 0 else word(100 * y + i)) for y in range(n_rows) for i, x in enumerate(xs)]


def test_positioned_tables():
    assert positioned.Layout(grid()).is_table()
    assert positioned.Layout(grid()).markdown().split("\n")[:3] == ["| Row 0 | 1 | 2 |", "| --- | --- | --- |", "| Row 1 | 101 | 102 |"]
    assert not positioned.Layout(grid()[:2]).is_table()
    assert not positioned.Layout(grid(word=lambda n: "label")).is_table()
    assert not positioned.Layout([positioned.Box(10, 20 * y, 20 * y, "A long sentence of prose that goes on and on. And on it goes.") for y in range(6)]).is_table()
    assert positioned.clusters([100, 100.5, 101.2], 5) == {100: 0, 100.5: 0, 101.2: 0}
    assert positioned.clusters([10, 18, 26, 60], 12) == {10: 0, 18: 0, 26: 1, 60: 2}
    assert positioned.median([3, 1, 2]) == 2 and positioned.median([1, 2, 3, 4]) == 2.5 and positioned.median([]) == 0


def test_positioned_text_and_footer():
    def box(x, y, t, extra=""):
        return f'<div style="position:absolute;left:{x}px;top:{y}px;{extra}">{t}</div>'

    html = f'<div>{box(10, 10, "The word is hyphen-")}{box(10, 25, "ated here")}{box(10, 40, "Done.")}<div style="position:absolute;bottom:0;width:100%">Acme | 2024 Form 10-K | 17</div></div>'
    r = render.Renderer(html)
    assert render.content_of(r.pages[1].segments) == "The word is hyphenated here Done." and r.pages[1].footer == 17
    parts = f'<div>{box(10, 10, "A")}{box(20, 10, "&nbsp;", "display:inline-block;width:5px")}{box(30, 10, "B")}</div>'
    assert pages_of(parts)[1] == "A B"
    assert [len(g) for g in positioned.split_groups([positioned.Box(0, y, y, "t") for y in (0, 10, 20, 90, 100)])] == [3, 2]


def test_elements():
    long = "word " * 120
    got = elements_of(f"<p>{long}</p><p>short</p><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table><p><b>Head</b></p><p>{long}</p>")
    assert [e["kind"] for e in got] == ["paragraph", "table", "text"] and len({e["id"] for e in got}) == 3
    assert got[1]["content"].startswith("short\n\n| a | 1 |") and got[2]["content"].startswith("**Head**")
    assert all(e["start_offset"] is not None and e["end_offset"] - e["start_offset"] == len(e["content"]) for e in got)


def test_facts_and_notes():
    note = '<div><ix:nonNumeric name="us-gaap:LeasesTextBlock" id="n1" continuedat="c1"><p>Leases ' + "x" * 220 + ' <ix:nonFraction name="us-gaap:Rent">5</ix:nonFraction></p></ix:nonNumeric></div>'
    got = elements_of(note + '<p style="page-break-before:always">between</p><ix:continuation id="c1"><p>more</p></ix:continuation>')
    assert got[0]["tags"] == ["us-gaap:Rent"] and got[0]["note"] == "us-gaap:LeasesTextBlock" and got[0]["note_title"] == "Leases"
    assert got[-1]["content"] == "between\n\nmore" and got[-1]["note"] == "us-gaap:LeasesTextBlock"


# columns


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", T._parse_datatype_string(kind))]))
    return df.select(column(F.col("x"))).first()[0]


def test_text_columns(spark):
    assert one(spark, " a  b​c\n", text.clean_text) == "a bc"
    assert one(spark, "x" * 11, text.tokens) == 2 and one(spark, None, text.tokens) == 1
    assert one(spark, "One. Two! three? Four", text.sentences) == ["One.", "Two! three?", "Four"] and one(spark, "", text.sentences) == []
    assert [one(spark, x, text.is_url) for x in ("https://a.b/c", "ftp://a", "<html>", "", None)] == [True, False, False, False, False]
    assert one(spark, " \n%PDF-1.4", text.is_pdf) and not one(spark, "<p>%PDF", text.is_pdf)
    assert [one(spark, x, text.is_numeric) for x in ("(1,234.5)", "$ 5", "12%", "$-5", "a1", "")] == [True, True, True, False, False, False]
    assert one(spark, "| a  b | c |\n| - | - |\n\n| 1 | 2 |", text.minify_table) == "|a b|c|\n|---|---|---|\n|1|2|"
    assert one(spark, "a/b.SVG?x=1", text.mime_type) == "image/svg+xml" and one(spark, "a", text.mime_type) == "image/png"
    assert one(spark, b"ab\xffc", text.decoded, "binary") == "abc"
    assert one(spark, "5.2", sections.item_code_8k) == "5.02" and one(spark, "9.01a", sections.item_code_8k) == "9.01A"


def test_pdf_behind_much_white_space(spark):
    from filingloom.functions.text import is_pdf

    df = spark.createDataFrame([(" \n" * 3000 + "%PDF-1.7", True), ("%PDF", True), ("\n" * 5000 + "<p>%PDF</p>", False), ("a\n%PDF", False), ("", False), (None, False)], "t string, want boolean")
    assert df.where(is_pdf(F.col("t")) != F.col("want")).count() == 0


def test_filings_frame(spark):
    rows = [("a", "10-K", "<p>x</p>", 1), ("a", "10-K", "<p>y</p>", 2), ("b", "8-K", None, 1), ("c", "8-K", "%PDF-1", 1), (None, "8-K", "<p>z</p>", 1), ("d", "8-K", "", 1)]
    df = spark.createDataFrame(rows, "doc_id string, filing_type string, html string, loaded_at long").withColumn("content", F.lit("clash"))
    last = filings.latest(df)
    assert {(r["doc_id"], r["html"]) for r in last.collect()} == {("a", "<p>y</p>"), ("b", None), ("c", "%PDF-1"), ("d", "")}
    pages = filings.to_pages(last)
    assert [(r["doc_id"], r["number"], r["content"], r["tokens"]) for r in pages.collect()] == [("a", 1, "y", 1)]
    assert filings.to_markdown(pages).collect()[0]["markdown"] == "y"
    assert filings.to_elements(pages).collect()[0]["kind"] == "paragraph"
    assert filings.to_pages(df.limit(0)).collect() == []
    good, bad = filings.split_pdf(last)
    assert good.count() == 3 and bad.count() == 1


def test_display_pages(spark):
    rows = [("a", n, f"text\n\n{n + 40}", None) for n in range(1, 8)] + [("b", n, f"x\n{50 - n} |", None) for n in range(1, 8)] + [("c", 1, "t", 9), ("c", 2, "t\n77", None), ("d", 1, None, None)]
    got = {(r["doc_id"], r["number"]): r["display_page"] for r in filings.display_pages(spark.createDataFrame(rows, "doc_id string, number int, content string, footer int")).collect()}
    assert all(got["a", n] == n + 40 for n in range(1, 8)) and all(got["b", n] is None for n in range(1, 8))
    assert got["c", 1] == 9 and got["c", 2] is None and got["d", 1] is None


def test_notes(spark):
    rows = [("d", 1, 0, "e1", "N", "T1"), ("d", 1, 1, "e2", "N", None), ("d", 2, 0, "e3", "N", "T2"), ("d", 2, 1, "e4", "M", None), ("d", 3, 0, "e5", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, seq int, id string, note string, note_title string")
    got = {r["name"]: r for r in filings.merge_notes(filings.page_notes(df)).collect()}
    assert got["N"]["title"] == "T2" and got["N"]["source_pages"] == [1, 2] and got["N"]["element_ids"] == ["e1", "e2", "e3"]
    assert got["M"]["title"] is None and got["M"]["start_page"] == got["M"]["end_page"] == 2 and len(got) == 2


def frame(spark, kind, contents):
    return spark.createDataFrame([("d", kind, i + 1, c) for i, c in enumerate(contents)], "doc_id string, filing_type string, number int, content string").withColumn("item", F.lit("clash"))


def sections_of(spark, kind, contents):
    found = sections.section_pages(frame(spark, kind, contents))
    return [(r["part"], r["item"], r["item_title"], r["start_page"], r["end_page"]) for r in sections.sections(found).orderBy("section").collect()]


def test_standard_sections(spark):
    assert sections_of(spark, "10-K", ["ITEM 7\n\nITEM 7 Management Discussion\nContent"]) == [("PART II", "ITEM 7", "Management Discussion", 1, 1)]
    assert sections_of(spark, "10-K", ["PART I\nITEM 1. Business\nx\nITEM 1A. Risk Factors\ny", "more", "PART II\n**ITEM 5. Market**\nz"]) == [
        ("PART I", "ITEM 1", "Business", 1, 1), ("PART I", "ITEM 1A", "Risk Factors", 1, 2), ("PART II", "ITEM 5", "Market", 3, 3),
    ]
    assert sections_of(spark, "10-Q", ["ITEM 1. No part\nx"]) == []
    assert sections_of(spark, "10-K", ["ITEM 1. a\nITEM 2. b\nITEM 3. c\nx"]) == []  # a table of contents
    assert sections_of(spark, "10-K", ["ITEM 99. Odd\nx"]) == [] and sections_of(spark, "10-K", [None, ""]) == []
    assert sections_of(spark, "S-1", ["ITEM 1. Business"]) == []


def test_8k_sections(spark):
    body = "| ITEM 5.02 | x |\nITEM 5.02 Departure\nHe left.\nITEM 9.01\n(d) Exhibits\n| 99.1 | Press release |\n| 104 | Cover |"
    assert sections_of(spark, "8-K", ["cover", body]) == [(None, "ITEM 5.02", "Departure", 2, 2), (None, "ITEM 9.01", "Financial Statements and Exhibits", 2, 2)]
    found = sections.section_pages(frame(spark, "8-K", ["cover", body]))
    assert sorted((r["exhibit_no"], r["description"]) for r in sections.exhibits(found).collect()) == [("104", "Cover"), ("99.1", "Press release")]
    assert sections_of(spark, "8-K", [body]) == []
    assert [r["item"] for r in sections.sections(sections.fragments_8k(frame(spark, "8-K", ["cover", body]), ["9.01"])).collect()] == ["ITEM 9.01"]


def test_13d_sections(spark):
    body = "Item 1. Security\na\nItem 2.\nb\nItem 8. no\nc\nSIGNATURE\nItem 3. late"
    assert sections_of(spark, "SC 13D", [body, "Item 4. after"]) == [(None, "ITEM 1", "Security", 1, 1), (None, "ITEM 2", "Identity and Background", 1, 1)]
    sub = "Item 1(a). Name\nx\nItem 1(b). Address\ny\nItem 2(a). Person\nz"
    assert [s[1:3] for s in sections_of(spark, "SC 13G", [sub])] == [("ITEM 1", "(a). Name"), ("ITEM 2", "(a). Person")]


def test_get_section(spark):
    found = sections.sections(sections.section_pages(frame(spark, "10-K", ["PART I\nITEM 1. Business\nx\nITEM 1A. Risk Factors\ny"])))
    assert sections.get_section(found, " item 1a ").first()["item_title"] == "Risk Factors" and sections.get_section(found, "1B").count() == 0
    assert sections.get_named(found, "10-K", "RISK_FACTORS").count() == 1
    with pytest.raises(ValueError):
        sections.get_section(found, 7)
    with pytest.raises(ValueError):
        sections.get_named(found, "10-K", "NOPE")


def test_dimensions(spark):
    counts = {r["filing_type"]: r["count"] for r in dimensions.filing_items(spark).groupBy("filing_type").count().collect()}
    assert counts == {"10-K": 23, "10-Q": 11, "8-K": 33, "SC 13D": 7, "SC 13G": 10}


# chunks


def sents(n, words=2):
    return " ".join("S" + "x" * (4 * words + 1) + "." for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 5, 17, 64, 128, 512])
@pytest.mark.parametrize("overlap", [0, 4, 16])
def test_no_empty_chunk(size, overlap):
    blocks = [chunks.Block("Text", sents(20), 1), chunks.Block("Header", "# H", 1), chunks.Block("Table", "|a|b|\n|---|---|\n|1|2|", 1), chunks.Block("Text", sents(7), 2)]
    done = chunks.Packer(blocks, size, min(overlap, size - 1)).done
    assert done and all(c and any(b.content for b in c) for c in done)
    if not overlap:
        said = " ".join(b.content for c in done for b in c if b.kind == "Text")
        assert said.count("S") >= 27


def test_overlap_and_phantom_tokens():
    s = ["Saaaaaaaaaa1.", "Sbbbbbbbbbb2.", "Scccccccccc3.", "Sdddddddddd4."]
    got = chunks.Packer([chunks.Block("Text", " ".join(s), 1)], 8, 4).done
    assert [[b.content for b in c] for c in got] == [[f"{s[0]} {s[1]}"], [s[1], s[2]], [s[3]]]


def test_table_parts():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | {i} |" for i in range(100))
    parts = chunks.split_table(table, 64)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n| --- | --- |") and chunks.estimate(p) <= 64 for p in parts)
    assert parts[0].endswith("|...|...|") and parts[1].split("\n")[2] == "|...|...|" and not parts[-1].endswith("|...|...|")
    assert [r for p in parts for r in p.split("\n") if "row" in r] == table.split("\n")[2:]
    assert chunks.split_table(table, 2048) == [table]


def test_tables_keep_their_context():
    blocks = [chunks.Block("Text", sents(30), 1), chunks.Block("Header", "# Sales", 1), chunks.Block("Text", "In thousands", 1), chunks.Block("Table", "|a|\n|---|\n" + "|1|\n" * 40, 1)]
    last = chunks.Packer(blocks, 64, 0).done[-1]
    assert [b.content for b in last[:2]] == ["# Sales", "In thousands"] and last[2].kind == "Table"


def test_chunk_frames(spark):
    pages = spark.createDataFrame([("d", 1, "# T\ntext one.\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter", 42), ("d", 2, "![i](x.png)", None), ("e", 1, None, None)], "doc_id string, number int, content string, display_page int")
    blocks = chunks.text_blocks(pages, ["doc_id"])
    assert [(r["block_type"], r["page"]) for r in blocks.orderBy("seq").collect()] == [("Header", 1), ("Text", 1), ("Table", 1), ("Text", 1), ("Text", 2)]
    got = chunks.chunk_columns(chunks.chunk(blocks.union(blocks), ["doc_id"]), display=pages).collect()
    assert len(got) == 1 and got[0]["has_table"] and got[0]["has_image"] and got[0]["display_page_map"] == {1: 42} and (got[0]["start_page"], got[0]["end_page"]) == (1, 2)
    el = spark.createDataFrame([("d", 1, 0, "e1", "b", "paragraph", 5, ["t2"]), ("d", 1, 1, "e2", "a", "header", 0, None), ("d", 1, 2, "e3", None, "text", None, ["t1"])], "doc_id string, page int, seq int, id string, content string, kind string, start_offset int, tags array<string>")
    known = el.select("id", "kind", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "tags")
    made = chunks.chunk_columns(chunks.chunk(chunks.element_blocks(el, ["doc_id"]), ["doc_id"]), elements=known).first()
    assert made["content"] == "a\nb" and made["element_ids"] == ["e2", "e1"] and made["tags"] == ["t2"]
    assert chunks.chunk(blocks.limit(0), ["doc_id"]).collect() == []
    assert chunks.with_tag(el, "t1%").count() == 1


def test_many_elements_of_one_key(spark):
    n = 30_000
    el = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("seq"), F.col("id").cast("string").alias("id"), F.lit("x").alias("content"), F.lit("text").alias("kind"), F.col("id").cast("int").alias("start_offset"))
    assert chunks.element_blocks(el, ["doc_id"]).agg(F.count("*"), F.max("seq")).first()[:] == (n, n)


def test_pages_without_elements(spark):
    el = spark.createDataFrame([("d", 1, 0, "e1", "a", "text", 0)], "doc_id string, page int, seq int, id string, content string, kind string, start_offset int")
    pages = spark.createDataFrame([("d", 1, "own text"), ("d", 2, "# H\nx\n|a|"), ("d", 3, "|b|"), ("e", 1, "only text")], "doc_id string, number int, content string")
    got = [(r["doc_id"], r["seq"], r["block_type"], r["page"], r["content"], list(r["element_ids"])) for r in chunks.element_blocks(el, ["doc_id"], pages=pages).orderBy("doc_id", "seq").collect()]
    assert got == [("d", 1, "Text", 1, "a", ["e1"]), ("d", 2, "Header", 2, "# H", []), ("d", 3, "Text", 2, "x", []), ("d", 4, "Table", 2, "|a|", []), ("d", 5, "Table", 3, "|b|", []), ("e", 1, "Text", 1, "only text", [])]


def test_properties_of_chunks(spark):
    blocks = "array<struct<block_type:string,page:int,content:string>>"
    rows = spark.createDataFrame([("d", 0, None, [("Text", 3, "c"), ("Text", 1, "a"), ("Text", 1, " "), ("Text", 2, " ")], ["e1", "t:part-1", "none"]), ("e", 0, "H", [("Text", 1, "x")], [])], f"doc_id string, index int, header string, blocks {blocks}, element_ids array<string>")
    shown = spark.createDataFrame([("d", 1, 41), ("d", 2, 42), ("d", 4, 44), ("e", 9, 9)], "doc_id string, number int, display_page int")
    known = spark.createDataFrame([("e1", "image", 1, 2, ["x"]), ("t", "table", 3, 5, ["y"])], "id string, kind string, page_start int, page_end int, tags array<string>")
    got = {r["doc_id"]: r for r in chunks.chunk_columns(rows, display=shown, elements=known).collect()}
    d, e = got["d"], got["e"]
    assert d["display_page_map"] == {1: 41, 2: 42} and d["display_page_range"] is None and e["display_page_map"] is None
    assert (d["start_page"], d["end_page"], d["images"], d["has_image"], d["tags"]) == (1, 5, ["e1"], True, ["x"])
    assert (e["start_page"], e["end_page"], e["images"], e["has_image"], e["tags"]) == (1, 1, [], False, [])
    assert [tuple(x) for x in d["page_contents"]] == [(1, "a\n "), (3, "c")] and e["embedding_text"] == "H\n\n...\n\nx"
    assert chunks.chunk_json(rows).where(F.col("json").startswith('{"doc_id":')).count() == 2


def test_spans_and_located_elements(spark):
    rows = [(["ab", "cd"], "x ab y cd z", (2, 9)), (["cd", "ab"], "ab cd ab", (3, 8)), (["a  b(c)"], "zz a b(c) y", (3, 9)), (["no"], "text", None), ([" "], "text", None), (["cd", "ab"], "ab cd", (0, 5)), (None, "x", None), (["a"], None, None)]
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(rows)], "i int, c array<string>, t string")
    got = {r["i"]: tuple(r["s"]) if r["s"] else None for r in df.select("i", chunks.block_span(F.col("c"), F.col("t")).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_notes_in_chunks(spark):
    notes = spark.createDataFrame([("d", "N", ["b", "a", "none"]), ("d", "M", []), ("d", "O", None)], "doc_id string, name string, element_ids array<string>")
    el = spark.createDataFrame([("d", "a", 2, "second", "text", 0), ("d", "b", 1, "first", "text", 9), ("d", "b", 1, "first", "text", 9)], "doc_id string, id string, page_start int, content string, kind string, start_offset int")
    got = chunks.chunk_columns(chunks.chunk_notes(notes, el)).collect()
    assert [(r["name"], r["content"], r["start_page"], r["end_page"]) for r in got] == [("N", "first\nsecond", 1, 2)]


def test_blocks_of_one_text_are_those_of_a_page(spark):
    text = "# H\na\n| x |  y |\n|---|---|\n| 1 | 2 |\n\nb | c\n#d"
    pages = spark.createDataFrame([("d", 0, text)], "doc_id string, number int, content string")
    want = [(r["block_type"], r["content"]) for r in chunks.text_blocks(pages, ["doc_id"]).orderBy("seq").collect()]
    assert [(b.kind, b.content) for b in chunks.blocks_of(text)] == want


def test_guards(spark, monkeypatch):
    with pytest.raises(ValueError):
        render.table_markdown("<div>x</div>")
    assert render.table_markdown("<table><tr><td>a</td></tr></table>") == "a"
    from filingloom.plans import scratch

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
            master = "spark://h:7077"

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)
    with scratch.scope():
        kept = scratch.materialise(spark.range(3), "scoped")
        path = kept.inputFiles()[0]
        assert kept.count() == 3
    import os

    assert not os.path.exists(path.replace("file://", ""))


def test_highlighted_documents_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", "<body>x</body>"), ("b", "<p>y\nz</p>"), ("c", None)], "doc_id string, html string")
    ids = spark.createDataFrame([("a", "e1"), ("a", "e2")], "doc_id string, element_id string")
    annotate.write_highlighted(df, ids, str(tmp_path / "out"))
    got = {r["doc_id"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert set(got) == {"a", "b"} and "e2" in got["a"] and got["b"].strip() == "<p>y\nz</p>"


def test_section_by_part(spark):
    found = sections.sections(sections.section_pages(frame(spark, "10-K", ["PART I\nITEM 1. Business\nx\nITEM 1A. Risk Factors\ny"])))
    assert sections.get_section(found, part="part i").first()["item"] == "ITEM 1" and sections.get_section(found, part="PART II").count() == 0
    with pytest.raises(ValueError):
        sections.get_section(found)


# annotation, sources, SQL, streaming


def test_highlight(spark):
    def mark(html, ids):
        df = spark.createDataFrame([(html, ids)], "h string, i array<string>")
        return df.select(annotate.highlighted(F.col("h"), F.col("i"))).first()[0]

    assert mark("<html><head></head><body>x</body></html>", ["a"]).index("<style>") < mark("<html><head></head><body>x</body></html>", ["a"]).index("</head>")
    assert mark("<body class='k'>x", ["a"]).startswith("<body class='k'><style>") and mark("x", ["a"]).startswith("<style>")
    assert mark("x", []) == "x" and mark("x", None) == "x" and mark(None, ["a"]) is None


def test_annotated():
    out = annotate.annotated("<p>One &amp; two</p><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>")
    assert 'class="page-1"' in out and out.count("data-element=") == 2 and "One &amp; two" in out
    assert annotate.flatten_note("<table><tr><td>x</td></tr><tr><td>y</td></tr></table>") == "<td>x</td><td>y</td>"
    assert annotate.flatten_note("<p>x</p>") is None and annotate.flatten_note(None) is None


def test_images(spark):
    df = spark.createDataFrame([("d", '<img src="a.png"><img src="/b.gif"><img src="data:x"><img src="a.png">', "https://h.org/f/doc.htm"), ("e", None, None)], "doc_id string, html string, url string")
    assert {(r["src"], r["resolved"]) for r in annotate.image_refs(df).collect()} == {("a.png", "https://h.org/f/a.png"), ("/b.gif", "https://h.org/b.gif")}
    assets = spark.createDataFrame([("https://h.org/f/a.png", bytearray(b"123"))], "path string, content binary")
    got = {r["doc_id"]: r["html"] for r in annotate.embed_images(df, assets).collect()}
    assert got["d"].count("data:image/png;base64,MTIz") == 2 and "/b.gif" in got["d"] and got["e"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(b"<p>caf\xc3\xa9 \xff</p>")
    got = readers.files(spark, str(tmp_path)).first()
    assert got["html"] == "<p>café </p>" and got["doc_id"].endswith("a.htm")
    assert [one(spark, x, readers.kind_of) for x in ("https://a.b", "%PDF-", "<p>", None)] == ["url", "pdf", "html", None]
    with pytest.raises(ValueError):
        readers.http_get("https://www.sec.gov/x", None)

    class Fake(readers.HttpFilings):
        transport = staticmethod(lambda url, agent: f"<p>{url} {agent}</p>")

    spark.dataSource.register(Fake)
    rows = spark.read.format("filing_http").option("urls", "https://a.b/1\nhttps://a.b/2").option("userAgent", "me").load().collect()
    assert [r["html"] for r in rows] == ["<p>https://a.b/1 me</p>", "<p>https://a.b/2 me</p>"]
    assert one(spark, "a  b " * 100, lambda c: readers.preview(c, 7)) == "a b a b..."


def test_nest(spark):
    p = spark.createDataFrame([("a",), ("b",)], "k string")
    c = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "k string, n int, v string")
    got = {r["k"]: [x["v"] for x in r["rows"]] for r in readers.nest(p, c, ["k"], "rows", "n").collect()}
    assert got == {"a": ["x", "y"], "b": []}


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT html_to_markdown('<p>a</p><p>b</p>')").first()[0] == "a\n\nb"
    assert spark.sql("SELECT estimate_tokens('12345678'), split_sentences('A b. C d.')").first()[:] == (2, ["A b.", "C d."])
    assert spark.sql("SELECT chunk_text('One two. Three four.', 3, 0)").first()[0] == ["One two.", "Three four."]
    assert spark.sql("SELECT s.text FROM VALUES ('<p>x</p>') t(h), LATERAL parse_segments(h) s WHERE s.tag = 'p'").first()[0] == "x "
    assert spark.sql("SELECT count(*) FROM table_rows('<table><tr><td>1<td>2</table>')").first()[0] == 2


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/filings.parquet").write.parquet(source)
    stream = streaming.filings_stream(spark, source, spark.read.parquet(source).schema)
    q = streaming.write_pages(streaming.stream_pages(streaming.first_deliveries(stream)).drop("elements"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("doc_id", "number").distinct().count() > 10


def test_documents_of_a_small_table_are_parsed_in_many_tasks(spark):
    """A few bytes of a table make very many documents, which one task would parse one after the other."""
    made = shapes.q_element_merge(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= 4
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 0.5 * made.count()
