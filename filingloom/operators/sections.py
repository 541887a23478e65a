"""Sections of filings, in three forms: parts and items (10-K, 10-Q, 20-F), decimal items (8-K), plain items (SC 13D/G).

All are windows over the lines of a document: header lines are events, the running number of events is the section, and
state is carried by the last event. The three forms are marked in one pass over the same windows, so there is one scan, one
shuffle by document and one sort of its lines; nothing runs in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingloom.functions.text import tokens
from filingloom.plans import dimensions

STANDARD = ("10-K", "10-Q", "20-F")
FORMS = (*STANDARD, "8-K", "SC 13D", "SC 13G")
# What may stand before a header in its line, and the headers.
LEAD = "(?:\\*\\*|__)?\\s*(?:</?[^>]+>\\s*)*"
PART_LINE = f"(?i)^\\s*{LEAD}(PART\\s+[IVXLC]+)\\.?(?:\\*\\*|__)?(?:\\s|$)"
ITEM_LINE = f"(?i)^\\s*{LEAD}ITEM\\s+(\\d{{1,2}}[A-Z]?)\\.?[ \\t]*(?:[:.\\-–—][ \\t]*)?(.*)$"
ITEM_8K_LINE = f"(?i)^\\s*{LEAD}ITEM\\s+([1-9]\\.\\d{{2}}[A-Z]?)\\.?[ \\t]*(?:[:.\\-–—][ \\t]*)?(.*)$"
PAGE_LINE = "(?i)^\\s*Page\\s+\\d+\\s*(?:of\\s+\\d+)?\\s*$|^\\s*\\d+\\s*$"
FORM_LINE = "^\\s*(?:[A-Z][A-Za-z0-9 .,&\\-]+)?\\s*\\|\\s*\\d{4}\\s+Form\\s+10-[KQ]\\s*\\|\\s*\\d+\\s*$"
ITEM_LIST = "(?i)^[,\\s]*\\d{1,2}[A-Z]?(?:\\s*,\\s*\\d{1,2}[A-Z]?)*\\s*$"
STUB = 80


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def _edges(c: Column) -> Column:
    """Without bold marks at both ends."""
    return F.regexp_replace(c, "^\\s*(?:\\*\\*|__)\\s*|\\s*(?:\\*\\*|__)\\s*$", "")


def is_toc(content: Column, number: Column) -> Column:
    """A table of contents among the first five pages: item lines, dot leaders or rows of items."""
    rows = F.regexp_count(content, F.lit("(?i)\\|\\s*ITEM\\s+\\d{1,2}[A-Z]?\\.?\\s*\\|"))
    hits = (F.regexp_count(content, F.lit("(?im)^\\s*ITEM\\s+\\d{1,2}[A-Z]?\\.?\\b")) >= 3) | (F.regexp_count(content, F.lit("(?m)^.*\\.{3,}\\s*\\d{1,4}\\s*$")) >= 3) | (rows >= 3)
    return (number <= 5) & (hits | (content.rlike("(?i)TABLE\\s+OF\\s+CONTENTS") & (rows >= 2)))


def is_cover_8k(content: Column, number: Column) -> Column:
    """Page 1, a table of contents, rows of items with pages, or the page of signatures."""
    rows = F.regexp_count(content, F.lit("(?i)ITEM\\s+[1-9]\\.\\d{2}.*?\\|\\s*\\d+\\s*\\|"))
    signed = content.contains("**SIGNATURES**") & content.rlike("(?i)Pursuant to the requirements")
    return (number == 1) | content.rlike("(?i)TABLE OF CONTENTS") | (rows >= 2) | signed


def clean_lines(content: Column) -> Column:
    """Lines without page navigation: blanks unified, ends trimmed, form footers and bare page numbers dropped."""
    plain = F.regexp_replace(F.regexp_replace(content, "[\\u00A0\\u202F]", " "), "\\u200B", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, "(?U)\\s+$", ""))
    return F.transform(F.filter(lines, lambda x: ~(x.rlike(FORM_LINE) | x.rlike(PAGE_LINE))), _edges)


def infer_part(filing_type: Column, item: Column) -> Column:
    """The part of a 10-K's item, by its number."""
    n = F.nullif(F.regexp_extract(item, "ITEM\\s+(\\d{1,2})", 1), F.lit("")).cast("int")
    part = F.when(n.between(1, 4), "PART I").when(n.between(5, 9), "PART II").when(n.between(10, 14), "PART III").when(n.between(15, 16), "PART IV")
    return F.when(filing_type == "10-K", part)


def clean_title(title: Column) -> Column:
    t = F.regexp_replace(title, "^\\s*[:.\\-–—]\\s*", "")
    return F.nullif(_trim(F.regexp_replace(t, "(?U)\\s+", " ")), F.lit(""))


def item_code_8k(code: Column) -> Column:
    """``5.2`` as ``5.02``; a letter at the end stays."""
    c = F.upper(F.trim(code))
    padded = F.concat(F.regexp_extract(c, "^([1-9])\\.", 1), F.lit("."), F.lpad(F.regexp_extract(c, "\\.(\\d{1,2})", 1), 2, "0"), F.regexp_extract(c, "([A-Z]?)$", 1))
    return F.when(c.rlike("^[1-9]\\.\\d{1,2}[A-Z]?$"), padded).otherwise(c)


def _fragments(events: DataFrame) -> DataFrame:
    """Lines with the columns section, part, item, item_title: a row for each section and page, its lines joined.

    Lines before the first header belong to no section. Sections number the headers, so they may have gaps.
    """
    head = F.first(F.col("item_title"), ignorenulls=True)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    joined = events.where(F.col("section") > 0).groupBy("doc_id", "filing_type", "section", "number", "part", "item").agg(text.alias("content"), head.alias("item_title"))
    return joined.withColumn("content", _trim(F.col("content"))).where(F.col("content") != "")


def _doc():
    return W.partitionBy("doc_id").orderBy("number", "line_no")


def _page():
    return W.partitionBy("doc_id", "number").orderBy("line_no")


def _some(flag: Column, window) -> Column:
    return F.coalesce(F.max(F.when(flag, 1)).over(window), F.lit(0)) == 1


def _standard_heads(lines: DataFrame) -> DataFrame:
    """Lines with the columns part_here, head and gives_way, where the filing is of parts and items.

    A header is a PART line or an ITEM line with a title. A part that is the first header of its page and is followed by
    an item there gives way to it.
    """
    own = F.col("filing_type").isin(*STANDARD)
    before = F.concat_ws("\n", F.lag("line", 3).over(_doc()), F.lag("line", 2).over(_doc()), F.lag("line", 1).over(_doc()), F.lit(""))
    read = lines.withColumns({
        "part_here": F.when(own, F.upper(F.regexp_replace(F.nullif(F.regexp_extract("line", PART_LINE, 1), F.lit("")), "\\s+", " "))),
        "code": F.when(own, F.upper(F.regexp_extract("line", ITEM_LINE, 1))), "title": F.when(own, _trim(F.regexp_extract("line", ITEM_LINE, 2))),
        "inline": F.substring(before, -30, 30).rlike("(?i)\\bPart\\s+[IVXLC]+"),
    })
    code, title = F.col("code"), F.col("title")
    marked = read.withColumn("titled", F.when((code != "") & (title != "") & ~title.rlike(ITEM_LIST), F.struct("code", "title"))).drop("code", "title")
    # a reference just after a part's name only matters where no header of the page came before
    earlier = _page().rowsBetween(W.unboundedPreceding, -1)
    started = _some(F.col("part_here").isNotNull() | (F.col("titled").isNotNull() & ~F.col("inline")), earlier)
    seen = marked.withColumn("item_here", F.when(~F.col("inline") | started, F.col("titled")))
    event = F.col("part_here").isNotNull() | F.col("item_here").isNotNull()
    later = _some(F.col("item_here").isNotNull(), _page().rowsBetween(1, W.unboundedFollowing))
    return seen.withColumn("gives_way", F.col("part_here").isNotNull() & ~_some(event, earlier) & later).drop("titled", "inline")


def _numbered_heads(lines: DataFrame) -> DataFrame:
    """Lines with the column head, where the filing is of items alone; table rows are none.

    A sub-item ``n(a)`` of the current item is content; of another it opens that item.
    """
    kind, eight = F.col("filing_type"), F.col("filing_type") == "8-K"
    own = ~F.col("line").contains("|") & ~kind.isin(*STANDARD)
    read = lines.withColumns({
        "code": F.when(own & eight, F.regexp_extract("line", ITEM_8K_LINE, 1)).when(own, F.upper(F.regexp_extract("line", ITEM_LINE, 1))),
        "rest": F.when(own & eight, F.regexp_extract("line", ITEM_8K_LINE, 2)).when(own, F.regexp_extract("line", ITEM_LINE, 2)),
    })
    code, most = F.col("code"), F.when(kind == "SC 13G", 10).otherwise(7)
    valid = F.when(eight, code != "").otherwise(code.rlike("^([1-9]|10)$") & (F.try_to_number(code, F.lit("99")) <= most))
    found = F.when(valid, F.struct(F.when(eight, item_code_8k(code)).otherwise(code).alias("code"), F.nullif(_edges(_trim(F.col("rest"))), F.lit("")).alias("title")))
    before = F.last("found", ignorenulls=True).over(_doc().rowsBetween(W.unboundedPreceding, -1))["code"]
    sub = ~eight & F.coalesce(F.col("found.title").rlike("^\\([a-z]\\)") & (before == F.col("found.code")), F.lit(False))
    return read.withColumn("found", found).withColumn("numbered", F.when(~sub, F.col("found"))).drop("found", "code", "rest")


def section_pages(pages: DataFrame, desired: list[str] | None = None) -> DataFrame:
    """Fragments of sections of all forms: (doc_id, filing_type, section, part, item, item_title, number, content).

    ``pages``: (doc_id, filing_type, number, content); other filing types and null contents give none, extra columns are
    ignored. ``desired`` keeps some items of 8-K and SC 13D/G by code.

    10-K, 10-Q, 20-F: pages of a table of contents are skipped, the header stays in the content; sections without an item
    and of up to 80 characters are dropped, and so are those whose part and item the filing type doesn't have.
    8-K: covers and page 1 are skipped, so a filing of one page has no section; SC 13D (items 1-7) and SC 13G (1-10): all
    from the first SIGNATURE line on is cut off. In both the heading is not part of the content, and the title is that of
    the dimension where the heading gives none.
    """
    kind, content, number = F.col("filing_type"), F.col("content"), F.col("number")
    standard = kind.isin(*STANDARD)
    skipped = F.when(standard, is_toc(content, number)).when(kind == "8-K", is_cover_8k(content, number)).otherwise(False)
    own = pages.select("doc_id", "filing_type", number.cast("int").alias("number"), "content").where(kind.isin(*FORMS) & content.isNotNull() & ~skipped)
    lines = own.select("doc_id", "filing_type", "number", F.posexplode(F.when(standard, clean_lines(content)).otherwise(F.split(content, "\n"))).alias("line_no", "line"))
    signed = kind.isin("SC 13D", "SC 13G") & F.col("line").rlike("(?i)^\\s*(?:\\*\\*|__)?\\s*SIGNATURE")
    lines = lines.withColumn("ended", _some(signed, _doc())).where(~F.col("ended")).drop("ended")
    heads = _numbered_heads(_standard_heads(lines))
    event = F.col("part_here").isNotNull() | F.col("item_here").isNotNull() | F.col("numbered").isNotNull()
    now = F.struct(F.coalesce("item_here", "numbered").alias("head"), "gives_way")
    carried = heads.withColumn("event", event).withColumns({
        "section": F.sum(F.col("event").cast("int")).over(_doc()),
        "last_part": F.last("part_here", ignorenulls=True).over(_doc()),
        "now": F.last(F.when(F.col("event"), now), ignorenulls=True).over(_doc()),
    })
    code, title = F.col("now.head.code"), F.col("now.head.title")
    wanted = (F.col("now").isNotNull() & ~F.col("now.gives_way")) & (standard | ~F.col("event"))
    if desired:
        wanted = wanted & (standard | code.isin(*desired))
    item = F.concat(F.lit("ITEM "), code)
    held = carried.where(wanted).select(
        "doc_id", "filing_type", "number", "line_no", "line", "section", F.when(standard, F.coalesce(infer_part(kind, item), F.col("last_part"))).alias("part"),
        item.alias("item"), F.when(standard, clean_title(title)).otherwise(title).alias("item_title"),
    )
    fragments = _fragments(held)
    size = F.sum(F.length("content")).over(W.partitionBy("doc_id", "section"))
    kept = fragments.withColumn("size", size).where(~standard | F.col("item").isNotNull() | (F.col("size") > STUB)).drop("size")
    dim = F.broadcast(dimensions.section_titles(pages.sparkSession)).alias("dim")  # a literal of fewer than 200 rows
    same = (F.col("kept.filing_type") == F.col("dim.filing_type")) & F.col("kept.part").eqNullSafe(F.col("dim.part")) & F.col("kept.item").eqNullSafe(F.col("dim.item"))
    known = kept.alias("kept").join(dim, same, "left").where(~F.col("kept.filing_type").isin(*STANDARD) | F.col("dim.filing_type").isNotNull())
    return known.select(*[f"kept.{c}" for c in ("doc_id", "filing_type", "section", "part", "item")], F.coalesce("kept.item_title", "dim.title").alias("item_title"), "kept.number", "kept.content")


def fragments_8k(pages: DataFrame, desired: list[str] | None = None) -> DataFrame:
    """Those of 8-K filings."""
    return section_pages(pages.where(F.col("filing_type") == "8-K"), desired)


def fragments_13d(pages: DataFrame, desired: list[str] | None = None) -> DataFrame:
    """Those of SC 13D and SC 13G filings."""
    return section_pages(pages.where(F.col("filing_type").isin("SC 13D", "SC 13G")), desired)


def sections(fragments: DataFrame) -> DataFrame:
    """(doc_id, filing_type, section, part, item, item_title, start_page, end_page, tokens)"""
    return fragments.groupBy("doc_id", "filing_type", "section", "part", "item").agg(
        F.first("item_title", ignorenulls=True).alias("item_title"), F.min("number").alias("start_page"), F.max("number").alias("end_page"), F.sum(tokens(F.col("content"))).alias("tokens")
    )


def section_markdown(fragments: DataFrame, rule: bool = False) -> DataFrame:
    """(doc_id, section, markdown): the pages of each section, joined by an empty line or by a rule."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("number", "content"))), lambda x: x["content"])
    return fragments.groupBy("doc_id", "section").agg(F.array_join(text, "\n\n---\n\n" if rule else "\n\n").alias("markdown"))


def get_section(found: DataFrame, item: str | None = None, part: str | None = None) -> DataFrame:
    """The first section of each document with an item, given as ``ITEM 1A`` or ``1A`` in any case, with a part, or both.

    None if there is none.
    """
    if not isinstance(item, str) and (item is not None or part is None):
        raise ValueError("an item is a text such as 'ITEM 1A'")
    own = found
    if item is not None:
        name = " ".join(item.upper().split())
        own = own.where(F.col("item") == (name if name.startswith("ITEM ") else f"ITEM {name}"))
    if part is not None:
        own = own.where(F.col("part") == " ".join(part.upper().split()))
    return own.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("section"))).where("r = 1").drop("r")


def get_named(found: DataFrame, filing_type: str, name: str) -> DataFrame:
    """The first section of an item by its name in the dimension, such as ``RISK_FACTORS``; unknown names are an error."""
    rows = [r for r in dimensions.filing_items(found.sparkSession).where((F.col("filing_type") == filing_type) & (F.col("enum_name") == name)).collect()]
    if not rows:
        raise ValueError(f"{filing_type} has no item {name}")
    return get_section(found.where(F.col("filing_type") == filing_type), rows[0]["item"], rows[0]["part"])


# Where exhibits begin, and their rows with pipes, with wide blanks, and of HTML; the first form that gives any counts.
EXHIBITS_LINE = "(?is)^.*?(?m:^\\s*\\(?d\\)?\\s*Exhibits\\b[^\\n]*$)(.*)$"
EXHIBIT_ROWS = (
    "(?m)^\\s*\\|?\\s*([0-9]{1,4}(?:\\.[0-9A-Za-z]+)?)\\s*\\|\\s*(.+?)\\s*\\|?\\s*$",
    "(?m)^\\s*([0-9]{1,4}(?:\\.[0-9A-Za-z]+)?)\\s{2,}(.+?)\\s*$",
    "(?is)<tr[^>]*>\\s*<t[dh][^>]*>\\s*([^<]+?)\\s*</t[dh]>\\s*<t[dh][^>]*>\\s*([^<]+?)\\s*</t[dh]>\\s*</tr>",
)


def exhibit_rows(text: str) -> list[tuple[str, str]]:
    """(exhibit_no, description) of one text, as :func:`exhibits`."""
    m = re.search(EXHIBITS_LINE, text)
    block = m[1] if m and m[1] else text
    for pattern in EXHIBIT_ROWS:
        rows = [(a.strip(), b.strip()) for a, b in re.findall(pattern, block)]
        if rows := [(a, b) for a, b in rows if a[:1].isdigit() and not b.startswith("---")]:
            return rows
    return []


def exhibits(fragments: DataFrame) -> DataFrame:
    """(doc_id, section, exhibit_no, description) of 8-K items 9.01: rows with pipes, else with wide blanks, else of HTML."""
    whole = section_markdown_plain(fragments.where((F.col("filing_type") == "8-K") & F.col("item").startswith("ITEM 9.01")))
    block = F.coalesce(F.nullif(F.regexp_extract("text", EXHIBITS_LINE, 1), F.lit("")), F.col("text"))
    found = []
    for pattern in EXHIBIT_ROWS:
        rows = F.arrays_zip(F.regexp_extract_all("block", F.lit(pattern), F.lit(1)).alias("exhibit_no"), F.regexp_extract_all("block", F.lit(pattern), F.lit(2)).alias("description"))
        rows = F.transform(rows, lambda x: F.struct(_trim(x["exhibit_no"]).alias("exhibit_no"), _trim(x["description"]).alias("description")))
        rows = F.filter(rows, lambda x: x["exhibit_no"].rlike("^\\d") & ~x["description"].startswith("---"))
        found.append(F.when(F.size(rows) > 0, rows))
    listed = whole.select("doc_id", "section", block.alias("block")).select("doc_id", "section", F.explode(F.coalesce(*found)).alias("e"))
    return listed.select("doc_id", "section", "e.exhibit_no", "e.description")


def section_markdown_plain(fragments: DataFrame) -> DataFrame:
    text = F.transform(F.sort_array(F.collect_list(F.struct("number", "content"))), lambda x: x["content"])
    return fragments.groupBy("doc_id", "section").agg(F.array_join(text, "\n").alias("text"))
