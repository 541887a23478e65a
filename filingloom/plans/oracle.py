"""SQL of the queries that SQL can express, written for another engine and independently of the operators."""

from __future__ import annotations

from filingloom.plans import dimensions, shapes

WS = "[\\t\\n\\x0b\\x0c\\r\\x{85}\\p{Z}]"
PAGES = "(SELECT DISTINCT doc_id, number, content FROM doc_pages)"
TYPED = f"(SELECT p.*, t.filing_type FROM {PAGES} p JOIN (SELECT DISTINCT doc_id, filing_type FROM filings) t USING (doc_id))"
NUMERIC = "^[\\t\\n\\x0b\\x0c\\r ]*\\(?[\\t\\n\\x0b\\x0c\\r ]*[-—–]?[\\t\\n\\x0b\\x0c\\r ]*[$€£¥]?[\\t\\n\\x0b\\x0c\\r ]*[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?[\\t\\n\\x0b\\x0c\\r ]*%?[\\t\\n\\x0b\\x0c\\r ]*\\)?[\\t\\n\\x0b\\x0c\\r ]*$"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_TOC_ROWS = _count("content", "(?i)\\|\\s*ITEM\\s+\\d{1,2}[A-Z]?\\.?\\s*\\|")
TOC = f"""(number <= 5 AND ({_count("content", "(?im)^\\s*ITEM\\s+\\d{1,2}[A-Z]?\\.?\\b")} >= 3 OR {_count("content", "(?m)^.*\\.{3,}\\s*\\d{1,4}\\s*$")} >= 3
  OR {_TOC_ROWS} >= 3 OR (regexp_matches(content, '(?i)TABLE\\s+OF\\s+CONTENTS') AND {_TOC_ROWS} >= 2)))"""

_LEAD = "(?:\\*\\*|__)?\\s*(?:</?[^>]+>\\s*)*"
_EDGE = "'^\\s*(?:\\*\\*|__)\\s*|\\s*(?:\\*\\*|__)\\s*$', '', 'g'"
# The items of each part, stated here once more so that the check doesn't rest on the operator's own.
_PARTS = """('10-K', 'PART I', '1,1A,1B,1C,2,3,4'), ('10-K', 'PART II', '5,6,7,7A,8,9,9A,9B,9C'), ('10-K', 'PART III', '10,11,12,13,14'), ('10-K', 'PART IV', '15,16'),
  ('10-Q', 'PART I', '1,2,3,4'), ('10-Q', 'PART II', '1,1A,2,3,4,5,6'), ('20-F', 'PART I', '1,2,3,4,4A,5,6,7,8,9,10,11,12,12D'),
  ('20-F', 'PART II', '13,14,15,16,16A,16B,16C,16D,16E,16F,16G,16H,16I'), ('20-F', 'PART III', '17,18,19')"""
_STRUCTURE = f"(SELECT t, p, 'ITEM ' || unnest(string_split(l, ',')) AS i FROM (VALUES {_PARTS}) v(t, p, l))"
_TITLES = ", ".join("('{}', '{}', '{}')".format(t, c, n.replace("'", "''")) for t, c, n in dimensions.title_rows())
_INLINE = "regexp_matches(right(concat_ws(chr(10), lag(line, 3) OVER w, lag(line, 2) OVER w, lag(line, 1) OVER w, ''), 30), '(?i)\\bPart\\s+[IVXLC]+')"

STANDARD = f"""
lines AS (
  SELECT doc_id, filing_type, number, i AS line_no, regexp_replace(rtrim(l, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)), {_EDGE}) AS line
  FROM (SELECT *, unnest(string_split(replace(replace(replace(content, chr(160), ' '), chr(8239), ' '), chr(8203), ''), chr(10))) AS l,
          generate_subscripts(string_split(content, chr(10)), 1) AS i
        FROM {TYPED} WHERE filing_type IN ('10-K', '10-Q', '20-F') AND content IS NOT NULL AND NOT {TOC})
  WHERE NOT regexp_matches(l, '(?i)^\\s*Page\\s+\\d+\\s*(?:of\\s+\\d+)?\\s*$|^\\s*\\d+\\s*$')
    AND NOT regexp_matches(l, '^\\s*(?:[A-Z][A-Za-z0-9 .,&\\-]+)?\\s*\\|\\s*\\d{{4}}\\s+Form\\s+10-[KQ]\\s*\\|\\s*\\d+\\s*$')),
marked AS (
  SELECT *, nullif(upper(regexp_replace(regexp_extract(line, '(?i)^\\s*{_LEAD}(PART\\s+[IVXLC]+)(?:\\.?(?:\\*\\*|__)?(?:\\s|$))', 1), '\\s+', ' ', 'g')), '') AS part_here,
    regexp_extract(line, '(?i)^\\s*{_LEAD}ITEM\\s+(\\d{{1,2}}[A-Z]?)\\.?[ \\t]*(?:[:.\\-–—][ \\t]*)?(.*)$', 1) AS code,
    {_strip(f"regexp_extract(line, '(?i)^\\s*{_LEAD}ITEM\\s+(\\d{{1,2}}[A-Z]?)\\.?[ \\t]*(?:[:.\\-–—][ \\t]*)?(.*)$', 2)")} AS ttl,
    {_INLINE} AS inl
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY number, line_no)),
titled AS (
  SELECT *, CASE WHEN code <> '' AND ttl <> '' AND NOT regexp_matches(ttl, '(?i)^[,\\s]*\\d{{1,2}}[A-Z]?(\\s*,\\s*\\d{{1,2}}[A-Z]?)*\\s*$') THEN 'ITEM ' || upper(code) END AS t0 FROM marked),
seen AS (
  SELECT *, CASE WHEN t0 IS NOT NULL AND (NOT inl OR coalesce(max(CASE WHEN part_here IS NOT NULL OR (t0 IS NOT NULL AND NOT inl) THEN 1 END)
      OVER (PARTITION BY doc_id, number ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) THEN t0 END AS item_here FROM titled),
ev AS (
  SELECT *, CASE WHEN part_here IS NOT NULL OR item_here IS NOT NULL THEN 1 ELSE 0 END AS e FROM seen),
ev2 AS (
  SELECT *, part_here IS NOT NULL AND coalesce(sum(e) OVER (PARTITION BY doc_id, number ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
      AND coalesce(max(CASE WHEN item_here IS NOT NULL THEN 1 END) OVER (PARTITION BY doc_id, number ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS gives FROM ev),
numbered AS (
  SELECT *, sum(e) OVER (PARTITION BY doc_id ORDER BY number, line_no ROWS UNBOUNDED PRECEDING) AS section,
    last_value(part_here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY number, line_no ROWS UNBOUNDED PRECEDING) AS part0 FROM ev2),
heads AS (SELECT doc_id, section, item_here AS item, ttl, gives FROM numbered WHERE e = 1),
frag AS (
  SELECT n.doc_id, n.filing_type, n.section, n.number, h.item, any_value(n.part0) AS part0, any_value(h.ttl) AS ttl,
    {_strip("string_agg(n.line, chr(10) ORDER BY n.line_no)")} AS content
  FROM numbered n JOIN heads h ON h.doc_id = n.doc_id AND h.section = n.section AND NOT h.gives
  GROUP BY n.doc_id, n.filing_type, n.section, n.number, h.item),
parted AS (
  SELECT *, CASE WHEN filing_type = '10-K' AND item IS NOT NULL AND try_cast(regexp_extract(item, '\\d+') AS INT) BETWEEN 1 AND 16
      THEN CASE WHEN regexp_extract(item, '\\d+')::INT <= 4 THEN 'PART I' WHEN regexp_extract(item, '\\d+')::INT <= 9 THEN 'PART II' WHEN regexp_extract(item, '\\d+')::INT <= 14 THEN 'PART III' ELSE 'PART IV' END
      ELSE part0 END AS part, sum(length(content)) OVER (PARTITION BY doc_id, section) AS size FROM frag WHERE content <> ''),
sect AS (
  SELECT p.doc_id, p.filing_type, p.section::BIGINT AS section, p.part, p.item,
    CASE WHEN p.item IS NOT NULL THEN nullif({_strip("regexp_replace(regexp_replace(any_value(p.ttl), '^\\s*[:.\\-–—]\\s*', ''), '" + WS + "+', ' ', 'g')")}, '') END AS item_title,
    min(p.number)::BIGINT AS start_page, max(p.number)::BIGINT AS end_page, sum(greatest(1, length(p.content) // 4))::BIGINT AS tokens
  FROM parted p
  WHERE (p.item IS NOT NULL OR p.size > 80) AND EXISTS (SELECT 1 FROM {_STRUCTURE} s WHERE s.t = p.filing_type AND s.p = p.part AND (p.item IS NULL OR s.i = p.item))
  GROUP BY p.doc_id, p.filing_type, p.section, p.part, p.item)"""

_BODY = f"unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {TYPED}"


def _items(name: str, source: str, pattern: str, condition: str, title_type: str) -> str:
    """Sections whose headings are items without parts."""
    return f"""
{name}_lines AS ({source}),
{name}_marked AS (SELECT *, upper(regexp_extract(line, '{pattern}', 1)) AS code, {_strip(f"regexp_extract(line, '{pattern}', 2)")} AS t0 FROM {name}_lines),
{name}_heads AS (SELECT *, regexp_replace(t0, {_EDGE}) AS ttl, (code <> '' AND NOT contains(line, '|') AND {condition}) AS ok FROM {name}_marked),
{name}_sub AS (SELECT *, ok AND NOT coalesce(regexp_matches(ttl, '^\\([a-z]\\)') AND '{name}' = 'd13' AND
    last_value(CASE WHEN ok THEN code END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = code, false) AS e FROM {name}_heads),
{name}_num AS (SELECT *, sum(e::INT) OVER (PARTITION BY doc_id ORDER BY number, line_no ROWS UNBOUNDED PRECEDING) AS section FROM {name}_sub),
{name}_frag AS (SELECT n.doc_id, n.filing_type, n.section, n.number, h.code, h.ttl, {_strip("string_agg(n.line, chr(10) ORDER BY n.line_no)")} AS content
  FROM {name}_num n JOIN (SELECT doc_id, section, code, ttl FROM {name}_num WHERE e) h USING (doc_id, section) WHERE NOT n.e GROUP BY ALL),
{name}_sect AS (SELECT f.doc_id, f.filing_type, f.section::BIGINT AS section, NULL::VARCHAR AS part, 'ITEM ' || f.code AS item, coalesce(nullif(f.ttl, ''), t.n) AS item_title,
    min(number)::BIGINT AS start_page, max(number)::BIGINT AS end_page, sum(greatest(1, length(content) // 4))::BIGINT AS tokens
  FROM {name}_frag f LEFT JOIN (VALUES {_TITLES}) t(t, c, n) ON t.t = {title_type} AND t.c = f.code WHERE content <> '' GROUP BY ALL)"""


_COVER = f"""(number = 1 OR regexp_matches(content, '(?i)TABLE OF CONTENTS') OR {_count("content", "(?i)ITEM\\s+[1-9]\\.\\d{2}.*?\\|\\s*\\d+\\s*\\|")} >= 2
  OR (contains(content, '**SIGNATURES**') AND regexp_matches(content, '(?i)Pursuant to the requirements')))"""
EIGHT = _items("k8", f"SELECT doc_id, filing_type, number, {_BODY} WHERE filing_type = '8-K' AND content IS NOT NULL AND NOT {_COVER}", f"(?i)^\\s*{_LEAD}ITEM\\s+([1-9]\\.\\d{{2}}[A-Z]?)\\.?[ \\t]*(?:[:.\\-–—][ \\t]*)?(.*)$", "true", "'8-K'")
THIRTEEN = _items(
    "d13",
    f"""SELECT * FROM (SELECT *, max(regexp_matches(line, '(?i)^\\s*(?:\\*\\*|__)?\\s*SIGNATURE')::INT) OVER (PARTITION BY doc_id ORDER BY number, line_no ROWS UNBOUNDED PRECEDING) AS stop
      FROM (SELECT doc_id, filing_type, number, {_BODY} WHERE filing_type IN ('SC 13D', 'SC 13G') AND content IS NOT NULL)) WHERE stop = 0""",
    f"(?i)^\\s*{_LEAD}ITEM\\s+(\\d{{1,2}}[A-Z]?)\\.?[ \\t]*(?:[:.\\-–—][ \\t]*)?(.*)$",
    "regexp_full_match(code, '[1-9]|10') AND try_cast(code AS INT) <= CASE WHEN filing_type = 'SC 13G' THEN 10 ELSE 7 END",
    "f.filing_type",
)
ALL = f"WITH {STANDARD}, {EIGHT}, {THIRTEEN}, allsect AS (SELECT * FROM sect UNION ALL SELECT * FROM k8_sect UNION ALL SELECT * FROM d13_sect)"


def _candidate() -> str:
    line = "trim(x)"
    tries = [("^(\\d{1,4})$", 10), ("(?i)\\bPage\\s+(\\d{1,4})\\b", 1), ("\\b(\\d{1,4})\\s*\\|", 1), ("\\|\\s*(\\d{1,4})\\b", 1)]
    def n(p):
        return f"try_cast(nullif(regexp_extract({line}, '{p}', 1), '') AS INT)"

    parts = ", ".join(f"CASE WHEN {n(p)} BETWEEN {least} AND 9999 AND {n(p)} NOT BETWEEN 1900 AND 2100 THEN {n(p)} END" for p, least in tries)
    near = "CASE WHEN len(ls) >= 3 THEN list_concat(ls[1:3], ls[-3:]) ELSE ls END"
    return f"(list_filter(list_transform({near}, lambda x: CASE WHEN length({line}) <= 100 THEN coalesce({parts}) END), lambda c: c IS NOT NULL))[1]::BIGINT"


CANDIDATES = f"SELECT doc_id, number, {_candidate()} AS candidate FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {PAGES})"

_PARSED = f"""(SELECT doc_id, html, '**' || trim(regexp_replace(b, '{WS}+', ' ', 'g')) || '**' || chr(10) || chr(10) || trim(regexp_replace(p, '{WS}+', ' ', 'g')) AS content
  FROM (SELECT doc_id, h AS html, regexp_extract(h, '<b>(.*?)</b>', 1) AS b, regexp_extract(h, '<br><p>(.*?)(</body>|$)', 1) AS p
    FROM (SELECT doc_id, arg_max({{'h': html}}, loaded_at).h AS h FROM filings GROUP BY doc_id) WHERE h IS NOT NULL))"""

ORACLE = {
    "q_parsed_pages": f"SELECT doc_id, 1 AS number, content, NULL::INT AS display_page FROM {_PARSED}",
    "q_markdown": f"SELECT doc_id, content AS markdown FROM {_PARSED}",
    "q_parsed_elements": f"""SELECT doc_id, 1 AS page, 0 AS seq, 'fl-p1-t0-' || substr(sha1(lower(regexp_replace(content, '{WS}+', ' ', 'g'))), 1, 8) AS id, 'text' AS kind, content,
      0 AS start_offset, length(content)::INT AS end_offset, length(content)::INT AS char_count FROM {_PARSED}""",
    "q_retention": f"SELECT doc_id, length(html)::BIGINT AS input_chars, length(content)::BIGINT AS output_chars, length(content) / length(html) AS retention FROM {_PARSED}",
    "q_highlight": f"""SELECT doc_id, (length(html) + length('<style>[data-element="' || doc_id || '"], [id="' || doc_id || '"] {{ background-color: #ffe58f; outline: 2px solid #d48806; }}</style>')
      + length('<script>document.querySelector(' || chr(39) || '[data-element="' || doc_id || '"], [id="' || doc_id || '"]' || chr(39) || ').scrollIntoView();</script>'))::BIGINT AS chars, true AS in_order FROM {_PARSED}""",
    "q_clean_text": f"SELECT id, trim(regexp_replace(regexp_replace(content, '[\\x{{200B}}\\x{{FEFF}}]', '', 'g'), '{WS}+', ' ', 'g')) AS cleaned FROM (SELECT DISTINCT id, content FROM elements)",
    "q_token_estimate": "SELECT id, greatest(1, coalesce(length(content), 0) // 4)::BIGINT AS tokens FROM (SELECT DISTINCT id, content FROM elements)",
    "q_sentences": f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS pos, s AS sentence FROM (
      SELECT doc_id, i, {_strip("p")} AS s FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL))) WHERE s <> ''""",
    "q_page_tokens": f"SELECT site, count(*) AS pages, sum(greatest(1, coalesce(length(content), 0) // 4))::BIGINT AS tokens FROM {PAGES} JOIN (SELECT DISTINCT doc_id, site FROM filings) USING (doc_id) GROUP BY site",
    "q_block_types": f"""SELECT doc_id, block_type, count(*) AS blocks FROM (
      SELECT doc_id, t AS block_type, t <> 'Table' OR coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY number, i), '') <> 'Table' AS starts FROM (
        SELECT doc_id, number, i, CASE WHEN starts_with(line, '#') THEN 'Header' WHEN contains(line, '|') THEN 'Table' ELSE 'Text' END AS t FROM (
          SELECT doc_id, number, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {PAGES}))) WHERE starts GROUP BY doc_id, block_type""",
    "q_table_minify": f"""SELECT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN {_strip("x")} = '' THEN NULL
      WHEN i = 2 THEN '|' || array_to_string(list_transform(range(len(string_split(x, '|')) - 1), lambda k: '---'), '|') || '|'
      ELSE array_to_string(list_transform(string_split(x, '|'), lambda p: regexp_replace({_strip("p")}, '{WS}+', ' ', 'g')), '|') END), lambda y: y IS NOT NULL), chr(10)) AS minified
      FROM (SELECT DISTINCT id, content FROM elements WHERE kind = 'table' AND content IS NOT NULL)""",
    "q_element_id": f"SELECT id, 'fl-p' || page || '-' || kind[1] || seq || '-' || substr(sha1(lower(regexp_replace({_strip('content')}, '{WS}+', ' ', 'g'))), 1, 8) AS made FROM (SELECT DISTINCT id, page, seq, content, kind FROM elements)",
    "q_numeric_cells": f"SELECT id, count(*) AS cells, count(CASE WHEN regexp_matches(cell, '{NUMERIC}') THEN 1 END) AS numeric_cells FROM (SELECT id, unnest(string_split(replace(content, chr(10), '|'), '|')) AS cell FROM (SELECT DISTINCT id, kind, content FROM elements WHERE kind = 'table' AND content IS NOT NULL)) GROUP BY id",
    "q_url_parts": "SELECT DISTINCT doc_id, url, coalesce(regexp_matches(url, '(?i)^https?://[^/?#]+'), false) AS is_url, coalesce(contains(lower(url), 'sec.gov'), false) AS is_regulator FROM filings",
    "q_pdf_guard": "SELECT DISTINCT doc_id, right(doc_id, 1) = '7' AS is_pdf FROM filings WHERE doc_id IS NOT NULL",
    "q_latest_filings": "SELECT doc_id, r.filing_type, r.site, r.cik, r.loaded_at FROM (SELECT doc_id, arg_max({'filing_type': filing_type, 'site': site, 'cik': cik, 'loaded_at': loaded_at}, loaded_at) AS r FROM filings WHERE doc_id IS NOT NULL GROUP BY doc_id)",
    "q_html_headings": "SELECT doc_id, trim(regexp_extract(h, '<b>(.*?)</?b', 1)) AS heading FROM (SELECT doc_id, arg_max({'h': html}, loaded_at).h AS h FROM filings GROUP BY doc_id) WHERE h IS NOT NULL",
    "q_table_md": "SELECT n_regionkey::VARCHAR AS doc_id, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey",
    "q_money_columns": "SELECT s_suppkey::VARCHAR AS doc_id, '| Name |  |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_name || ' | $ ' || floor(s_acctbal)::BIGINT || ' |' || chr(10) || '| Total | $ ' || floor(s_acctbal)::BIGINT || ' |' AS content FROM supplier",
    "q_page_breaks": "SELECT doc_id::VARCHAR AS doc_id, n AS number, CASE n WHEN 1 THEN item_id WHEN 2 THEN 'mid' ELSE 'end' END AS content FROM documents, (VALUES (1), (2), (3)) v(n) WHERE item_id IS NOT NULL",
    "q_toc": f"SELECT doc_id, number, coalesce({TOC}, false) AS is_toc FROM {TYPED}",
    "q_display_candidates": CANDIDATES,
    "q_display_pages": f"""WITH c AS ({CANDIDATES}), s AS (SELECT *, candidate - last_value(candidate IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM c),
      v AS (SELECT doc_id, count(candidate) >= 5 AND sum(CASE WHEN step = 1 THEN 2 WHEN step > 1 THEN 1 ELSE 0 END) >= 0.8 * count(step) AS ok, list(candidate ORDER BY number) AS l FROM s GROUP BY doc_id)
      SELECT c.doc_id, c.number, CASE WHEN v.ok THEN v.l[c.number] END AS display_page FROM c JOIN v USING (doc_id)""",
    "q_sections": f"{ALL} SELECT doc_id, filing_type, part, item, item_title, section, start_page, end_page, tokens FROM allsect",
    "q_section_pages": f"""{ALL}, kept AS (SELECT doc_id, section::BIGINT AS section FROM allsect)
      SELECT doc_id, section, number, content FROM (SELECT doc_id, section::BIGINT AS section, number, content FROM parted UNION ALL SELECT doc_id, section::BIGINT, number, content FROM k8_frag WHERE content <> ''
        UNION ALL SELECT doc_id, section::BIGINT, number, content FROM d13_frag WHERE content <> '') SEMI JOIN kept USING (doc_id, section)""",
    "q_section_8k": f"WITH {EIGHT} SELECT doc_id, item, item_title, start_page FROM k8_sect",
    "q_section_13d": f"WITH {THIRTEEN} SELECT doc_id, item, item_title, start_page FROM d13_sect",
    "q_get_section": f"{ALL} SELECT doc_id, item, arg_min(item_title, section) AS item_title FROM allsect WHERE item = 'ITEM 2' GROUP BY doc_id, item",
    "q_section_stats": f"{ALL} SELECT filing_type, part, item, count(*) AS sections, sum(tokens)::BIGINT AS tokens FROM allsect GROUP BY filing_type, part, item",
    "q_structure_dimension": f"SELECT t AS filing_type, p AS part, i AS item FROM {_STRUCTURE}",
    "q_xbrl_tags": "SELECT DISTINCT id, unnest(tags) AS tag FROM elements",
    "q_tag_filter": "SELECT DISTINCT id FROM (SELECT id, tags, unnest(tags) AS t FROM (SELECT DISTINCT id, tags FROM elements)) WHERE t LIKE 'inv:%Text%'",
    "q_merge_notes": "SELECT doc_id, tags[1] AS name, min(page)::BIGINT AS start_page, max(page)::BIGINT AS end_page, count(DISTINCT page) AS pages, count(*) AS elements FROM (SELECT DISTINCT doc_id, page, seq, id, tags FROM elements WHERE page IS NOT NULL) WHERE tags[1] IS NOT NULL GROUP BY doc_id, tags[1]",
    "q_chunk_flags": """SELECT chunk_id, array_to_string(list_transform(bl, lambda b: b.content), chr(10)) AS content, coalesce(list_sum(list_transform(bl, lambda b: greatest(1, length(b.content) // 4))), 0)::BIGINT AS num_tokens,
      len(list_filter(bl, lambda b: b.block_type = 'Table')) > 0 AS has_table, list_min(list_transform(bl, lambda b: b.page))::BIGINT AS start_page, list_max(list_transform(bl, lambda b: b.page))::BIGINT AS end_page
      FROM (SELECT DISTINCT chunk_id, header, list_filter(blocks, lambda b: b.content IS NOT NULL) AS bl FROM chunks WHERE blocks IS NOT NULL)""",
    "q_embedding_text": "SELECT chunk_id, CASE WHEN length(header) > 0 THEN header || chr(10) || chr(10) || '...' || chr(10) || chr(10) || coalesce(content, '') ELSE content END AS embedding_text FROM (SELECT DISTINCT chunk_id, header, content FROM chunks)",
    "q_chunk_vectors": "SELECT chunk_id, len(embedding)::BIGINT AS dims, round(embedding[1]::DOUBLE, 5) AS v0 FROM (SELECT DISTINCT chunk_id, index::BIGINT AS vec_id FROM chunks) LEFT JOIN embeddings USING (vec_id)",
    "q_chunk_elements_of": "SELECT chunk_id, count(*) AS elements, count(CASE WHEN kind = 'table' THEN 1 END) AS tables FROM (SELECT DISTINCT chunk_id, unnest(element_ids) AS id FROM chunks) JOIN (SELECT DISTINCT id, kind FROM elements) USING (id) GROUP BY chunk_id",
    "q_element_offsets": f"SELECT id, substr(p.content, start_offset + 1, end_offset - start_offset) = e.content AS matches FROM (SELECT DISTINCT id, doc_id, page, content, start_offset, end_offset FROM elements WHERE start_offset IS NOT NULL AND end_offset IS NOT NULL AND content IS NOT NULL) e JOIN {PAGES} p ON p.doc_id = e.doc_id AND p.number = e.page",
    "q_corpus_report": "SELECT filing_type, site, count(*) AS docs, count(DISTINCT cik) AS filers, grouping_id(filing_type, site)::BIGINT AS level FROM (SELECT doc_id, r.filing_type AS filing_type, r.site AS site, r.cik AS cik FROM (SELECT doc_id, arg_max({'filing_type': filing_type, 'site': site, 'cik': cik}, loaded_at) AS r FROM filings WHERE doc_id IS NOT NULL GROUP BY doc_id)) GROUP BY ROLLUP (filing_type, site)",
}
ORACLE |= shapes.ORACLE | {"q_streamed_pages": f"SELECT doc_id, 1 AS number, content FROM {_PARSED}"}
