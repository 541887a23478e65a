"""Column functions over texts: cleaning, tokens, sentences, predicates on styles, numbers and addresses.

All stay in the JVM. A null input gives null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff",
}
NUMERIC = "^\\s*\\(?\\s*[-—–]?\\s*[$€£¥]?\\s*\\d+(?:,\\d{3})*(?:\\.\\d+)?\\s*%?\\s*\\)?\\s*$"


def stripped(text: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def clean_text(text: Column) -> Column:
    """Zero-width marks dropped, each run of white space one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\u200B\\uFEFF]", ""), "(?U)\\s+", " "))


def tokens(text: Column) -> Column:
    """Estimate: length in code points div 4, at least 1; null and empty texts count 1 as well."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("int"))


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space and a capital letter; trimmed, blanks dropped."""
    parts = F.split(text, "(?<=[.!?])\\s+(?=[A-Z])")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def is_numeric(text: Column) -> Column:
    """A whole cell that is one number, with sign, currency, thousands and per cent."""
    return text.rlike(NUMERIC)


def is_url(text: Column) -> Column:
    """An http(s) address with a host; false for null."""
    return F.coalesce(text.rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def is_regulator_url(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("sec.gov"), F.lit(False))


def is_pdf(text: Column) -> Column:
    """A document whose first characters, after white space, are those of a PDF file."""
    return F.coalesce(text.rlike("(?U)^\\s*+%PDF"), F.lit(False))


def decoded(raw: Column) -> Column:
    """Bytes read as UTF-8; those that aren't are dropped."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\\uFFFD", "")


def plausible_page(n: Column, least: int = 1) -> Column:
    """A page number rather than a year."""
    return n.between(least, 9999) & ~n.between(1900, 2100)


def mime_type(src: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    ext = F.lower(F.regexp_extract(src, "\\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.try_element_at(table, ext), F.lit("image/png"))


def element_id(prefix: str, page: Column, idx: Column, content: Column, kind: Column) -> Column:
    """Stable id: page, kind, position, and a hash of the content without regard to case and blanks."""
    norm = F.lower(F.regexp_replace(stripped(content), "(?U)\\s+", " "))
    letter = F.when(F.length(kind) > 0, F.substring(kind, 1, 1)).otherwise("b")
    return F.concat(F.lit(f"{prefix}-p"), page.cast("string"), F.lit("-"), letter, idx.cast("string"), F.lit("-"), F.substring(F.sha1(F.encode(norm, "UTF-8")), 1, 8))


def minify_table(table: Column) -> Column:
    """Cells trimmed, blank lines dropped, and the second line of the text replaced by a separator.

    The separator has a cell more than the line it replaces, and stays out if that line is blank: so it is defined.
    """

    def line(x: Column, i: Column) -> Column:
        parts = F.transform(F.split(x, "\\|"), lambda p: F.regexp_replace(stripped(p), "(?U)\\s+", " "))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size(parts) - 1), "|"), F.lit("|"))
        return F.when(stripped(x) == "", F.lit(None)).when(i == 1, rule).otherwise(F.array_join(parts, "|"))

    return F.array_join(F.transform(F.split(table, "\n"), line), "\n")


def embedding_text(header: Column, content: Column) -> Column:
    return F.when(F.length(header) > 0, F.concat(header, F.lit("\n\n...\n\n"), F.coalesce(content, F.lit("")))).otherwise(content)
