"""Problem 5: lines repeated across one site's documents.

The documents that hold a line are kept as compressed bitmaps: a source's documents are numbered without gaps, and a
container of up to 32,768 of them has only as many bytes as the source has documents there. The bitmaps of a line's
variants (case, digits, blanks) are united, their exact cardinalities are summed and compared with the threshold, and lines
are deleted by looking their document up in the bitmap. Only lines that stand often enough in all to reach the threshold
get bitmaps; the rest can't be repeated.

A line that stands in most pages of a huge source is spread: what is joined by it is joined by a salt or a container too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingloom.llm.canonical import consistent
from filingloom.plans.scratch import materialise

MIN_DOCS, MIN_SHARE = 4, 0.25
#: Documents of a container, and parts of a source in which its documents are numbered, and its lines joined, apart.
CONTAINER, PARTS, SALTS = 32_768, 256, 16


def line_variant(line: Column) -> Column:
    """A line of a consistent text, trimmed, each run of blanks one blank and each run of digits one mark."""
    short = F.regexp_replace(F.regexp_replace(line, "(?U)\\s+", " "), "\\p{Nd}+", "0")
    return F.trim(short)


def is_candidate(line: Column) -> Column:
    """Not without a letter, not a table row, not a PART or ITEM heading; ``line`` as it stands in its page."""
    return line.rlike("\\p{L}") & ~line.startswith("|") & ~line.rlike("(?iU)^[*#\\s]*(PART|ITEM)\\b")


def numbered_documents(filings: DataFrame, doc: str, source: str) -> DataFrame:
    """(doc, source, doc_no, docs, needed) of each document: its number in the source from 1 without gaps, for its bit, how
    many the source has and how many of them make a line repeated.

    The number follows from the keys alone, so it is the same if an executor is lost. It is counted in parts of a source by
    hash, as one may hold most documents. A document delivered twice counts once; one without a source or a key not at all.
    """
    once = filings.where(F.col(doc).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.min(source).alias("source"))
    parted = once.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int"))
    placed = parted.withColumn("place", F.row_number().over(W.partitionBy("source", "part").orderBy("doc")) - 1)
    counts = parted.groupBy("source", "part").agg(F.count("*").alias("n"))
    own = W.partitionBy("source")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "part", before.alias("start"), F.sum("n").over(own).alias("docs"))
    needed = F.greatest(F.lit(MIN_DOCS), F.ceil(F.col("docs") * MIN_SHARE)).cast("long")
    return placed.join(starts, ["source", "part"]).select("doc", "source", (F.col("start") + F.col("place") + 1).alias("doc_no"), "docs", needed.alias("needed"))


def page_lines(pages: DataFrame, doc: str, number: str, content: str, numbered: DataFrame) -> DataFrame:
    """A row per line that may be a repeated one: (doc, source, doc_no, docs, needed, number, line_no, variant, line_key)."""
    texts = pages.where(F.col(content).isNotNull()).select(F.col(doc).alias("doc"), F.col(number).alias("number"), consistent(F.col(content)).alias("text"))
    lines = texts.select("doc", "number", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(is_candidate(F.col("line")))
    named = lines.withColumn("line", line_variant(F.col("line")))
    named = named.select("doc", "number", "line_no", F.xxhash64("line").alias("variant"), F.xxhash64(F.lower("line")).alias("line_key"))
    return named.join(numbered, "doc")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(source, line_key, bucket, bitmap) of the lines repeated excessively within their source, a row per container."""
    often = lines.groupBy("source", "line_key").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n >= needed")
    spread = often.select("source", "line_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    held = lines.withColumn("salt", F.col("doc_no") % SALTS).join(spread, ["source", "line_key", "salt"], "left_semi")
    bit, bucket = F.bitmap_bit_position("doc_no"), F.bitmap_bucket_number("doc_no")
    variants = held.groupBy("source", "line_key", "needed", "docs", "variant", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    united = variants.groupBy("source", "line_key", "needed", "docs", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    bits = F.least(F.lit(CONTAINER), F.col("docs") - (F.col("bucket") - 1) * CONTAINER)
    small = united.withColumn("bitmap", F.substring(F.col("bitmap"), F.lit(1), F.ceil(bits / 8).cast("int")))
    total = small.groupBy("source", "line_key").agg(F.sum(F.bitmap_count("bitmap")).alias("cardinality"), F.first("needed").alias("needed"))
    found = total.where("cardinality >= needed").select("source", "line_key")
    return small.select("source", "line_key", "bucket", "bitmap").join(found, ["source", "line_key"], "left_semi")


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position % 8) == 1


def found_lines(pages: DataFrame, filings: DataFrame, doc: str = "doc_id", number: str = "number", content: str = "content", source: str = "site") -> DataFrame:
    """(doc, number, line_no) of every line of a page that its source repeats excessively.

    Null contents, pages of unknown documents and documents without a source give no row; repeated pages each line once.
    Only the named columns are read, so others may have any name.
    """
    numbered = numbered_documents(filings.select(doc, source), doc, source)
    lines = materialise(page_lines(pages.select(doc, number, content), doc, number, content, numbered), "lines")
    repeated = repeated_lines(lines)
    bit = F.bitmap_bit_position("doc_no").cast("int")
    keyed = lines.withColumn("bucket", F.bitmap_bucket_number("doc_no"))
    hit = keyed.join(repeated.hint("merge"), ["source", "line_key", "bucket"]).where(_bit(F.col("bitmap"), bit))
    return hit.select(F.col("doc").alias("doc_id"), "number", "line_no").distinct()


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, number, content, removed): each page once, without its repeated lines; null contents stay null."""
    drop = found.groupBy("doc_id", "number").agg(F.collect_set("line_no").alias("drop"))
    once = pages.select("doc_id", "number", "content").distinct()
    joined = once.join(drop, ["doc_id", "number"], "left")
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains("drop", i))
    text = F.when(F.col("drop").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))
    return joined.select("doc_id", "number", text.alias("content"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
