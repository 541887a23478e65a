"""The queries of the problems, by name, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import canonical, leaks, nearcopies, neighbours, pieces, sentences, sitelines, tokenizer


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _keyed(spark: SparkSession, sf: str, tables: tuple[str, ...]):
    key = {
        "elements": F.col("id"),
        "doc_pages": F.concat("doc_id", F.lit("#"), F.col("number").cast("string")),
        "blocks": F.concat("doc_id", F.lit("#"), F.col("seq").cast("string")),
    }
    return [(t, _read(spark, sf, t), key[t]) for t in tables]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = [canonical.changed_rows(df, key, F.col("content"), t) for t, df, key in _keyed(spark, sf, ("elements", "doc_pages"))]
    return a.unionByName(b)


def p3_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Every element with its consistent form."""
    df = _read(spark, sf, "elements").select("id", "content").distinct()
    return df.select("id", canonical.consistent(F.col("content")).alias("content"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    parts = [pieces.split_oversized(df, key, F.col("content")).select(F.lit(t).alias("tbl"), "*") for t, df, key in _keyed(spark, sf, ("elements", "doc_pages", "blocks"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("piece = 1").select("tbl", "row_key")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every oversized row."""
    return _pieces(spark, sf)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return sitelines.found_lines(_read(spark, sf, "doc_pages"), _read(spark, sf, "filings"))


def p5_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page without its site's own lines."""
    return sitelines.without_lines(_read(spark, sf, "doc_pages"), p5_found(spark, sf))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode(_read(spark, sf, "documents"), "doc_id", "text", f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Each text as its ids give it back."""
    return tokenizer.decode(p6_ids(spark, sf), "doc_id", "ids", f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p7_reparameterised(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that repeat an item's template with other values, put in consistently."""
    return leaks.reparameterised(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(_read(spark, sf, "documents"), "doc_id", "text", "lang")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_read(spark, sf, "chunks"), "chunk_id", "vector")
    return pairs.select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar chunks of every chunk with a usable vector, however far they are."""
    found = neighbours.nearest(_read(spark, sf, "chunks"), "chunk_id", "vector", min_cos=None)
    return found.select(F.col("id").alias("chunk_id"), "neighbour", "cos")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    elements = _read(spark, sf, "elements").select(F.lit("elements").alias("tbl"), "id", F.col("content").alias("text"))
    joined = F.array_join(F.transform("blocks", lambda b: b["content"]), "\n")
    chunks = _read(spark, sf, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), joined.alias("text"))
    return nearcopies.near_pairs(elements.unionByName(chunks))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_neighbours, p3_found, p3_consistent, p4_found, p4_pieces, p5_found, p5_pages, p6_ids, p6_decoded, p7_found, p7_reparameterised, p8_found)}

_P4 = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS tbl, {k} AS row_key FROM {t} WHERE length(content) // 4 > 512"
    for t, k in (("elements", "id"), ("doc_pages", "doc_id || '#' || number"), ("blocks", "doc_id || '#' || seq"))
)

def _windows(key: str, texts: str) -> str:
    """Distinct runs of twelve words."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS k FROM (
      SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({texts})) WHERE len(w) >= 12)"""


_P7 = f"""SELECT DISTINCT doc_id, eval_id FROM ({_windows("doc_id", "SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL")})
  JOIN ({_windows("eval_id", "SELECT eval_id, passage AS t FROM eval_items UNION ALL SELECT eval_id, question FROM eval_items")}) USING (k)"""

SQL = {
    "p7_found": _P7,
    "p4_found": _P4,
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
