"""The same transforms over a stream of filings: each document once, pages and counts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from filingloom.operators.filings import parse_pages


def filings_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int = 100, pattern: str = "*") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).load(path)


def first_deliveries(stream: DataFrame, key: str = "doc_id", time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Each document once; the keys seen are forgotten after ``late``, so the state is bounded. A null time never leaves."""
    return stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_pages(stream: DataFrame) -> DataFrame:
    """Pages of arriving documents; no state."""
    return parse_pages(stream, with_elements=True)


def arrivals(stream: DataFrame, time: str = "loaded_at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, filing_type, docs): documents by day and type, with late ones up to ``late``."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "filing_type").agg(F.count("*").alias("docs")).select(F.col("w.start").alias("start"), "filing_type", "docs")


def write_pages(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pages as Parquet, exactly once; all that has arrived, then it ends."""
    return pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
