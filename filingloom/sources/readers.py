"""Reading filings from tables, folders of files and over HTTP, and writing results."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filingloom.functions.text import decoded, is_pdf, is_url

TIMEOUT = 30.0


def table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table in any format that Spark reads; give a schema for json and csv, so nothing is inferred."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def files(spark: SparkSession, path: str, pattern: str = "*.htm*") -> DataFrame:
    """(doc_id, url, html) of a folder of documents: the path is the id, bytes that aren't UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("doc_id"), F.col("path").alias("url"), decoded(F.col("content")).alias("html"))


def assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of images."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def kind_of(source: Column) -> Column:
    """What a source is: ``url``, ``pdf``, ``html``; null for a null."""
    return F.when(source.isNull(), None).when(is_url(F.trim(source)), "url").when(is_pdf(source), "pdf").otherwise("html")


def http_bytes(url: str, agent: str | None = None, timeout: float = 15.0) -> bytes:
    """The bytes at an address, such as an image's."""
    request = urllib.request.Request(url, headers={"User-Agent": agent} if agent else {})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read()


def http_get(url: str, agent: str | None, timeout: float = TIMEOUT) -> str:
    """The text at an address; the regulator's site wants to know who asks."""
    if "sec.gov" in url.lower() and not agent:
        raise ValueError("this site needs a user agent with a contact")
    request = urllib.request.Request(url, headers={"User-Agent": agent} if agent else {})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read().decode("utf-8", "ignore")


class _Some(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options: dict, get: Callable[[str, str | None], str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.agent, self.per, self.get = options.get("useragent"), int(options.get("perpartition", "20")), get

    def partitions(self) -> list[InputPartition]:
        return [_Some(self.urls[a : a + self.per]) for a in range(0, len(self.urls), self.per)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                yield url, url, self.get(url, self.agent), None
            except OSError as e:  # one address that fails must not end the job
                yield url, url, None, str(e)


class HttpFilings(DataSource):
    """``spark.read.format("filing_http").option("urls", "a\\nb").option("userAgent", ...)``: (doc_id, url, html, error)."""

    transport: Callable[[str, str | None], str] = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "filing_http"

    def schema(self) -> str:
        return "doc_id string, url string, html string, error string"

    def reader(self, schema) -> HttpReader:
        return HttpReader({k.lower(): v for k, v in self.options.items()}, type(self).transport)


def fetch(urls: DataFrame, url: str = "url", agent: str | None = None, get: Callable[[str, str | None], str] = http_get) -> DataFrame:
    """Addresses of a column, fetched by the executors: (url, html, error). For lists too long for an option."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for u in pdf["url"]:
                try:
                    out.append((u, get(u, agent), None))
                except OSError as e:
                    out.append((u, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    asked = urls.select(F.col(url).alias("url")).where(is_url(F.col("url"))).distinct()
    return asked.mapInPandas(run, "url string, html string, error string")


def page_json(pages: DataFrame, essentials: bool = False) -> DataFrame:
    """(doc_id, json) of each page, nested; ``essentials`` keeps number, content and elements."""
    cols = [c for c in (("number", "content", "elements") if essentials else pages.columns) if c in pages.columns and c != "doc_id"]
    return pages.select("doc_id", F.to_json(F.struct(*cols)).alias("json"))


def preview(content: Column, length: int = 200) -> Column:
    """The start of a text on one line, with three dots if it goes on."""
    flat = F.trim(F.regexp_replace(F.substring(content, 1, 4 * length), "(?U)\\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def _range(first: str, last: str) -> Column:
    return F.when(F.col(first) == F.col(last), F.col(first).cast("string")).otherwise(F.concat(F.col(first).cast("string"), F.lit("-"), F.col(last).cast("string")))


def _start(content: str, length: int) -> Column:
    return F.concat(F.translate(F.substring(content, 1, length), "\n", " "), F.lit("..."))


def element_label() -> Column:
    """One line for a row of elements, for display."""
    return F.format_string("Element(id='%s', kind='%s', p%s, chars=%d, preview='%s')", "id", "kind", _range("page_start", "page_end"), F.length("content"), _start("content", 80))


def page_label() -> Column:
    """One line for a row of pages (number, content, display_page, tokens)."""
    shown = F.when(F.col("display_page") > 0, F.format_string(", display_page=%d", "display_page")).otherwise("")
    return F.format_string("Page(number=%d%s, tokens=%d, preview='%s')", "number", shown, "tokens", _start("content", 100))


def section_label() -> Column:
    """One line for a row of sections."""
    return F.format_string("Section(item='%s', title='%s', pages=%d-%d, tokens=%d)", "item", "item_title", "start_page", "end_page", "tokens")


def chunk_label() -> Column:
    """One line for a row of chunks with their columns and display pages."""
    a, b = F.col("display_page_range.start"), F.col("display_page_range.end")
    shown = F.when(a == b, F.format_string(", display_page=%d", a)).when(a.isNotNull(), F.format_string(", display_pages=%d-%d", a, b)).otherwise("")
    return F.format_string("Chunk[%d] (pages=%s%s, blocks=%d, tokens=%d)", "index", _range("start_page", "end_page"), shown, F.size("blocks"), "num_tokens")


def nest(parents: DataFrame, children: DataFrame, on: list[str], name: str, order: str) -> DataFrame:
    """Children as an ordered array of structs on their parents; the empty array where there is none."""
    cols = [c for c in children.columns if c not in on and c != order]
    listed = children.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias(name))
    joined = parents.join(listed, on, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A column of texts, a file per partition; texts of several lines stay whole, as JSON strings."""
    df.select(F.to_json(F.struct(column)).alias("value")).write.mode("overwrite").text(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what counts its rows, and other given aggregates, while an action runs over it: ``observation.get`` has them after it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())), seen
