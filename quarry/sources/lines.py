"""Documents from files as (doc_id, page, line_no, raw_line), the input of the parser.

Text files hold pages divided by form feeds. Other formats come in through a page reader (bytes -> texts of the pages),
which runs on the executors; a file that it cannot read gives no lines instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id long, path string, page int, line_no long, raw_line string"


def read_pages(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """doc_id (a hash of the path), path, page (from 1), text. Errors if the path does not exist."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    if pages is None:
        texts = F.split(F.decode("content", "UTF-8"), "\f", -1)
        return files.select("doc_id", "path", F.posexplode(texts).alias("page", "text")).withColumn("page", F.col("page") + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, name, content in batch.itertuples(index=False):
                try:
                    found = pages(bytes(content))
                except Exception:  # noqa: BLE001  one unreadable file must not end the job
                    continue
                rows += [(doc_id, name, k, text) for k, text in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "page", "text"])

    return files.mapInPandas(run, "doc_id long, path string, page int, text string")


def scan_pages(spark: SparkSession, path: str, files: list[str] | None = None, page: Column | str | None = None) -> DataFrame:
    """doc_id, path, page (from 1), text, like read_pages of text files, with large files read in parts by several tasks.

    Spark's text reader splits a file at form feeds; a part's pages are numbered by the counts of the parts before it, a row for
    each part of a file, so files are read twice. `files` (paths as the result names them) leaves the other files unread. `page` is a
    condition on the column of that name; texts of parts without such a page are read, but go no further than their scan or
    join. A form feed that ends a file begins no page, and an empty file has none. Errors if the path does not exist.
    """
    raw = spark.read.option("lineSep", "\f").text(path)
    if files is not None:
        raw = raw.filter(F.col("_metadata.file_path").isin(files))  # before rows are numbered: Spark then leaves the other files out
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    parts = named.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if page is not None:
        numbers = parts.withColumn("page", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n"))))
        parts = numbers.filter(page).select("path", "_start", "_n", "_first", "_before").distinct()
    met = named.join(F.broadcast(parts), ["path", "_start"]).select(F.xxhash64("path").alias("doc_id"), "path", (F.col("_before") + F.col("_row") - F.col("_first") + 1).cast("int").alias("page"), "text")
    return met if page is None else met.filter(page)


def read_lines(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """SCHEMA, with line numbers from 1 on each page."""
    found = read_pages(spark, path, pages)
    return found.select("doc_id", "path", "page", F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "raw_line")).withColumn("line_no", (F.col("line_no") + 1).cast("long")).select("doc_id", "path", "page", "line_no", "raw_line")


def read_tables(spark: SparkSession, path: str, tables: Callable[[bytes], list[tuple[int, float, float, list[list[str | None]]]]]) -> DataFrame:
    """doc_id, path, page, table_no (from 1 on each page), top, bottom, rows: the tables that a reader finds in files.

    tables(content) lists (page, top, bottom, rows of cells); a file that it cannot read has none. The regions are what
    the spatial filter of the parser takes away from the lines, the rows what it makes sentences of.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, name, content in batch.itertuples(index=False):
                try:
                    found = tables(bytes(content))
                except Exception:  # noqa: BLE001  one unreadable file must not end the job
                    continue
                seen: dict[int, int] = {}
                for page, top, bottom, cells in found:
                    seen[page] = seen.get(page, 0) + 1
                    out.append((doc_id, name, page, seen[page], float(top), float(bottom), cells))
            yield pd.DataFrame(out, columns=["doc_id", "path", "page", "table_no", "top", "bottom", "rows"])

    return files.mapInPandas(run, "doc_id long, path string, page int, table_no int, top double, bottom double, rows array<array<string>>")


class CaseSource(DataSource):
    """Evaluation cases from a line format `question | expected ; expected` (nothing after the bar: must abstain)."""

    @classmethod
    def name(cls) -> str:
        return "eval_cases"

    def schema(self) -> str:
        return "case_id long, question string, expect array<string>"

    def reader(self, schema):
        return _CaseReader(self.options.get("text", ""))


class _CaseReader(DataSourceReader):
    def __init__(self, text: str):
        self.text = text

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for k, line in enumerate(x for x in self.text.splitlines() if x.strip()):
            question, _, expected = line.partition("|")
            values = [e.strip() for e in expected.split(";") if e.strip()]
            yield (k, question.strip(), values or None)


def eval_cases(spark: SparkSession, text: str) -> DataFrame:
    spark.dataSource.register(CaseSource)
    return spark.read.format("eval_cases").option("text", text).load()
