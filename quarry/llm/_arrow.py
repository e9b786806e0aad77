"""Helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from quarry.sources.folders import ensure_checkpoint_dir, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Lets Spark remove the shuffle files of a query once it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back. It cuts the lineage like a checkpoint, and the shuffle files behind it go at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores after it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def frugal(run):
    """An Arrow function whose worker gives memory back to the system at the end of a task.

    Workers wait for further tasks, beside stages that need the memory for themselves.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others need no asking
            if trim is not None:
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000):
    """Cut a record batch into runs of rows whose `column` holds about `chars` bytes, at least one row each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str, chars: int = 2_000_000):
    """The strings of a column one by one; as Python's strings, only about `chars` bytes of them exist at a time."""
    for part in slices(batch, column, chars):
        yield from part.column(column).to_pylist()


__all__ = ["ensure_checkpoint_dir", "frugal", "shuffle_partitions", "slices", "table", "texts", "unused", "written"]
