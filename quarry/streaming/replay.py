"""Run a bounded table through a stream and read what it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarry.sources.folders import scratch


def replay(df: DataFrame, transform: Callable[[DataFrame], DataFrame], files_per_trigger: int = 4) -> DataFrame:
    """Write `df` as files, stream them through `transform` (append mode) until none is left, and return the sink."""
    spark = df.sparkSession
    base = scratch(spark, "replay")
    df.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{base}/in")
    query = transform(stream).writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{base}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
