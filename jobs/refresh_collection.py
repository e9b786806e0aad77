"""Incremental: keep the collection of passages and its search index up to date with a folder of documents.

    python -m jobs.refresh_collection --documents DIR --output DIR [--config FILE]

Documents (doc_id, text, lang, source; Parquet) are read as a file stream: the stream's checkpoint below the output remembers
which files were taken, so a run takes only new ones and ends when none is left. Below the output:

    passages/batch=N/lang=L   id, doc_id, source, pos, text, n_tokens, language, has_numbers
    index/                    the stored index of all passages (postings and partial statistics by batch)
    seen/batch=N              doc_id of the documents taken
    log/batch=N               rows read, taken, known before, without id; passages written
    checkpoint/               of the stream

Every write replaces the folder of its own batch, and what is known is asked of earlier batches only, so a batch that is run
again after a failure gives the same. A document id is taken once: a later delivery of it is counted as known and left out; within a
batch the least row (text, lang, source) of an id is taken. A null id is counted and left out; a null or empty text has no passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from quarry.functions import text as tx
from quarry.operators.nlu import detect_language
from quarry.operators.stored_index import StoredIndex

PASSAGES = "id string, doc_id long, source string, pos int, text string, n_tokens int, language string, has_numbers boolean, batch long, lang string"


def passages(docs: DataFrame, target_tokens: int = 320, least_tokens: int = 8) -> DataFrame:
    """Overlapping sentence windows of each document, with what the assistant filters by."""
    cut = docs.select("doc_id", "lang", "source", F.posexplode(tx.sentence_windows(F.col("text"), target_tokens)).alias("pos", "text"))
    text = F.col("text")
    kept = cut.withColumn("n_tokens", tx.est_tokens(text).cast("int")).filter(F.col("n_tokens") >= least_tokens)
    return kept.select(F.format_string("%d-%04d", "doc_id", "pos").alias("id"), "doc_id", "source", "pos", "text", "n_tokens", detect_language(text).alias("language"), tx.has_numbers(text).alias("has_numbers"), "lang")


def one_path_glob(path: str) -> str:
    """The path as a pattern that matches it alone; a file stream then takes a single file as well as a folder."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def collection_index(spark: SparkSession, output: str, buckets: int = 16, parts: int = 4) -> StoredIndex:
    return StoredIndex(spark, f"{output}/index", buckets, parts)


def read_passages(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PASSAGES).parquet(f"{output}/passages")


def refresh_collection(spark: SparkSession, documents: str, output: str, target_tokens: int = 320, least_tokens: int = 8, files_per_batch: int = 1000, buckets: int = 16, parts: int = 4) -> DataFrame:
    """Take the new documents into the collection; returns all its passages as they then stand."""
    output = output.rstrip("/")
    index = collection_index(spark, output, buckets, parts)

    def take(delivered: DataFrame, batch: int) -> None:
        rows = delivered.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
        named = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("d"))
        fresh = named
        if batch > 0:
            seen = spark.read.schema("doc_id long, batch long").parquet(f"{output}/seen").filter(F.col("batch") < batch)
            fresh = named.join(seen.select("doc_id"), "doc_id", "left_anti")
        passages(fresh.select("doc_id", "d.*"), target_tokens, least_tokens).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/passages/batch={batch}")
        made = read_passages(spark, output).filter(F.col("batch") == batch)
        index.add(made.select("id", "text"), batch)
        fresh.select("doc_id").write.mode("overwrite").parquet(f"{output}/seen/batch={batch}")
        taken = spark.read.schema("doc_id long, batch long").parquet(f"{output}/seen").filter(F.col("batch") == batch)
        counts = rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("doc_id").isNull()).alias("without_id"))
        counts = counts.crossJoin(taken.agg(F.count(F.lit(1)).alias("taken"))).crossJoin(made.agg(F.count(F.lit(1)).alias("passages")))  # one row each
        counts = counts.withColumn("known_or_repeated", F.col("rows_read") - F.col("without_id") - F.col("taken"))
        counts.coalesce(1).write.mode("overwrite").json(f"{output}/log/batch={batch}")
        log.info("batch %d of %s: %s", batch, documents, spark.read.json(f"{output}/log/batch={batch}").first().asDict())

    pattern = one_path_glob(documents)
    schema = spark.read.parquet(pattern).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d passages", output, read_passages(spark, output).count())
    return read_passages(spark, output)


if __name__ == "__main__":
    command_line("refresh_collection", ["documents", "output"], refresh_collection)
