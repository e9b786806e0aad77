"""Batch: audit given answers against the collection before they are shown to users.

    python -m jobs.answer_audit --documents PATH --answers PATH --vectors PATH --output DIR [--run NAME] [--config FILE]

For every answer (item_id, text) the hybrid retrieval finds its passages among the documents (doc_id, text, lang, source); the
gates then tell whether it has a source, and whether its numbers and words are grounded in it. Vectors (vec_id, embedding) belong to documents and
answers by number. Below the output, for each run:

    report/run=NAME/verdict=V   query_id, reason, top_id, n_hits, text     V: grounded, ungrounded or no_source
    summary/run=NAME            verdict, answers                           (JSON)

A run replaces what it wrote under its name before, so it can be repeated; runs of other names stay. Answers without an id are left out
and counted in the log; an answer without words or without a vector is judged by what the other search finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from quarry.config import DEFAULTS
from quarry.operators import guard, retrieve

REPORT = "query_id long, reason string, top_id long, n_hits long, text string, run string, verdict string"


def audited(docs: DataFrame, answers: DataFrame, vectors: DataFrame, min_overlap: float = DEFAULTS.grounding_min_overlap, abstain_threshold: float = DEFAULTS.rerank_abstain_threshold) -> DataFrame:
    """query_id, verdict, reason, top_id, n_hits, text. docs: id, text, section_no, header; answers: query_id, text; vectors: id, embedding."""
    asked = vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec")).join(answers.select("query_id"), "query_id", "left_semi")
    linked = retrieve.link_by_order(docs.select("id", "section_no"))
    sparse = retrieve.bm25_best(docs.select("id", "text"), answers)
    fused = retrieve.rrf_topk(retrieve.rrf(retrieve.merge_hits(retrieve.dense_topk(vectors, asked), sparse, docs)))
    final = retrieve.final_topk(retrieve.rerank(fused, docs, answers))
    hits, near = retrieve.few_hits(retrieve.expand_neighbors(final, linked))  # a few rows an answer, read by all that follows
    context = guard.build_context(docs.select("id", "text", "header").join(near(hits), "id"))
    gate = guard.pre_gate(answers, hits, abstain_threshold).withColumnRenamed("reason", "pre_reason")
    top = hits.groupBy("query_id").agg(F.min_by("id", "final_rank").alias("top_id"), F.count(F.lit(1)).alias("n_hits"))
    rows = answers.join(gate, "query_id").join(context, "query_id", "left").join(top, "query_id", "left")
    passes, why = guard.grounding(F.col("text"), F.coalesce("context", F.lit("")), F.lit("en"), min_overlap)
    judged = rows.withColumns({"passes": passes, "why": why})
    verdict = F.when(F.col("abstain"), "no_source").when(~F.col("passes"), "ungrounded").otherwise("grounded")
    reason = F.when(F.col("abstain"), F.col("pre_reason")).when(~F.col("passes"), F.col("why")).otherwise("")
    return judged.select("query_id", reason.alias("reason"), "top_id", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), "text", verdict.alias("verdict"))


def answer_audit(spark: SparkSession, documents: str, answers: str, vectors: str, output: str, run: str = "current", min_overlap: float = DEFAULTS.grounding_min_overlap, abstain_threshold: float = DEFAULTS.rerank_abstain_threshold) -> DataFrame:
    """Write the report and the summary of a run; returns the report of all runs."""
    output = output.rstrip("/")
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("section_no"), F.col("source").alias("header"))
    given = spark.read.parquet(answers).select(F.col("item_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    vecs = spark.read.parquet(vectors).select(F.col("vec_id").cast("long").alias("id"), "embedding")
    report = audited(docs.filter("id IS NOT NULL"), given.filter("query_id IS NOT NULL"), vecs, min_overlap, abstain_threshold)
    report.write.mode("overwrite").partitionBy("verdict").parquet(f"{output}/report/run={run}")
    written = spark.read.schema(REPORT).parquet(f"{output}/report")
    mine = written.filter(F.col("run") == run)
    mine.groupBy("verdict").agg(F.count(F.lit(1)).alias("answers")).coalesce(1).write.mode("overwrite").json(f"{output}/summary/run={run}")
    log.info("%s: %d documents and %d answers read, %d without id; written %s", output, docs.count(), given.count(), given.filter("query_id IS NULL").count(), {r.verdict: r.answers for r in spark.read.schema("verdict string, answers long").json(f"{output}/summary/run={run}").collect()})
    return written


if __name__ == "__main__":
    command_line("answer_audit", ["documents", "answers", "vectors", "output"], answer_audit)
