"""Queries of the evaluation harness: cases and answers derived from labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluate
from quarry.plans.registry import query, table

JUDGED = """judged AS (SELECT l.doc_id AS case_id, 'question ' || l.doc_id::VARCHAR AS question, d.text, l.toxic = 1 AS abstained, l.quality = 1 AS answerable,
    CASE WHEN l.quality = 1 THEN NOT (l.toxic = 1) AND (contains(lower(d.text), 'the') OR contains(lower(d.text), 'und')) ELSE l.toxic = 1 END AS correct FROM labels l JOIN documents d USING (doc_id))"""


def _judged(spark, d):
    labels = table(spark, d, "labels")
    cases = labels.select(F.col("doc_id").alias("case_id"), F.concat(F.lit("question "), F.col("doc_id").cast("string")).alias("question"), F.when(F.col("quality") == 1, F.array(F.lit("The"), F.lit("UND"))).alias("expect"))
    answers = table(spark, d, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("case_id"), "text", (F.col("toxic") == 1).alias("abstained"))
    return evaluate.judge(cases, answers)


@query("eval_match", f"WITH {JUDGED} SELECT case_id, answerable, correct FROM judged")
def eval_match(spark, d):
    return _judged(spark, d).select("case_id", "answerable", "correct")


@query("eval_rates", f"""WITH {JUDGED} SELECT count(*) FILTER (WHERE answerable) AS n_answerable, count(*) FILTER (WHERE NOT answerable) AS n_abstain, count(*) FILTER (WHERE correct AND answerable) AS answered, count(*) FILTER (WHERE correct AND NOT answerable) AS abstained_right,
    round(count(*) FILTER (WHERE correct AND answerable) / greatest(count(*) FILTER (WHERE answerable), 1)::DOUBLE, 6) AS answer_accuracy, round(count(*) FILTER (WHERE correct AND NOT answerable) / greatest(count(*) FILTER (WHERE NOT answerable), 1)::DOUBLE, 6) AS abstention_accuracy,
    round(count(*) FILTER (WHERE NOT correct AND NOT answerable) / greatest(count(*) FILTER (WHERE NOT answerable), 1)::DOUBLE, 6) AS hallucination_rate FROM judged""")
def eval_rates(spark, d):
    return evaluate.rates(_judged(spark, d)).withColumns({c: F.round(c, 6) for c in ("answer_accuracy", "abstention_accuracy", "hallucination_rate")})


@query("eval_failures", f"WITH {JUDGED} SELECT case_id, CASE WHEN answerable THEN 'ANSWER' ELSE 'ABSTAIN' END AS tag, question, substr(text, 1, 110) AS text FROM judged WHERE NOT correct")
def eval_failures(spark, d):
    return evaluate.failures(_judged(spark, d))


@query("eval_latency", "SELECT round(median(value), 6) AS p50, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events")
def eval_latency(spark, d):
    return evaluate.latency(table(spark, d, "events"), "value").select(*[F.round(c, 6).alias(c) for c in ("p50", "mean", "max")])


@query("eval_stage_latency", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, max(value)::DOUBLE AS max, true AS p50_within, true AS p95_within FROM events GROUP BY event_type")
def eval_stage_latency(spark, d):
    """Latency by stage from sketches of each stage and day, merged; and whether the true ranks of its quantiles are within 0.03."""
    events = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.to_date("ts").alias("day"), F.col("value").alias("ms"))
    daily = evaluate.latency_sketches(events, ["stage", "day"])
    found = evaluate.sketched_latency(evaluate.merge_sketches(daily, ["stage"]), (0.5, 0.95))
    ranked = events.join(found.select("stage", "p50", "p95"), "stage").groupBy("stage").agg(*[F.avg((F.col("ms") <= F.col(p)).cast("double")).alias(f"_{p}") for p in ("p50", "p95")])
    within = [(F.abs(F.col(f"_{p}") - F.lit(r)) <= 0.03).alias(f"{p}_within") for p, r in (("p50", 0.5), ("p95", 0.95))]
    return found.join(ranked, "stage").select("stage", "n", F.round("mean", 6).alias("mean"), "max", *within)
