"""The evaluation harness: cases (case_id, question, expect) against answers (case_id, text, abstained, total_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds `answerable` (expect is not null) and `correct`: an expected substring, or an abstention where one is due."""
    joined = cases.join(answers, "case_id")
    low = F.lower("text")
    match = F.coalesce(F.exists("expect", lambda e: F.contains(low, F.lower(e))), F.lit(False))
    answerable = F.col("expect").isNotNull()
    return joined.withColumn("answerable", answerable).withColumn("correct", F.when(answerable, ~F.col("abstained") & match).otherwise(F.col("abstained")))


def rates(judged: DataFrame) -> DataFrame:
    """Accuracy of answers and abstentions and the rate of hallucination, in one row."""
    ok, due = F.col("correct"), ~F.col("answerable")
    n_due, n_ans = F.count_if(due), F.count_if(~due)
    return judged.agg(
        n_ans.alias("n_answerable"), n_due.alias("n_abstain"), F.count_if(ok & ~due).alias("answered"), F.count_if(ok & due).alias("abstained_right"),
        (F.count_if(ok & ~due) / F.greatest(n_ans, F.lit(1))).alias("answer_accuracy"), (F.count_if(ok & due) / F.greatest(n_due, F.lit(1))).alias("abstention_accuracy"),
        (F.count_if(~ok & due) / F.greatest(n_due, F.lit(1))).alias("hallucination_rate"),
    )


def latency(df: DataFrame, column: str = "total_ms") -> DataFrame:
    return df.agg(F.median(column).alias("p50"), F.avg(column).alias("mean"), F.max(column).alias("max"))


def latency_sketches(timings: DataFrame, by: list[str], column: str = "ms", k: int = 200) -> DataFrame:
    """The groups of `by` with n, total, most and a KLL sketch of the column: a row of bounded size for any number of times.

    Rows can be stored (of each day, say) and merged later. With k = 200 a quantile's rank is off by at most 1.65 % of the
    group with a probability of 0.99; the error falls about as k grows. Null and non-finite times are not counted.
    """
    ms = F.col(column).cast("double")
    sound = timings.filter(ms.isNotNull() & ~F.isnan(ms) & (F.abs(ms) < float("inf")))
    return sound.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total"), F.max(ms).alias("most"), F.kll_sketch_agg_double(ms, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str], k: int = 200) -> DataFrame:
    """The rows of latency_sketches put together by fewer columns; the error stays that of one sketch."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_latency(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The columns of the groups with n, mean, max and p50, p95, ... from the sketches."""
    groups = [c for c in sketches.columns if c not in ("n", "total", "most", "sketch")]
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(f"p{round(100 * r)}") for r in ranks]
    return sketches.select(*groups, "n", (F.col("total") / F.col("n")).alias("mean"), F.col("most").alias("max"), *quantiles)


def failures(judged: DataFrame, width: int = 110) -> DataFrame:
    """case_id, tag, question, text: what went wrong."""
    tag = F.when(F.col("answerable"), "ANSWER").otherwise("ABSTAIN")
    return judged.filter(~F.col("correct")).select("case_id", tag.alias("tag"), "question", F.substring("text", 1, width).alias("text"))
