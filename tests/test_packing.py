"""Packing on rows against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.chunk import build_chunks
from quarry.operators.packing import pack_rows


def loop(sizes, target, overlap):
    out, window, total = [], [], 0
    for i, size in enumerate(sizes):
        if window and total + size > target:
            out.append(window)
            window = window[-overlap:] if overlap else []
            total = sum(sizes[j] for j in window)
        window, total = [*window, i], total + size
    return [*out, window] if window else out


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_pack_rows(spark, overlap):
    rng = random.Random(overlap)
    runs = {r: [rng.choice([1, 2, 3, 9, 40]) for _ in range(n)] for r, n in enumerate([1, 2, 3, 17, 60, 300])}
    rows = [(r, i, size, str(i)) for r, sizes in runs.items() for i, size in enumerate(sizes)]
    got = pack_rows(spark.createDataFrame(rows, "run int, pos long, size int, text string"), ["run"], 20, overlap).collect()
    want = {(r, k): list(map(str, w)) for r, sizes in runs.items() for k, w in enumerate(loop(sizes, 20, overlap))}
    assert {(g["run"], g["window"]): g["texts"] for g in got} == want
    assert len(got) == len(want)


def blocks(spark, n):
    """One section of n blocks, bullets and prose by turns of 1 to 3, some bullets of their own size, sentences over blocks."""
    k = F.col("id")
    text = F.when(k % 11 == 0, F.repeat(F.lit("long bullet "), 30)).when(k % 3 == 0, F.concat(F.lit("item "), k)).when(k % 5 == 1, F.lit("and goes on. Then 2 more! A third")).otherwise(F.concat(F.lit("Line "), k, F.lit(" ends here.")))
    kind = F.when((k % 11 == 0) | (k % 3 == 0), "bullet").when(k % 97 == 1, "faq").otherwise("prose")
    none = F.lit(None).cast("string")
    return spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (k + 1).alias("block_no"), kind.alias("kind"), text.alias("text"), F.lit("1").alias("section_no"), F.lit("T").alias("section_title"), F.lit("").alias("subsection_no"), F.lit("").alias("subsection_title"),
                                 (k / 40).cast("int").alias("page"), none.alias("question"), none.alias("row_subject"))


@pytest.mark.parametrize("overlap", [1, 2])
def test_rows_equal_fold(spark, overlap):
    b = blocks(spark, 700)
    folded, packed = (sorted(map(tuple, build_chunks(b, target=60, overlap=overlap, long_run=n).collect())) for n in (10_000, 50))
    assert folded == packed and len(folded) > 100


def test_long_section(spark):
    chunks = build_chunks(blocks(spark, 20_000), target=60)
    prose = chunks.filter("kind = 'prose'").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("most")).first()
    assert prose["n"] > 1_000 and prose["most"] < 600


def test_empty(spark):
    assert build_chunks(blocks(spark, 0)).count() == 0


def test_all_runs_are_packed_in_one_pass(spark):
    """stored blocks, cuts and jumps of every run stayed on disk with their shuffles; runs end anywhere in batches, texts are odd."""
    rng = random.Random(5)
    odd = ["", "  ", None, "One. Two", "Ends.", " Begins", "\t3 days? Yes!\n", "no end", "x" * 300, "A. B. C. D.", "é. É", "1", "Ends!  "]
    rows = []
    for doc in range(30):
        for no in range(1, rng.choice([2, 9, 60])):
            section = str(no // rng.choice([3, 9, 40]))
            rows.append((doc, no, rng.choice(["bullet", "bullet", "prose", "prose", "prose", "faq", "table_row", "other"]), rng.choice([*odd, "A line that goes on. And on", "and further, to its end."]), section, f"T{section}", "", "", no // 7, "q", "s"))
    given = spark.createDataFrame(rows, "doc_id long, block_no long, kind string, text string, section_no string, section_title string, subsection_no string, subsection_title string, page int, question string, row_subject string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for overlap, least in [(0, 0), (1, 8), (2, 3)]:
            packed = build_chunks(given, target=30, overlap=overlap, least=least, long_run=0)
            folded = sorted(map(repr, build_chunks(given, target=30, overlap=overlap, least=least).collect()))
            assert sorted(map(repr, packed.collect())) == folded == sorted(map(repr, build_chunks(given, target=30, overlap=overlap, least=least, long_run=5).collect()))
            assert len(folded) > 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = packed.select("doc_id", "chunk_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
