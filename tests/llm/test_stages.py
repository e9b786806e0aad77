"""Every pipeline stage on odd rows: nulls, empty and repeated rows, columns named like the stages' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import linededup, mixing, toxicity

DIR = "/root/testdata/sf0.001"
NAMES = ["_toxicity", "_topic", "_topic_of", "_topic_weight", "__ld_dropped", "_mix_kept", "_text_of", "_TOXICITY_", "__ld_id", "_mix_weight", "score", "label", "node", "_id", "_th", "keys", "kept", "component_id"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter("doc_id < 60")
    odd = spark.createDataFrame([(None, "a line of a row without an id", "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0), (901, "", "en", "s", 0), (None, None, None, None, None)], docs.schema)
    whole = docs.unionByName(docs.filter("doc_id < 3")).unionByName(odd)
    for k, name in enumerate(NAMES):
        whole = whole.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return whole.coalesce(2)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_odd_rows(spark, odd, name):
    got = STAGES[name](spark, odd, DIR)
    if name == "encoding":
        assert got.count() == odd.count() and {r.n_tokens for r in got.filter("doc_id IN (900, 901)").collect()} == {0}
        return
    assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes)
    rows = got.collect()
    assert all(r[n] == f"{k}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for k, n in enumerate(NAMES))
    assert 0 < len(rows) <= odd.count()
    if name in ("toxicity", "line_dedup"):
        assert [r.text for r in rows if r.doc_id == 900] == [None] and len([r for r in rows if r.doc_id == 901]) == 2
    if name == "near_dedup":
        assert len([r for r in rows if r.doc_id is None]) == 2 and any(r.doc_id == 900 for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_an_empty_table(spark, odd, name):
    assert STAGES[name](spark, odd.filter("false"), DIR).count() == 0


def test_operators_leave_columns_of_their_own_names(spark, odd):
    rows = odd.select("doc_id", "text", "source", "lang", *NAMES)
    prefix = mixing.free_prefix(rows)
    mixed = mixing.mix_documents(rows, spark.read.parquet(f"{DIR}/embeddings.parquet"))
    assert prefix == "__mix_" and set(rows.columns) < set(mixed.columns) and mixed.select(f"{prefix}kept").distinct().count() == 2
    assert sorted(linededup.dedup_lines(rows).select("__ld_dropped", "__ld_id").collect()) == sorted(rows.select("__ld_dropped", "__ld_id").collect())
    model = toxicity.fit_toxicity(rows, spark.read.parquet(f"{DIR}/labels.parquet"))
    scored = toxicity.score_toxicity(rows, model)
    assert dict(scored.dtypes)["score"] == "double" and scored.columns.count("score") == 1 and scored.count() == rows.count()
