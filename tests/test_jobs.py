"""The jobs on copies of the tables: growing input, repeated and broken runs, command lines."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import answer_audit, common, refresh_collection
from quarry.operators import retrieve, stored_index

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(df):
    return rows(df.select("id", "doc_id", "source", "pos", "text", "n_tokens", "language", "has_numbers", "lang"))


def deliver(docs, folder, name):
    docs.coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.fixture
def landing(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    deliver(docs.filter("doc_id < 120"), tmp_path / "in", "day=1")
    return docs, str(tmp_path / "in"), str(tmp_path / "out")


def test_two_runs_over_growing_input(spark, landing):
    docs, path, out = landing
    run = lambda: refresh_collection.refresh_collection(spark, f"{path}/*", out)
    first = plain(run())
    assert {r[1] for r in first} <= set(range(120)) and plain(run()) == first  # nothing new, nothing changed
    assert spark.read.json(f"{out}/log").count() == 1
    again = docs.filter("doc_id < 10").withColumn("text", F.lit("Another text of a known document, which is left out as it was taken before. " * 3))
    deliver(docs.filter("doc_id >= 120").unionByName(again), path, "day=2")
    after = plain(run())
    assert set(first) < set(after) and plain(run()) == after
    log = {r.batch: r for r in spark.read.json(f"{out}/log").collect()}
    assert log[1].rows_read == docs.count() - 120 + 10 and log[1].known_or_repeated == 10 and log[1].taken == docs.count() - 120
    whole = plain(refresh_collection.refresh_collection(spark, f"{DIR}/documents.parquet", f"{out}-whole"))
    assert after == whole
    # the index that grew answers like one made at once from all passages
    collection = refresh_collection.read_passages(spark, out).select("id", "text")
    asked = spark.read.parquet(f"{DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    scores = lambda df: {(r.query_id, r.id): round(r.score, 6) for r in df.collect()}
    index = refresh_collection.collection_index(spark, out)
    assert scores(index.scores(asked)) == scores(retrieve.bm25_scores(collection, asked))
    assert scores(index.scores(asked, broadcast_terms=0)) == scores(index.scores(asked))


def test_postings_stay_where_they_are(spark, landing):
    _, path, out = landing
    refresh_collection.refresh_collection(spark, f"{path}/*", out)
    asked = spark.read.parquet(f"{DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = refresh_collection.collection_index(spark, out).scores(asked, broadcast_terms=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "postings" in line)
    join = max(k for k in range(at) if "SortMergeJoin" in lines[k])
    assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in lines[join:at])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quarry_")]


def test_a_broken_run_is_repeated(spark, landing, monkeypatch):
    docs, path, out = landing
    whole = plain(refresh_collection.refresh_collection(spark, f"{path}/*", f"{out}-clean"))
    with monkeypatch.context() as m:
        m.setattr(stored_index.StoredIndex, "add", lambda *a: 1 / 0)  # after the passages, before the rest
        with pytest.raises(StreamingQueryException):
            refresh_collection.refresh_collection(spark, f"{path}/*", out)
    assert plain(refresh_collection.refresh_collection(spark, f"{path}/*", out)) == whole
    assert spark.read.parquet(f"{out}/seen").count() == 120 == spark.read.json(f"{out}/log").first().taken


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    text = "A sentence that is long enough to be kept as a passage of its own, it costs $5. "
    made = [(1, text, "en", "a"), (1, text + "x", "en", "a"), (None, text, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, text * 60, None, "b"), (5, "short", "en", "b")]
    spark.createDataFrame(made, DOC).withColumns({"id": F.lit(9), "batch": F.lit(7), "pos": F.lit("p")}).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = refresh_collection.refresh_collection(spark, f"{tmp_path}/in", f"{tmp_path}/out").collect()
    assert {r.doc_id for r in got} == {1, 4} and [r.text for r in got if r.doc_id == 1] == [text.strip()]
    assert len([r for r in got if r.doc_id == 4]) > 1 and all(r.has_numbers and r.lang == ("en" if r.doc_id == 1 else None) for r in got)
    log = spark.read.json(f"{tmp_path}/out/log").first()
    assert (log.rows_read, log.without_id, log.taken, log.known_or_repeated) == (7, 1, 5, 1)


def test_audit_runs_are_repeatable_and_kept_apart(spark, tmp_path):
    for name in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}")
    paths = [f"{tmp_path}/{n}" for n in ("documents", "benchmark", "embeddings", "out")]
    first = rows(answer_audit.answer_audit(spark, *paths))
    assert rows(answer_audit.answer_audit(spark, *paths)) == first and len(first) == 40
    both = answer_audit.answer_audit(spark, *paths, run="strict", min_overlap=1.1)
    assert rows(both.filter("run = 'current'")) == first
    strict = both.filter("run = 'strict'")
    assert strict.filter("verdict = 'grounded'").count() == 0 and strict.count() == 40
    summary = {(r.run, r.verdict): r.answers for r in spark.read.json(f"{tmp_path}/out/summary").collect()}
    assert sum(n for (run, _), n in summary.items() if run == "strict") == 40


def test_audit_of_odd_answers(spark, tmp_path):
    spark.createDataFrame([(0, "the fee of a card is 12 euros", "en", "s"), (1, "limits are checked daily", "en", "s"), (None, "x", "en", "s")], DOC).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(0, "the fee of a card is 99 euros"), (7, None), (8, "zzz"), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/answers")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/vectors")
    got = {r.query_id: r for r in answer_audit.answer_audit(spark, *[f"{tmp_path}/{n}" for n in ("documents", "answers", "vectors", "out")]).collect()}
    assert {k: (r.verdict, r.reason) for k, r in got.items()} == {0: ("ungrounded", "ungrounded_numbers=['99']"), 7: ("no_source", "no_hits"), 8: ("no_source", "no_hits")}


def test_command_line_reads_config_and_flags(spark, tmp_path, monkeypatch):
    called = {}

    class Kept:
        def __getattr__(self, name):
            return (lambda: None) if name == "stop" else getattr(spark, name)

    class Builder:
        def appName(self, name):
            return self

        def config(self, map):
            called["conf"] = map
            return self

        def getOrCreate(self):
            return Kept()

    monkeypatch.setattr(common, "SparkSession", type("S", (), {"builder": Builder()}))
    (tmp_path / "c.json").write_text(json.dumps({"documents": "a", "output": "b", "buckets": 3, "spark": {"x": "y"}}))
    common.command_line("refresh_collection", ["documents", "output"], lambda s, **k: called.update(k), ["--config", str(tmp_path / "c.json"), "--output", "/o"])
    assert called == {"conf": {"x": "y"}, "documents": "a", "output": "/o", "buckets": 3}
    with pytest.raises(SystemExit):
        common.command_line("answer_audit", ["documents", "answers"], lambda s, **k: None, ["--documents", "d"])
