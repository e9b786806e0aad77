import random

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import chunk, evaluate, guard, index, memory, nlu, parse, retrieve, speech


def blocks_of(spark, lines, tables=None):
    rows = [(1, p, n, t) for n, (p, t) in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no long, raw_line string")
    return parse.parse_blocks(df, tables).orderBy("block_no")


def test_headings_and_continuation(spark):
    got = blocks_of(spark, [(1, "3. Fees"), (1, "3.2 Cards"), (1, "Some text!"), (1, "goes on."), (1, "New"), (2, "other page"), (2, "2.50 per withdrawal"), (2, "4. Ends with dot."), (2, "5. Next"), (2, "last")])
    want = [("Some text! goes on.", "3", "3.2", 1), ("New", "3", "3.2", 1), ("other page 4. Ends with dot.", "3", "3.2", 2), ("last", "5", "", 2)]
    assert [(b.text, b.section_no, b.subsection_no, b.page) for b in got.collect()] == want


def test_questions_bullets_noise(spark):
    got = blocks_of(spark, [(1, "Q: a"), (1, "Q: b"), (1, "Between:"), (1, "A: c"), (1, "A: d"), (1, "- x"), (1, "– y"), (1, "-"), (1, "This document is a fictional thing")])
    assert [(b.kind, b.text) for b in got.collect()] == [("prose", "Between:"), ("faq", "Question: b\nAnswer: c"), ("prose", "A: d"), ("bullet", "x"), ("prose", "y This document is a fictional thing")]


def test_tables(spark):
    tables = spark.createDataFrame([(1, 1, 1, [["Fee", "Price", ""], ["Card", "$5", "flat"], ["", "x", "y"], ["Short", "2"], ["None", "", None]]), (1, 1, 2, [["only header"]])], "doc_id long, page int, table_no long, cells array<array<string>>")
    assert [r.text for r in parse.linearize_tables(tables).orderBy("row_no").collect()] == ["For Fee 'Card' — Price: $5; flat.", "For Fee 'Short' — Price: 2."]
    got = blocks_of(spark, [(1, "1. Costs"), (1, "Text."), (2, "2. Later")], tables)
    assert [(b.kind, b.section_no) for b in got.collect()] == [("table_row", ""), ("table_row", ""), ("prose", "1")]


def test_groups_and_chunks(spark):
    long = "A sentence with more than thirty characters."
    df = blocks_of(spark, [(1, "1. A"), (1, long), (1, "2. B"), (1, long), (1, "1. A"), (1, long), (1, "short.")])
    assert [r.group_no for r in chunk.run_groups(df).orderBy("block_no").collect()] == [1, 2, 3, 3]
    chunks = chunk.build_chunks(df).orderBy("chunk_id").collect()
    assert [(c.id, c.prev_id, c.next_id, c.header) for c in chunks] == [("chunk-1-0000", "", "chunk-1-0001", "Section 1: A"), ("chunk-1-0001", "chunk-1-0000", "chunk-1-0002", "Section 2: B"), ("chunk-1-0002", "chunk-1-0001", "", "Section 1: A")]
    assert chunks[2].raw_text == f"{long} short."


@pytest.mark.parametrize("text,language", [("", "en"), ("मेरा", "hinglish"), ("one two three four five six seven hai", "hinglish"), ("one two three four five six seven eight hai", "en"), ("hai kya " + "word " * 40, "hinglish")])
def test_language(spark, text, language):
    assert spark.createDataFrame([(text,)], "x string").select(nlu.detect_language(F.col("x"))).first()[0] == language


def test_routes_and_follow_ups(spark):
    df = spark.createDataFrame([("Hiii !", "greeting", False), ("hi there", None, False), ("kya haal hai?", "smalltalk", False), ("and fees?", None, True), ("what is it", None, True), ("one two three four five six it", None, False), ("and", None, False), ("ok bye", "goodbye", False)], "x string, kind string, follow boolean")
    for r in df.select("*", nlu.route(F.col("x")).alias("k"), nlu.needs_rewrite(F.col("x")).alias("f")).collect():
        assert (r.k, r.f) == (r.kind, r.follow), r.x


def test_expansion_is_by_substring_in_order(spark):
    got = spark.createDataFrame([("A costume abroad",), ("plain",)], "x string").select(nlu.expand_query(F.col("x"))).collect()
    assert [r[0] for r in got] == ["A costume abroad international transfer foreign fee charge", "plain"]


def test_fusion_sentinels_and_neighbours(spark):
    dense = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id long, id long, dense_rank long")
    sparse = spark.createDataFrame([(1, 11, 0), (1, 12, 1), (1, 99, 2)], "query_id long, id long, bm25_rank long")
    docs = spark.createDataFrame([(k, "s" if k != 13 else "t", k - 1 if k > 10 else None, k + 1) for k in range(9, 14)], "id long, section_no string, prev_id long, next_id long")
    fused = {r.id: r.fused for r in retrieve.rrf(retrieve.merge_hits(dense, sparse, docs)).collect()}
    assert fused == {10: 1 / 60 + 0.75 / 10060, 11: 1 / 61 + 0.75 / 60, 12: 1 / 10060 + 0.75 / 61}
    final = spark.createDataFrame([(1, 10, 0.5, 0), (1, 12, 0.9, 1), (1, 9, 0.49, 2)], "query_id long, id long, rerank_score double, final_rank long")
    got = [(r.id, r.neighbor, r.final_rank) for r in retrieve.expand_neighbors(final, docs).orderBy("final_rank").collect()]
    assert got == [(10, False, 0), (12, False, 1), (9, False, 2), (11, True, 3)]  # 13 is of another section, 9 is held


def test_similarities_in_blocks_equal_broadcast(spark):
    rnd = random.Random(1)
    v = spark.createDataFrame([(i, [rnd.random() for _ in range(3)]) for i in range(30)], "id long, embedding array<double>")
    q = v.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    assert sorted(retrieve.similarities(v, q).collect()) == sorted(retrieve.similarities(v, q, limit=3).collect())


def test_sparse_dot(spark):
    df = spark.sql("SELECT map('a', 1.0D, 'b', 2.0D) AS x, map('b', 3.0D) AS y, map_from_arrays(cast(array() AS array<string>), cast(array() AS array<double>)) AS z")
    assert list(df.select(retrieve.sparse_dot(F.col("x"), F.col("y")), retrieve.sparse_dot(F.col("x"), F.col("z"))).first()) == [6.0, 0.0]


def test_grounding(spark):
    rows = [("It is $1,000 or 3 fee", "the fee is 1000", True), ("Costs 2.50", "costs 2.5", False), ("alpha beta gamma delta epsilon", "alpha beta", True), ("alpha beta gamma delta epsilon zeta", "alpha beta", False), ("of the", "", True), (guard.lx.ABSTAIN["en"], "nothing", True)]
    passes, why = guard.grounding(F.col("a"), F.col("c"), F.lit("en"))
    for r in spark.createDataFrame(rows, "a string, c string, want boolean").select("*", passes.alias("p"), why.alias("w")).collect():
        assert r.p == r.want, (r.a, r.w)


def test_decisions(spark):
    refusal = guard.lx.ABSTAIN["en"]
    rows = [("fine", False, "", True, ""), ("x", True, "no_hits", True, ""), ("y", False, "", False, "low"), (refusal, False, "", True, "abstained")]
    df = spark.createDataFrame(rows, "raw string, abstain boolean, pre_reason string, passes boolean, why string").withColumn("language", F.lit("en"))
    assert [(r.text == refusal, r.abstained, r.reason, r.cacheable) for r in guard.decide(df).collect()] == [(False, False, "", True), (True, True, "no_hits", False), (True, True, "post_gate:low", False), (True, True, "llm_self_abstained", True)]


def test_cache(spark):
    cache = spark.createDataFrame([("a", [1.0, 0.0], "en", 1), ("b", [1.0, 0.0], "en", 2), ("c", [0.0, 1.0], "hi", 3)], "key string, vec array<double>, lang string, last_access long")
    q = spark.createDataFrame([(1, [0.94, (1 - 0.94**2) ** 0.5], "en"), (2, [0.0, 1.0], "en"), (3, [0.0, 2.0], "hi"), (4, [1.0, 1.0], "fr")], "query_id long, vec array<double>, lang string")
    got = memory.cache_lookup(q, cache)
    assert {r.query_id: r.hit_key for r in got.collect()} == {1: "a", 2: None, 3: "c", 4: None}
    assert {r.key: r.last_access for r in memory.touch(cache, got, F.lit(9)).collect()} == {"a": 9, "b": 2, "c": 9}
    puts = spark.createDataFrame([(f" K{i % 300} ", i) for i in range(600)], "question string, last_access long")
    kept = memory.cache_put(puts).collect()
    assert len(kept) == 256 and min(r.last_access for r in kept) == 600 - 256


def test_memory(spark):
    turns = spark.createDataFrame([("s", i, f"q{i}", f"a{i}") for i in range(9)] + [("t", 0, "x", "y")], "session_id string, seq long, question string, answer string")
    assert sorted(r.seq for r in memory.last_turns(turns).collect() if r.session_id == "s") == list(range(3, 9))
    text = memory.recent_turns(turns).withColumn("h", memory.history_text(F.col("recent"))).collect()
    assert {r.seq: r.h for r in text if r.session_id == "s"}[2] == "Customer: q0\nAssistant: a0\nCustomer: q1\nAssistant: a1"
    assert memory.clear_sessions(turns, turns.filter("session_id = 't'")).count() == 9


def test_audio(spark):
    rnd = random.Random(1)
    rows = [("s", k, float(k * rnd.random()), rnd.random() * 2) for k in range(50)]
    end, want = 0.0, {}
    for _, k, arrive, duration in rows:
        start = max(arrive + 0.05, end)
        end = start + duration
        want[k] = (start, end)
    got = {r.seq: (r.start, r.end) for r in speech.audio_timeline(spark.createDataFrame(rows, "session_id string, seq long, arrive double, duration double")).collect()}
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(want[k], got[k]))


def test_speech_degrades(spark):
    def provider(text, language):
        if language == "xx":
            raise RuntimeError("down")
        return text.encode()

    got = {r.text: r.audio for r in speech.synthesize(spark.createDataFrame([("a", "en"), ("b", "xx")], "text string, language string"), provider).collect()}
    assert bytes(got["a"].data) == b"a" and got["a"].error is None and got["b"].data is None and "down" in got["b"].error


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "q", ["4"]), (2, "q", ["x"]), (3, "q", None), (4, "q", None)], "case_id long, question string, expect array<string>")
    answers = spark.createDataFrame([(1, "it is 4", False), (2, "no", False), (3, "sorry", True), (4, "sure!", False)], "case_id long, text string, abstained boolean")
    judged = evaluate.judge(cases, answers)
    r = evaluate.rates(judged).first()
    assert (r.answer_accuracy, r.abstention_accuracy, r.hallucination_rate) == (0.5, 0.5, 0.5)
    assert {(f.case_id, f.tag) for f in evaluate.failures(judged).collect()} == {(2, "ANSWER"), (4, "ABSTAIN")}


def test_embedding_in_batches(spark):
    def embedder(texts):
        assert len(texts) <= 90
        return [[float(len(t)), 0.0] for t in texts]

    df = spark.createDataFrame([("x" * (k + 1),) for k in range(200)], "text string")
    got = index.embed(df, embedder).select("embedding").collect()
    assert len(got) == 200 and all(abs(r.embedding[0] - 1) < 1e-6 for r in got)


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# x\nFINAL_K=7\nneighbor_expansion=false\nunknown=1\n")
    s = Settings.load(str(tmp_path / "env"), {"RRF_K": "10"})
    assert (s.final_k, s.neighbor_expansion, s.rrf_k, s.dense_k) == (7, False, 10, 25)
