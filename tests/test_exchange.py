from types import SimpleNamespace

import pytest

from quarry.config import Settings
from quarry.operators import chunk, memory, parse, retrieve, speech
from quarry.operators.index import embed
from quarry.plans.answer import answer_questions, exchange
from quarry.sources import folders, lines, providers
from quarry.sources.store import CollectionStore
from quarry.streaming.requests import serve

TEXT = """1. Fees
An international transfer costs $4.99 plus a share of the amount for everyone.
- Withdrawals from machines cost $2.50 each after the fourth one in a month.
Q: How long are statements kept for download?
A: Statements are kept for download for 24 months in the archive.\f2. Limits
The monthly load limit of the second tier is $5,000 for every customer."""


@pytest.fixture
def chunks(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.txt").write_text(TEXT)
    read = lines.read_lines(spark, str(tmp_path / "kb"))
    assert read.select("page").distinct().count() == 2
    return chunk.build_chunks(parse.parse_blocks(read.drop("path")))


def test_from_file_to_answers(spark, tmp_path, chunks):
    vectors = embed(chunks, providers.hashed_embedder()).select("id", "embedding")
    store = CollectionStore(str(tmp_path / "index"), "tenant", "base")
    store.overwrite(chunks.limit(1), "kb")
    store.overwrite(chunks.join(vectors, "id"), "kb")
    stored = store.read(spark, "kb")
    assert stored.count() == chunks.count() and store.path("kb").endswith("/index/tenant/base/kb")
    questions = spark.createDataFrame([(1, "s", "What does an international transfer cost?"), (2, "s", "hello"), (3, "t", "zzz qqq xxx")], "query_id long, session_id string, question string")
    docs = stored.select("id", "text", "header", "section_no", "prev_id", "next_id")
    got = {r.query_id: r for r in answer_questions(questions, docs, stored.select("id", "embedding")).collect()}
    assert "$4.99" in got[1].text and not got[1].abstained and got[1].cacheable
    assert got[2].reason == "chitchat" and got[3].abstained and got[3].reason.startswith("low_rerank_score")

    failing = {r.query_id: r for r in answer_questions(questions, docs, stored.select("id", "embedding"), history=spark.createDataFrame([("s", "Customer: x")], "session_id string, history string"), rewriter=lambda q, h: 1 / 0).collect()}
    assert failing[1].standalone == failing[1].question

    made_up = {r.query_id: r for r in answer_questions(questions, docs, stored.select("id", "embedding"), generator=lambda ps: ["It costs $77."] * len(ps)).collect()}
    assert made_up[1].abstained and made_up[1].reason == "post_gate:ungrounded_numbers=['77']"

    cache = embed(questions.filter("query_id = 1"), providers.hashed_embedder(), "question").selectExpr("'k' AS key", "embedding AS vec", "'en' AS lang", "'from cache' AS answer", "1L AS last_access")
    cached = {r.query_id: r for r in answer_questions(questions, docs, stored.select("id", "embedding"), cache=cache).collect()}
    assert cached[1].cached and cached[1].text == "from cache" and not cached[3].cached


def test_served_stream(spark, tmp_path):
    spark.createDataFrame([("s", "question", "hello"), ("s", "question", "  ")], "session_id string, type string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, type string, text string").parquet(str(tmp_path / "in"))
    serve(stream, lambda df: df.selectExpr("session_id", "concat('re: ', question) AS text"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted((r.type, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("answer", "re: hello"), ("error", "empty question")]


def test_sources(spark, tmp_path):
    cases = lines.eval_cases(spark, "How much? | 4 ; four\nWho? |\n").collect()
    assert [(c.case_id, c.question, c.expect) for c in cases] == [(0, "How much?", ["4", "four"]), (1, "Who?", None)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"p1|p2")
    (tmp_path / "x" / "b.bin").write_bytes(b"\xff")
    got = lines.read_lines(spark, str(tmp_path / "x"), lambda b: b.decode().split("|")).collect()
    assert sorted((r.page, r.raw_line) for r in got) == [(1, "p1"), (2, "p2")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        lines.read_lines(spark, str(tmp_path / "none")).collect()


def test_whole_exchange_writes_memory_and_cache_back(spark, chunks):
    vectors = embed(chunks, providers.hashed_embedder()).select("id", "embedding")
    questions = spark.createDataFrame([(1, "s", "What does an international transfer cost?"), (2, "s", "hello"), (3, "t", "zzz qqq xxx")], "query_id long, session_id string, question string")
    turns = spark.createDataFrame([("s", 4, "old question", "old answer")], "session_id string, seq long, question string, answer string")
    cache = spark.createDataFrame([], "question string, key string, vec array<double>, lang string, answer string, last_access long")
    called = []

    def reranker(question, documents):
        if "transfer" not in question:
            raise ValueError("nothing to rank")
        return [(k, 0.9 if "international" in d else 0.0) for k, d in reversed(list(enumerate(documents)))][:-1] + [(0, 0.9 if "international" in documents[0] else 0.0), (99, 1.0)]

    first = exchange(questions, chunks, vectors, turns, cache, now=7, reranker=reranker, rewriter=providers.prompted_rewriter(lambda ps: called.extend(ps) or ["x"] * len(ps)))
    answers = {r.query_id: r for r in first.answers.collect()}
    assert "$4.99" in answers[1].text and answers[2].reason == "chitchat" and answers[3].abstained
    sources = first.sources.collect()
    assert {r.query_id for r in sources} == {1} and min((r.final_rank, r.score) for r in sources) == (0, 0.9) and all(r.page >= 1 for r in sources)
    assert [r.query_id for r in first.sections.collect()] == [1]
    assert sorted((r.session_id, r.seq, r.question) for r in first.turns.collect()) == [("s", 4, "old question"), ("s", 5, "What does an international transfer cost?"), ("t", 0, "zzz qqq xxx")]
    assert [(r.key, r.last_access) for r in first.cache.collect()] == [("what does an international transfer cost?", 7)]
    assert {r.stage for r in first.timings.collect()} == {"rewrite", "embed", "retrieve", "llm", "total"}
    again = exchange(questions, chunks, vectors, first.turns, first.cache, now=9)
    assert {r.query_id: r.cached for r in again.answers.collect()} == {1: True, 2: False, 3: False}
    assert [(r.key, r.last_access) for r in again.cache.collect()] == [("what does an international transfer cost?", 9)]


def test_chunk_ids_are_unique_over_documents(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    for name in "ab":
        (tmp_path / "kb" / f"{name}.txt").write_text(TEXT.replace("4.99", "7.77") if name == "b" else TEXT)
    both = chunk.build_chunks(parse.parse_blocks(lines.read_lines(spark, str(tmp_path / "kb")).drop("path")))
    rows = both.collect()
    assert len({r.id for r in rows}) == len(rows) and len({r.doc_id for r in rows}) == 2
    of = {r.id: r.doc_id for r in rows}
    assert all(of[n] == r.doc_id for r in rows for n in (r.prev_id, r.next_id) if n)
    vectors = embed(both, providers.hashed_embedder()).select("id", "embedding")
    questions = spark.createDataFrame([(1, "s", "What does an international transfer cost?")], "query_id long, session_id string, question string")
    assert answer_questions(questions, both, vectors).count() == 1


def test_audio_in_the_served_stream_and_spoken_answers(spark, tmp_path):
    rows = [("s", "audio", None, bytearray(b"hello")), ("s", "audio", None, bytearray(b"!")), ("t", "question", "hi", None), ("u", "audio", None, None)]
    schema = "session_id string, type string, text string, audio binary"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))

    def transcriber(sound):
        if sound == b"!":
            raise ValueError("no speech")
        return sound.decode()

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    serve(stream, lambda df: df.selectExpr("session_id", "concat('re: ', question) AS text"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True, transcriber=transcriber).awaitTermination()
    got = sorted((r.session_id, r.type, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s", "answer", "re: hello"), ("s", "error", "ValueError: no speech"), ("s", "transcript", "hello"), ("t", "answer", "re: hi"), ("u", "error", "empty question")]
    answers = spark.createDataFrame([("s", "First one. Second one!", "en"), ("t", None, "en")], "session_id string, text string, language string")
    spoken = speech.speak(answers, lambda text, language: text.encode() if "Second" not in text else 1 / 0).collect()
    assert [(r.seq, r.text, r.audio.data and bytes(r.audio.data), bool(r.audio.error)) for r in sorted(spoken, key=lambda r: r.seq)] == [(0, "First one.", b"First one.", False), (1, "Second one!", None, True)]


def test_tables_of_files_and_shared_folders(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "b.bin").write_bytes(b"broken")
    found = lines.read_tables(spark, str(tmp_path), lambda b: [(1, 10, 20, [["h", None], ["1", "2"]]), (1, 30, 40, [["z"]])] if b == b"x" else 1 / 0).collect()
    assert sorted((r.page, r.table_no, r.top, r.bottom, r.rows) for r in found) == [(1, 1, 10.0, 20.0, [["h", None], ["1", "2"]]), (1, 2, 30.0, 40.0, [["z"]])]

    class Conf(dict):
        pass

    def session(**conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: Conf({k.replace("_", "."): v for k, v in conf.items()})))

    assert folders.shared_base(session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            folders.shared_base(session(spark_master=master))
    assert folders.shared_base(session(spark_master="local[2]"))


def test_order_links_and_large_caches(spark, monkeypatch):
    ids = spark.range(0, 1000, 3).repartition(7).toDF("id")
    got = {r.id: (r.prev_id, r.next_id) for r in retrieve.link_by_order(ids).collect()}
    assert got == {i: (i - 3 if i else None, i + 3 if i < 999 else None) for i in range(0, 1000, 3)}
    assert retrieve.link_by_order(ids.limit(0)).count() == 0
    vec = lambda k: [float(k % 5), float(k % 3), 1.0]
    cache = spark.createDataFrame([(f"k{k}", vec(k), "en" if k % 2 else "hinglish", k) for k in range(40)], "key string, vec array<double>, lang string, last_access long")
    questions = spark.createDataFrame([(k, vec(k), "en" if k % 3 else "xx") for k in range(20)], "query_id long, vec array<double>, lang string")
    assert sorted(memory.cache_lookup(questions, cache, broadcast_entries=7).collect()) == sorted(memory.cache_lookup(questions, cache).collect())


def test_cache_serves_later_questions_of_a_batch(spark, chunks):
    vectors = embed(chunks, providers.hashed_embedder()).select("id", "embedding")
    fee, limit = "What does an international transfer cost?", "How long are statements kept for download?"
    asked = [(1, "s", fee), (2, "t", "zzz qqq xxx"), (3, "u", "  " + fee.upper()), (4, "u", limit), (5, "v", fee), (6, "v", "zzz qqq xxx")]
    questions = spark.createDataFrame(asked, "query_id long, session_id string, question string")
    cache = spark.createDataFrame([], "question string, key string, vec array<double>, lang string, answer string, last_access long")

    def embedder(texts):
        return providers.hashed_embedder()([t.strip().lower() for t in texts])

    got = exchange(questions, chunks, vectors, None, cache, now=5, embedder=embedder)
    rows = {r.query_id: r for r in got.answers.collect()}
    assert {k: r.cached for k, r in rows.items()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert rows[3].text == rows[1].text and rows[2].abstained and rows[6].abstained and not rows[3].cacheable
    assert {(r.key, r.last_access, r.last_query) for r in got.cache.collect()} == {(limit.lower(), 5, 4), (fee.lower(), 5, 5)}
    small = exchange(questions, chunks, vectors, None, cache, now=5, embedder=embedder, settings=Settings(semantic_cache_size=1))
    assert {r.query_id: r.cached for r in small.answers.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert [(r.key, r.last_query) for r in small.cache.collect()] == [(fee.lower(), 5)]
