"""The connection loop: stream = table, restarts, equal questions, sound, idle connections."""

import base64
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarry.operators.index import embed
from quarry.plans.answer import spoken_answers
from quarry.sources import providers
from quarry.streaming import connection


def b64(text):
    return base64.b64encode(text.encode()).decode()


MESSAGES = [
    ("c1", 1, None, "question", "hello", None, None), ("c1", 2, "s1", "question", "What is it? Tell me", None, True), ("c1", 3, None, "question", "  ", None, None),
    ("c1", 4, None, "question", "What is it? Tell me", None, False), ("c1", 5, "", "question", "What is it? Tell me", None, None), ("c2", 1, "s2", "audio", None, b64("say this. And that"), None),
    ("c2", 2, None, "audio", None, b64("!noise"), None), ("c2", 3, "s3", "audio", None, "not base64 %%", None), ("c2", 4, None, "audio", None, None, None), ("c2", 5, None, "question", "no source", None, None),
    ("c3", 7, "s9", "question", None, None, None), ("c1", 6, "s4", "question", "mute me", None, None), (None, 1, "s5", "question", "what now", None, None), (None, 2, None, "question", "what now", None, None),
]


def answer(asked):
    chat = F.when(F.col("question") == "hello", "greeting")
    return asked.withColumns({"language": F.when(F.col("question").startswith("say"), "hinglish").otherwise("en"), "kind": chat, "abstain": F.col("question").contains("no source"), "raw": F.concat(F.lit("You asked. "), "question"), "passes": F.lit(True), "why": F.lit("")})


def transcriber(sound):
    if sound.startswith(b"!"):
        raise ValueError("noise")
    return sound.decode()


def voice(text, language):
    if "mute" in text:
        raise ValueError("no voice")
    return f"{language}:{text}".encode()


def rows(df):
    return sorted((tuple(None if v is None else bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in df.collect()), key=repr)


def deliver(spark, messages, path, name):
    spark.createDataFrame(messages, connection.MESSAGE).coalesce(1).write.parquet(f"{path}/in/{name}")


def serve(spark, path, answer=answer, **options):
    stream = spark.readStream.schema(connection.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    connection.serve_connections(stream, answer, f"{path}/out", f"{path}/cp", transcriber, voice, once=True, **options).awaitTermination()
    return connection.read_events(spark, f"{path}/out")


@pytest.fixture
def delivered(spark, tmp_path):
    ordered = sorted(MESSAGES, key=lambda m: m[1])
    for k, part in enumerate((ordered[:5], ordered[5:9], ordered[9:])):
        deliver(spark, part, tmp_path, f"f{k}")
        time.sleep(0.05)  # files are taken by age
    return str(tmp_path)


def test_stream_equals_table(spark, delivered):
    table = connection.converse(spark.createDataFrame(MESSAGES, connection.MESSAGE), answer, transcriber, voice)
    got = rows(serve(spark, delivered))
    assert got == rows(table) and spark.conf.get(connection.STATE_STORE, None) != connection.ROCKS
    assert rows(serve(spark, delivered)) == got  # nothing is said twice


def test_events_of_a_connection(spark):
    got = connection.converse(spark.createDataFrame(MESSAGES, connection.MESSAGE), answer, transcriber, voice).collect()
    told = {}
    for r in sorted(got, key=lambda r: (str(r.connection_id), r.request, r.seq)):
        told.setdefault((r.connection_id, r.request), []).append(r)
    kinds = {k: [r.type for r in v] for k, v in told.items()}
    assert all([r.seq for r in v] == list(range(len(v))) for v in told.values())
    assert kinds["c1", 0] == ["meta", "sentence", "audio", "done"] and told["c1", 0][0].session_id == "c1" and told["c1", 1][0].session_id == "s1" == told["c1", 4][0].session_id
    assert kinds["c1", 2] == ["error"] and told["c1", 2][0].text == connection.EMPTY
    assert kinds["c1", 1] == kinds["c1", 4] and "audio" in kinds["c1", 1] and "audio" not in kinds["c1", 3]  # equal questions are each answered
    assert kinds["c2", 0][0] == "transcript" and bytes(next(r.audio for r in told["c2", 0] if r.type == "audio")).startswith(b"hinglish:")
    assert [kinds["c2", k] for k in (1, 2, 3)] == [["error"]] * 3 and told["c2", 1][0].text == connection.UNHEARD and told["c2", 3][0].session_id == "s3"
    assert kinds["c2", 4] == ["abstain", "audio"] and kinds["c3", 0] == ["error"]
    assert "tts_failed" in kinds["c1", 5] and "audio" in kinds["c1", 5]
    assert len([k for k in told if k[0] is None]) == 2 and told[None, 1][0].session_id == "s5"


def test_restart_after_a_failure_repeats_nothing(spark, delivered):
    calls = []

    def failing(asked):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return answer(asked)

    with pytest.raises(StreamingQueryException):
        serve(spark, delivered, failing)
    got = rows(serve(spark, delivered))
    assert got == rows(connection.converse(spark.createDataFrame(MESSAGES, connection.MESSAGE), answer, transcriber, voice))


def test_idle_connections_are_closed(spark, tmp_path):
    deliver(spark, [("a", 1, "s", "question", "one", None, False), ("b", 1, "s", "question", "one", None, False)], tmp_path, "f0")
    serve(spark, tmp_path, idle_ms=1)
    time.sleep(0.1)
    deliver(spark, [("c", 2, None, "question", "two", None, False)], tmp_path, "f1")
    serve(spark, tmp_path, idle_ms=1)
    deliver(spark, [("a", 3, None, "question", "three", None, False)], tmp_path, "f2")
    got = serve(spark, tmp_path, idle_ms=1)
    closed = {(r.connection_id, r.request, r.session_id) for r in got.filter("type = 'closed'").collect()}
    assert {("a", 1, "s"), ("b", 1, "s")} <= closed
    assert {(r.request, r.session_id) for r in got.filter("connection_id = 'a' AND text = 'You asked. three'").collect()} == {(0, "a")}  # forgotten, so begun anew


def test_served_from_a_collection(spark):
    chunks = spark.createDataFrame([("k1", "The fee of a card is 12 euros a year.", "Fees", "1", "", "")], "id string, text string, header string, section_no string, prev_id string, next_id string")
    vectors = embed(chunks, providers.hashed_embedder()).select("id", "embedding")
    messages = [("c", 1, "s", "question", "What is the fee of a card?", None, False), ("c", 2, "s", "question", "hello", None, False), ("c", 3, "s", "question", "zzz qqq xxx", None, False)]
    got = connection.converse(spark.createDataFrame(messages, connection.MESSAGE), lambda asked: spoken_answers(asked, chunks, vectors)).collect()
    done = {r.request: r for r in got if r.type == "done"}
    assert "12 euros" in done[0].text and done[0].grounded and done[1].reason == "chitchat"
    assert [r.type for r in got if r.request == 2] == ["abstain"]
