"""The connection loop as a stream: messages of clients in, numbered events out, in order over micro-batches.

A message (connection_id, arrived, session_id, type, text, data, audio_reply) names its session or stays in the last one that its connection
named; the first default is the connection itself. Sound is transcribed first. Each message becomes one request: an error, or the
events of its exchange, after each sentence or refusal the sound of it (`audio`) or `tts_failed`, in the language of
the exchange. Every message is answered, equal ones too.

`number_requests` keeps the session and the request number of each connection as state; a connection that is idle for
`idle_ms` is closed: a `closed` event is sent and its state is dropped (with `once`, when other messages come). `serve_connections` runs that state in front of
the answering of each micro-batch, which is a table; its output folders are named by batch number, so a batch that is
run again after a failure replaces what it had written. `converse` is the same over a bounded table.

Edge cases: a null text or sound counts as empty; what cannot be heard or is not Base64 is an error event; a null audio_reply
asks for sound; messages of a connection that arrive in one micro-batch go by `arrived`, ties by text; a null connection_id is a connection of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from quarry.functions.text import strip
from quarry.operators.speech import synthesize, transcribe
from quarry.sources.folders import ensure_checkpoint_dir
from quarry.streaming.events import exchange_events

MESSAGE = "connection_id string, arrived long, session_id string, type string, text string, data string, audio_reply boolean"
REQUEST = "connection_id string, request long, session_id string, type string, text string, data string, audio_reply boolean"
EVENT = "connection_id string, request long, seq long, session_id string, type string, text string, language string, grounded boolean, reason string, audio binary"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Fixed texts of the two error events.
UNHEARD = "Sorry, I couldn't hear that clearly — could you try again?"
EMPTY = "Empty question."

FIELDS = ["connection_id", "request", "session_id", "type", "text", "data", "audio_reply"]
ORDER = ["arrived", "type", "text", "data", "session_id"]


class Connections(StatefulProcessor):
    """State of a connection: the session it is in and the number of its next request."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("connection", "session string, request long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (name,) = key
        session, request = self.state.get() if self.state.exists() else (name, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(ORDER, na_position="first").itertuples():
            session = r.session_id or session
            out.append((name, request, session, r.type, r.text, r.data, r.audio_reply))
            request += 1
        self.state.update((session, request))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=FIELDS).astype({"audio_reply": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, request = self.state.get() if self.state.exists() else (key[0], 0)
        self.state.clear()
        yield pd.DataFrame([(key[0], request, session, "closed", None, None, None)], columns=FIELDS).astype({"audio_reply": "boolean"})

    def close(self) -> None:
        pass


def number_requests(messages: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """A stream of messages with sessions and request numbers (REQUEST)."""
    return messages.groupBy("connection_id").transformWithStateInPandas(Connections(idle_ms), REQUEST, "Append", "ProcessingTime")


def _event(kind: str, text: Column) -> list[Column]:
    none = lambda t: F.lit(None).cast(t)
    return [F.lit(kind).alias("type"), text.alias("text"), none("string").alias("language"), none("boolean").alias("grounded"), none("string").alias("reason")]


def respond(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], transcriber: Callable[[bytes], str] | None = None, voice: Callable[[str, str], bytes] | None = None) -> DataFrame:
    """EVENT rows of requests (REQUEST).

    answer(query_id, session_id, question) gives query_id and what `exchange_events` needs: language, kind, abstain, raw, passes, why.
    Without a voice no sound is sent.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    at = ["connection_id", "request"]
    rows = requests.withColumn("query_id", F.concat_ws("#", F.coalesce("connection_id", F.lit("")), F.col("connection_id").isNull().cast("string"), "request"))
    spoken = rows.filter("type = 'audio'")
    told = rows.filter("type IS NULL OR type NOT IN ('audio', 'closed')").withColumn("question", strip(F.coalesce("text", F.lit(""))))
    first = rows.filter("type = 'closed'").select(*at, "session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), *_event("closed", F.lit(None).cast("string")))
    columns = ["query_id", *at, "session_id", "audio_reply", "question"]
    asked = told.select(*columns)
    if transcriber is None:
        heard = spoken.withColumn("question", F.lit(""))
    else:
        sound = F.expr("try_to_binary(regexp_replace(coalesce(data, ''), '^data:[^,]*,', ''), 'base64')")
        heard = transcribe(spoken.withColumn("audio", sound), transcriber).withColumn("question", F.when(F.col("transcript.error").isNull(), strip(F.coalesce("transcript.text", F.lit("")))).otherwise(F.lit("")))
    heard = heard.select(*columns).checkpoint()  # heard once
    unheard = heard.filter("question = ''").select(*at, "session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), *_event("error", F.lit(UNHEARD)))
    empty = asked.filter("question = ''").select(*at, "session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), *_event("error", F.lit(EMPTY)))
    transcripts = heard.filter("question <> ''").select(*at, "session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), *_event("transcript", F.col("question")))
    clear = asked.unionByName(heard).filter("question <> ''").checkpoint()
    said = exchange_events(answer(clear.select("query_id", "session_id", "question")), ("query_id",))
    said = said.join(clear.drop("question"), "query_id").select(*at, "session_id", F.lit(1).alias("part"), F.col("seq").alias("pos"), "type", "text", "language", "grounded", "reason", "audio_reply")
    plain = first.unionByName(unheard).unionByName(empty).unionByName(transcripts).unionByName(said.drop("audio_reply")).withColumn("audio", F.lit(None).cast("binary"))
    if voice is not None:
        loud = said.filter(F.coalesce("audio_reply", F.lit(True)) & F.col("type").isin("sentence", "abstain")).withColumn("language", F.coalesce("language", F.lit("en")))
        sounds = synthesize(loud, voice, "text", "language").withColumns({"type": F.when(F.col("audio.error").isNull(), "audio").otherwise("tts_failed"), "sound": F.col("audio.data")})
        none = F.lit(None).cast("string")
        plain = plain.unionByName(sounds.select(*at, "session_id", F.lit(1).alias("part"), "pos", "type", none.alias("text"), none.alias("language"), F.lit(None).cast("boolean").alias("grounded"), none.alias("reason"), F.col("sound").alias("audio")))
    after = F.col("type").isin("audio", "tts_failed").cast("int")  # sound follows its sentence
    seq = F.row_number().over(Window.partitionBy(*at).orderBy("part", "pos", after)) - 1
    return plain.withColumn("seq", seq.cast("long")).select("connection_id", "request", "seq", "session_id", "type", "text", "language", "grounded", "reason", "audio")


def converse(messages: DataFrame, answer, transcriber=None, voice=None) -> DataFrame:
    """The events of all messages of a table."""
    w = Window.partitionBy("connection_id").orderBy(*[F.asc_nulls_first(c) for c in ORDER])
    named = F.last(F.when(F.col("session_id") != "", F.col("session_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = messages.withColumns({"request": (F.row_number().over(w) - 1).cast("long"), "session_id": F.coalesce(named, "connection_id")})
    return respond(numbered.select(*FIELDS), answer, transcriber, voice)


def serve_connections(messages: DataFrame, answer, out: str, checkpoint: str, transcriber=None, voice=None, idle_ms: int = 3_600_000, once: bool = False) -> StreamingQuery:
    """Answer a stream of messages (MESSAGE); events (EVENT) go below `out` by batch number."""
    spark = messages.sparkSession

    def batch(requests: DataFrame, number: int) -> None:
        held = requests.checkpoint()  # numbered once
        respond(held, answer, transcriber, voice).write.mode("overwrite").parquet(f"{out}/batch={number}")

    ensure_checkpoint_dir(spark)
    wanted = {STATE_STORE: ROCKS}  # the only store that holds timers
    if once:
        wanted[EMPTY_BATCHES] = "false"  # with timers by the clock they never end
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)  # a stream keeps the settings that it was started with
    try:
        writer = number_requests(messages, idle_ms).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_events(spark, out: str) -> DataFrame:
    return spark.read.schema(EVENT + ", batch long").parquet(out).drop("batch")
