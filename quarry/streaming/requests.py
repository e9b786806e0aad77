"""Questions as a stream: each micro-batch is answered as a table and its answers are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.speech import transcribe
from quarry.sources.folders import ensure_checkpoint_dir


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False, transcriber: Callable[[bytes], str] | None = None) -> StreamingQuery:
    """requests (session_id, type, text): empty texts become error rows, the others go through `answer` (query_id, session_id, question).

    With a transcriber, rows of type `audio` carry sound in `audio`: what is heard is sent back as a `transcript` row and
    then answered; a failing transcriber gives an error row. Answers are written below `out` by batch number, so that
    a batch that is run again replaces what it had written.
    """

    def batch(df: DataFrame, number: int) -> None:
        told = None
        if transcriber is not None:
            heard = transcribe(df.filter("type = 'audio'"), transcriber).withColumn("text", F.col("transcript.text"))
            failed = heard.filter("transcript.error IS NOT NULL").select("session_id", F.lit("error").alias("type"), F.col("transcript.error").alias("text"))
            heard = heard.filter("transcript.error IS NULL").select("session_id", F.lit("transcript").alias("type"), "text")
            told = heard.filter("text <> ''").unionByName(failed)
            df = df.filter("type <> 'audio'").select("session_id", "type", "text").unionByName(heard)
        rows = df.withColumns({"query_id": F.monotonically_increasing_id(), "question": F.trim("text")}).checkpoint()  # so that numbers stand; equal questions are each answered
        empty = rows.filter(F.coalesce(F.col("question"), F.lit("")) == "").select("session_id", F.lit("error").alias("type"), F.lit("empty question").alias("text"))
        asked = rows.filter("question <> ''").select("query_id", "session_id", "question")
        said = answer(asked).select("session_id", F.lit("answer").alias("type"), "text")
        said = said.unionByName(empty)
        (said if told is None else told.unionByName(said)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    ensure_checkpoint_dir(requests.sparkSession)
    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
