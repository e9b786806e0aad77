"""Conversation memory as keyed state of a stream: the last turns of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.config import DEFAULTS
from quarry.streaming.replay import replay

FIELDS = ["seq", "question", "answer"]


def remember(turns: DataFrame, n: int = DEFAULTS.memory_max_turns, idle_ms: int | None = None) -> DataFrame:
    """A stream of turns (session_id, seq, question, answer) to snapshots of each session touched: version and its last n turns.

    idle_ms: a session without a turn for so long by the clock loses its state, and begins with an empty memory if it comes
    back; its versions go on rising, as they follow the clock. None keeps sessions for ever. Timers keep an availableNow
    stream running unless `spark.sql.streaming.noDataMicroBatches.enabled` is off.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, seqs, questions, answers = state.get if state.exists else (0, [], [], [])
        held = list(zip(seqs, questions, answers))
        new = pd.concat(list(batches))
        held = sorted(held + list(new[FIELDS].itertuples(index=False, name=None)))[-n:]
        version = version + 1 if idle_ms is None else max(version + 1, state.getCurrentProcessingTimeMs())
        seqs, questions, answers = ([h[k] for h in held] for k in range(3))
        state.update((version, [int(s) for s in seqs], list(questions), list(answers)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": key[0], "version": version, "seq": seqs, "question": questions, "answer": answers})

    return turns.groupBy("session_id").applyInPandasWithState(update, "session_id long, version long, seq long, question string, answer string", "version long, seqs array<long>, questions array<string>, answers array<string>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each session."""
    newest = F.max("version").over(Window.partitionBy("session_id"))
    return snapshots.withColumn("_v", newest).filter("version = _v").drop("_v", "version")


def replay_turns(turns: DataFrame) -> DataFrame:
    return latest(replay(turns.select("session_id", *FIELDS), remember))
