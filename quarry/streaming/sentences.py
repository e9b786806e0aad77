"""Incremental sentence segmentation of token streams, with a buffer for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.streaming.replay import replay

END = "\0end"


def cut(buffer: str) -> tuple[list[str], str]:
    """Whole sentences (ended by . ! or ? before a blank), and what is left."""
    out = []
    start = 0
    for i in range(len(buffer) - 1):
        if buffer[i] in ".!?" and buffer[i + 1] == " ":
            out.append(buffer[start : i + 1].strip())
            start = i + 1
    rest = buffer[start:]
    return [s for s in out if s], rest.lstrip() if out else rest


def _segment(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    buffer, pos = state.get if state.exists else ("", 0)
    tokens = pd.concat(list(batches)).sort_values("seq")
    found: list[str] = []
    text = buffer + "".join(t for t in tokens["token"] if t != END)
    sentences, buffer = cut(text)
    found += sentences
    if (tokens["token"] == END).any():
        if buffer.strip():
            found.append(buffer.strip())
        buffer = ""
    state.update((buffer, pos + len(found)))
    if found:
        yield pd.DataFrame({"session_id": key[0], "pos": range(pos, pos + len(found)), "sentence": found})


def segment(tokens: DataFrame) -> DataFrame:
    """Sentences (session_id, pos, sentence) of a stream (session_id, seq, token); the token END flushes a session.

    Tokens of a session must arrive in the order of seq from one micro-batch to the next (see `segment_unordered`).
    """
    return tokens.groupBy("session_id").applyInPandasWithState(_segment, "session_id string, pos long, sentence string", "buffer string, pos long", "append", GroupStateTimeout.NoTimeout)


def segment_unordered(tokens: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """Sentences of a stream (session_id, seq, token) whose tokens arrive in any order over micro-batches, and may arrive twice.

    A session's tokens are numbered from 0 without gaps, the last is END. What is ahead of a gap is held until the gap is filled. A session
    that is idle for `wait_ms` is ended as it stands: what it holds follows in order, gaps left out, and its state goes. A session that
    has ended is remembered for as long, so that late copies of its tokens say nothing again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, pos, place, ended, seqs, waiting = state.get if state.exists else ("", 0, 0, False, [], [])
        held = dict(zip(seqs, waiting))
        if state.hasTimedOut:
            ready, over = sorted(held), True
        else:
            for batch in batches:
                held.update((s, t) for s, t in zip(batch["seq"].tolist(), batch["token"]) if s >= place and not ended)
            ready, over = [], False
            while place in held and not over:
                ready.append(place)
                over = held[place] == END
                place += 1
        found, buffer = cut(buffer + "".join(held.pop(s) or "" for s in ready if held[s] != END))
        if over and buffer.strip():
            found.append(buffer.strip())
        if state.hasTimedOut:
            state.remove()
        else:
            if over:
                buffer, ended, held = "", True, {}
            state.update((buffer, pos + len(found), place, ended, sorted(held), [held[s] for s in sorted(held)]))
            state.setTimeoutDuration(wait_ms)
        if found:
            yield pd.DataFrame({"session_id": key[0], "pos": range(pos, pos + len(found)), "sentence": found})

    return tokens.groupBy("session_id").applyInPandasWithState(run, "session_id string, pos long, sentence string", "buffer string, pos long, place long, ended boolean, seqs array<long>, waiting array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay_tokens(tokens: DataFrame) -> DataFrame:
    """The stream over a bounded token table, flushed at each session's end. Files hold ranges of seq, so order holds."""
    ends = tokens.groupBy("session_id").agg((F.max("seq") + 1).alias("seq")).withColumn("token", F.lit(END))
    whole = tokens.unionByName(ends).repartition("session_id").sortWithinPartitions("session_id", "seq")
    return replay(whole, segment, files_per_trigger=1_000)
