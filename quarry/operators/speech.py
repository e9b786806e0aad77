"""Text side of speech: routing to a voice, degrading, and the timeline of audio."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions.text import prompt_echo, speakable, spoken_sentences


def voice_request(text: Column, language: Column, limit: int = DEFAULTS.speech_max_chars) -> Column:
    """(provider, text): the spoken form; the Hinglish provider takes its first `limit` characters."""
    spoken = speakable(text)
    mixed = language == "hinglish"
    return F.struct(F.when(mixed, "hinglish").otherwise("english").alias("provider"), F.when(mixed, F.substring(spoken, 1, limit)).otherwise(spoken).alias("text"))


def synthesize(df: DataFrame, provider: Callable[[str, str], bytes], text: str = "text", language: str = "language") -> DataFrame:
    """Adds `audio`, a struct (data, error): a failing provider gives an error, never a failed job."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, languages in batches:
            data, error = [], []
            for t, lang in zip(texts, languages):
                try:
                    data.append(provider(t, lang))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a provider degrades to text
                    data.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"data": data, "error": error})

    udf = F.pandas_udf("data binary, error string")(run)
    return df.withColumn("audio", udf(F.col(text), F.col(language)))


def transcribe(df: DataFrame, provider: Callable[[bytes], str], audio: str = "audio") -> DataFrame:
    """Adds `transcript`, a struct (text, error). A text that only echoes the provider's hint counts as silence ('')."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sounds in batches:
            text, error = [], []
            for sound in sounds:
                try:
                    text.append((provider(bytes(sound)) or "").strip() if sound else "")
                    error.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a provider is told in its row
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"text": text, "error": error})

    udf = F.pandas_udf("text string, error string")(run)
    heard = df.withColumn("_heard", udf(F.col(audio)))
    text = F.col("_heard.text")
    return heard.withColumn("transcript", F.struct(F.when(prompt_echo(text), F.lit("")).otherwise(text).alias("text"), F.col("_heard.error").alias("error"))).drop("_heard")


def speak(answers: DataFrame, provider: Callable[[str, str], bytes], limit: int = DEFAULTS.speech_max_chars) -> DataFrame:
    """session_id, seq, text, audio: the sentences of each answer (session_id, text, language), synthesised one by one.

    Sentences without anything to say are left out; a sentence whose synthesis fails keeps its place with an error.
    """
    said = answers.select("session_id", "language", F.posexplode(spoken_sentences(F.col("text"))).alias("seq", "text"))
    asked = said.withColumn("_v", voice_request(F.col("text"), F.col("language"), limit)).filter(F.trim("_v.text") != "").withColumn("_say", F.col("_v.text"))
    return synthesize(asked, provider, "_say").select("session_id", "seq", "text", "audio")


def audio_timeline(pieces: DataFrame, lead: float = 0.05, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Adds `start` and `end`: each piece starts at arrival + lead or when the one before ends (columns arrive, duration)."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("duration").over(w) - F.col("duration")
    slack = pieces.withColumn("_before", before).withColumn("_late", F.max(F.col("arrive") + F.lit(lead) - F.col("_before")).over(w))
    return slack.withColumn("start", F.col("_before") + F.col("_late")).withColumn("end", F.col("start") + F.col("duration")).drop("_before", "_late")
