"""The events of an exchange, in the order in which a client receives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import streamed_sentences, strip
from quarry.operators.guard import abstain_text
from quarry.operators.nlu import route_reply


def exchange_events(asked: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """keys, seq, type, text, language, grounded, reason.

    asked: keys, question, language, kind (small talk or null), abstain, raw (the generated text), passes, why.
    Small talk: meta, sentence, done. No ground before generation: abstain. Else: meta, then a token event for each
    word and a sentence event after the token that completes it, then done, which tells whether the text was grounded.
    """
    rows = route_reply(asked, "kind", "language")

    def event(kind: str, text: Column, grounded: Column | None = None, reason: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), (grounded if grounded is not None else F.lit(None).cast("boolean")).alias("grounded"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"))

    none = F.lit(None).cast("string")
    raw = F.col("raw")
    said = F.flatten(F.transform(streamed_sentences(raw), lambda s: F.concat(F.transform(F.split(s, "(?<= )", -1), lambda t: event("token", t)), F.array(event("sentence", s)))))
    events = (
        F.when(F.col("kind").isNotNull(), F.array(event("meta", none), event("sentence", F.col("reply")), event("done", F.col("reply"), F.lit(True), F.lit("chitchat"))))
        .when(F.col("abstain"), F.array(event("abstain", abstain_text(F.col("language")))))
        .otherwise(F.concat(F.array(event("meta", none)), said, F.array(event("done", strip(raw), F.col("passes"), F.col("why")))))
    )
    out = rows.select(*keys, "language", F.posexplode(events).alias("seq", "e"))
    return out.select(*keys, F.col("seq").cast("long").alias("seq"), "e.type", "e.text", "language", "e.grounded", "e.reason")
