"""Conversation memory and the semantic cache, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions.text import strip
from quarry.operators.retrieve import dot


def last_turns(turns: DataFrame, n: int = DEFAULTS.memory_max_turns, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The latest n turns of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def turn_text(question: Column, answer: Column, user: str = "Customer", assistant: str = "Assistant") -> Column:
    return F.concat(F.lit(f"{user}: "), question, F.lit(f"\n{assistant}: "), answer)


def recent_turns(turns: DataFrame, n: int = DEFAULTS.memory_turns_for_rewrite, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Adds `recent`: the n turns before each turn, oldest first, as structs (question, answer)."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("recent", F.collect_list(F.struct("question", "answer")).over(w))


def history_text(recent: Column, user: str = "Customer", assistant: str = "Assistant") -> Column:
    return F.array_join(F.transform(recent, lambda t: turn_text(t["question"], t["answer"], user, assistant)), "\n")


def clear_sessions(turns: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    return turns.join(sessions.select(session).distinct(), session, "left_anti")


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(eps))


def cache_lookup(questions: DataFrame, cache: DataFrame, threshold: float = DEFAULTS.semantic_cache_threshold, broadcast_entries: int = 4 * DEFAULTS.semantic_cache_size) -> DataFrame:
    """query_id, hit_key, sim: the most similar entry of the question's language, null key when below the threshold.

    questions: query_id, vec, lang; cache: key, vec, lang, last_access. A cache is broadcast after a count of its entries;
    a larger one is cut into blocks, and each block meets every question of its language by an equi-join. Of equal
    similarities the entry used longest ago wins. A batch looks up one state of the cache.
    """
    entries = cache.select(F.col("key").alias("hit_key"), F.col("vec").alias("_v"), F.col("lang"), F.col("last_access").alias("_t"))
    count = entries.count()
    if count <= broadcast_entries:
        pairs = questions.join(F.broadcast(entries), "lang", "left")
    else:
        blocks = -(-count // broadcast_entries)
        asked = questions.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = asked.join(entries.withColumn("_block", F.pmod(F.xxhash64("hit_key"), F.lit(blocks)).cast("int")), ["lang", "_block"], "left").drop("_block")
    sims = pairs.withColumn("sim", F.round(cosine(F.col("vec"), F.col("_v")), 6))
    top = sims.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("sim"), "_t", "hit_key"))).filter("_rn = 1")
    hit = F.col("sim") >= F.lit(threshold)
    return top.select("query_id", F.when(hit, F.col("hit_key")).alias("hit_key"), F.when(hit, F.col("sim")).alias("sim"))


def touch(cache: DataFrame, looked_up: DataFrame, now: Column) -> DataFrame:
    """Entries that were hit move to the end of the order of use."""
    used = looked_up.filter("hit_key IS NOT NULL").select(F.col("hit_key").alias("key")).distinct().withColumn("_hit", F.lit(True))
    return cache.join(used, "key", "left").withColumn("last_access", F.when(F.col("_hit"), now).otherwise(F.col("last_access"))).drop("_hit")


def cache_put(entries: DataFrame, size: int = DEFAULTS.semantic_cache_size, question: str = "question") -> DataFrame:
    """The cache after all `entries` (question, ..., last_access): latest of each key, the `size` most recent keys."""
    keyed = entries.withColumn("key", F.lower(strip(F.col(question))))
    latest = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("last_access")))).filter("_rn = 1").drop("_rn")
    return latest.orderBy(F.desc("last_access"), "key").limit(size)


def admit(answers: DataFrame) -> DataFrame:
    """Answers that may be stored: both gates passed and not from the cache."""
    return answers.filter(F.col("cacheable") & ~F.col("cached"))
