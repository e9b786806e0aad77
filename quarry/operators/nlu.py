"""Understanding of questions: language, small talk, follow-ups, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions.text import find_all, strings, strip


def detect_language(x: Column) -> Column:
    """`hinglish` for Devanagari letters, two marker words, or one among at most 8 words; else `en`."""
    tokens = find_all(F.lower(x), r"[a-zA-Z']+")
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(strings(lx.HINGLISH_WORDS), t)))
    found = x.rlike(r"[ऀ-ॿ]") | (hits >= 2) | ((hits >= 1) & (hits / F.greatest(F.size(tokens), F.lit(1)) >= F.lit(0.12).cast("double")))
    return F.when(F.coalesce(found, F.lit(False)), "hinglish").otherwise("en")


def route(x: Column) -> Column:
    """Kind of small talk, or null for a question to be answered."""
    q, out = strip(x), None
    for kind, pattern in lx.ROUTES:
        test = q.rlike("(?i)" + pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def route_reply(df: DataFrame, kind: str = "kind", language: str = "language") -> DataFrame:
    """Adds `reply`: of (kind, language), or of (kind, en)."""
    replies = df.sparkSession.createDataFrame(lx.REPLIES, "_k string, _l string, _r string")
    own = F.broadcast(replies.select("_k", "_l", F.col("_r").alias("_own")))  # eight rows
    en = F.broadcast(replies.filter("_l = 'en'").select(F.col("_k").alias("_k2"), F.col("_r").alias("_en")))
    out = df.join(own, (F.col(kind) == F.col("_k")) & (F.col(language) == F.col("_l")), "left").join(en, F.col(kind) == F.col("_k2"), "left")
    return out.withColumn("reply", F.coalesce("_own", "_en")).drop("_k", "_l", "_own", "_k2", "_en")


def needs_rewrite(x: Column) -> Column:
    """Whether a question looks like a follow-up."""
    q = F.lower(strip(x))
    words = find_all(q, r"[a-zA-Z']+")
    starts = F.lit(False)
    for s in lx.FOLLOWUP_STARTERS:
        starts = starts | q.startswith(s)
    return starts | (F.size(words).between(1, 6) & F.arrays_overlap(words, strings(lx.PRONOUNS)))


def rewritten(question: Column, history: Column, proposed: Column) -> Column:
    """The standalone question: a proposal (quotes off) counts only with a history, a follow-up and a non-empty text."""
    bare = strip(F.regexp_replace(strip(proposed), r'^"+|"+$', ""))
    use = (F.coalesce(history, F.lit("")) != "") & needs_rewrite(question) & (F.coalesce(bare, F.lit("")) != "")
    return F.when(use, bare).otherwise(question)


def expand_query(x: Column) -> Column:
    """The question with what its synonyms add, in the order of the dictionary."""
    low = F.lower(x)
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in lx.SYNONYMS])
    extra = F.transform(F.filter(entries, lambda e: F.contains(low, e["k"])), lambda e: e["v"])
    return F.when(F.size(extra) > 0, F.concat(x, F.lit(" "), F.array_join(extra, " "))).otherwise(x)
