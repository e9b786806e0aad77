"""Gates before and after generation, prompts, decisions and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import lexicon as lx
from quarry.functions.text import find_all, normalize_number, strings, strip

SYSTEM_PROMPT = """You answer questions of customers. Use only the numbered passages of the user's message; they are all
you know. If they do not hold the whole answer, say exactly the given refusal and nothing else. Quote amounts, limits and
periods as they stand, never estimate. Do not speak of passages or sources. Be brief, warm and plain, without lists or
markup, and keep to the language asked for."""
ANSWER_TEMPLATE = "Passages:\n\n{context}\n\n---\nQuestion: {question}\n\nLanguage: {language}\n\nIf the passages do not hold the answer, reply exactly:\n\"{abstain}\""
LANGUAGE_INSTRUCTIONS = {"en": "Respond in English.", "hinglish": "Respond in natural Hinglish, in Latin script, with amounts and terms as they are."}


def by_language(language: Column, texts: dict[str, str]) -> Column:
    """The text of a language; `en` for all others."""
    out = F.lit(texts["en"])
    for name, text in texts.items():
        if name != "en":
            out = F.when(language == name, text).otherwise(out)
    return out


def abstain_text(language: Column) -> Column:
    return by_language(language, lx.ABSTAIN)


def build_context(hits: DataFrame) -> DataFrame:
    """query_id, context: `[Passage i | header]` and text of each hit, in order (hits: query_id, final_rank, header, text)."""
    passages = F.array_sort(F.collect_list(F.struct("final_rank", F.coalesce("header", F.lit(lx.DEFAULT_HEADER)).alias("header"), "text")))  # a query's few hits
    joined = F.array_join(F.transform(passages, lambda h, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit(" | "), h["header"], F.lit("]\n"), h["text"])), "\n\n")
    return hits.groupBy("query_id").agg(joined.alias("context"))


def build_prompt(context: Column, question: Column, language: Column, system: str = SYSTEM_PROMPT, template: str = ANSWER_TEMPLATE) -> Column:
    """Messages as an array of (role, content)."""
    user: Column = F.lit(template)
    for name, value in (("{language}", by_language(language, LANGUAGE_INSTRUCTIONS)), ("{abstain}", abstain_text(language)), ("{question}", question), ("{context}", context)):
        user = F.replace(user, F.lit(name), value)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def pre_gate(queries: DataFrame, hits: DataFrame, threshold: float = DEFAULTS.rerank_abstain_threshold) -> DataFrame:
    """query_id, abstain, reason: no hits, or a best score below the threshold."""
    top = hits.groupBy("query_id").agg(F.max("rerank_score").alias("top"))
    out = queries.select("query_id").join(top, "query_id", "left")
    low = F.col("top") < F.lit(threshold)
    reason = F.when(F.col("top").isNull(), "no_hits").when(low, F.format_string("low_rerank_score=%.2f", F.bround("top", 2))).otherwise("")
    return out.select("query_id", (F.col("top").isNull() | low).alias("abstain"), reason.alias("reason"))


def numbers(x: Column, strict: bool = False) -> Column:
    return F.array_distinct(F.filter(F.transform(find_all(x, lx.NUMBER), lambda n: normalize_number(n, strict)), lambda n: n != ""))


def ungrounded_numbers(answer: Column, context: Column, strict: bool = False) -> Column:
    """Sorted numbers of the answer that the context lacks; 0 to 3 need no ground."""
    return F.array_sort(F.array_except(F.array_except(numbers(answer, strict), strings(["0", "1", "2", "3"])), numbers(F.lower(context), strict)))


def content_words(x: Column) -> Column:
    return F.array_except(F.array_distinct(find_all(F.lower(x), r"[a-z]{3,}")), strings(lx.STOP_WORDS))


def overlap_ratio(answer: Column, context: Column, language: Column | None = None) -> Column:
    """Share of the answer's content words that the context has; null without any."""
    words = content_words(answer)
    if language is not None:
        words = F.when(language == "hinglish", F.array_except(words, strings(lx.HINGLISH_WORDS))).otherwise(words)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(context))) / F.size(words))


def grounding(answer: Column, context: Column, language: Column, least: float = DEFAULTS.grounding_min_overlap, enabled: bool = DEFAULTS.enable_grounding_check, strict: bool = False) -> tuple[Column, Column]:
    """(passes, reason)."""
    if not enabled:
        return F.lit(True), F.lit("")
    abstained = strip(answer) == abstain_text(language)
    missing = ungrounded_numbers(answer, context, strict)
    ratio = overlap_ratio(answer, context, language)
    low = F.coalesce(ratio < F.lit(least), F.lit(False))
    passes = abstained | ((F.size(missing) == 0) & ~low)
    listed = F.concat(F.lit("ungrounded_numbers=['"), F.array_join(missing, "', '"), F.lit("']"))
    reason = F.when(abstained, "abstained").when(F.size(missing) > 0, listed).when(low, F.format_string("low_overlap=%.2f", F.bround(ratio, 2))).otherwise("")
    return passes, reason


def decide(df: DataFrame) -> DataFrame:
    """Adds `text`, `abstained`, `reason`, `cacheable` from raw, abstain, pre_reason, passes, why, language.

    A model's own refusal counts as abstained (and may be cached); a failed gate replaces the text.
    """
    refusal = abstain_text(F.col("language"))
    own = strip(F.col("raw")) == refusal
    failed = F.col("abstain") | ~F.col("passes")
    return df.withColumns({
        "text": F.when(failed, refusal).otherwise(F.col("raw")),
        "abstained": failed | own,
        "reason": F.when(F.col("abstain"), F.col("pre_reason")).when(~F.col("passes"), F.concat(F.lit("post_gate:"), "why")).when(own, "llm_self_abstained").otherwise(""),
        "cacheable": ~failed,
    })


def sources(hits: DataFrame) -> DataFrame:
    """query_id, id, section, page, score (3 digits, half to even), preview."""
    return hits.select("query_id", "final_rank", "id", F.coalesce("header", F.lit("")).alias("section"), F.coalesce("page", F.lit(0)).alias("page"), F.bround("rerank_score", 3).alias("score"), F.substring("text", 1, 150).alias("preview"))


def section_line(listed: DataFrame) -> DataFrame:
    """query_id, sections: distinct non-empty section names in order, joined by a middle dot."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "section"))), lambda s: s["section"])  # a query's few sources
    return listed.groupBy("query_id").agg(F.array_join(F.array_distinct(F.filter(names, lambda n: n != "")), " · ").alias("sections"))
