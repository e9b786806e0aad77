"""The whole exchange over tables: questions with sessions and histories in, answers out.

Cheap tests come first and cut what the costly steps see: small talk never reaches retrieval, only follow-ups reach the
rewriter, only new questions pass the cache, only grounded ones reach the generator.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULTS, Settings
from quarry.functions import text as tx
from quarry.operators import guard, memory, nlu, retrieve
from quarry.operators.cache_order import cache_replay
from quarry.operators.index import embed
from quarry.sources import providers
from quarry.sources.folders import ensure_checkpoint_dir


def _generate(df: DataFrame, generator: providers.Generator) -> DataFrame:
    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in prompts:
            yield pd.Series([(t or "").strip() for t in generator(list(batch))])

    return df.withColumn("raw", run(F.col("prompt")))


def _rewrite(df: DataFrame, rewriter: providers.Rewriter) -> DataFrame:
    @F.pandas_udf("string")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, histories in pairs:
            try:
                yield pd.Series(rewriter(list(questions), list(histories)), dtype=object)
            except Exception:  # noqa: BLE001  a failing rewriter leaves the question as it is
                yield pd.Series([None] * len(questions), dtype=object)

    asked = df.filter(nlu.needs_rewrite(F.col("question")) & (F.col("history") != ""))
    rest = df.join(asked.select("query_id"), "query_id", "left_anti").withColumn("standalone", F.col("question"))
    done = asked.withColumn("proposed", run(F.col("question"), F.col("history")))
    return rest.unionByName(done.withColumn("standalone", nlu.rewritten(F.col("question"), F.col("history"), F.col("proposed"))).drop("proposed"))


class Stages:
    """Stage marks of the exchange; by itself it lets everything pass."""

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        return df


class TimedStages(Stages):
    """Checkpoints each stage, so that later ones reuse it, and adds up its time in milliseconds."""

    def __init__(self):
        self.began, self.ms, self.kept = time.monotonic(), {}, {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(df.sparkSession)
        start = time.monotonic()
        done = df.checkpoint()
        self.kept[name] = self.kept[name].unionByName(done) if name in self.kept else done
        self.ms[name] = self.ms.get(name, 0.0) + (time.monotonic() - start) * 1000
        return done


@dataclass(frozen=True)
class Exchange:
    """What a batch of questions leaves behind, as tables."""

    answers: DataFrame
    sources: DataFrame  # query_id, final_rank, id, section, page, score, preview; none for small talk, abstained and cached answers
    sections: DataFrame  # query_id, sections
    turns: DataFrame  # session_id, seq, question, answer: the memory after the batch
    cache: DataFrame | None  # the cache after the batch
    timings: DataFrame  # stage, ms


def exchange(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, turns: DataFrame | None = None, cache: DataFrame | None = None, now: int = 0, embedder: providers.Embedder | None = None, settings: Settings = DEFAULTS, rewriter: providers.Rewriter = providers.identity_rewriter, **models) -> Exchange:
    """A batch answered whole: answers, their sources and section lines, memory and cache after it, and stage times.

    turns: session_id, seq, question, answer (the memory before the batch). cache: question, key, vec, lang, answer, last_access and, if
    there is one, last_query. Questions use the cache in the order of query_id: answers that passed both gates are stored and serve later questions,
    the oldest entries go in between (`cache_replay`). Entries stored or hit get last_access = now and last_query. chunks may have `page`.
    """
    spark, stage = questions.sparkSession, TimedStages()
    embedder = embedder or providers.hashed_embedder()
    history = None
    if turns is not None:
        last = memory.last_turns(turns, settings.memory_turns_for_rewrite)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "question", "answer"))), lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer")))  # a few turns
        history = last.groupBy("session_id").agg(memory.history_text(listed).alias("history"))
    small, asked = prepare(questions, history, embedder, rewriter, settings, stage)
    if cache is None:
        answers, stored = small.unionByName(answer_prepared(asked, chunks, vectors, embedder, settings=settings, stage=stage, **models)).checkpoint(), None
    else:
        answers, stored = _with_cache(small, asked, cache, now, settings, lambda rows: answer_prepared(rows, chunks, vectors, embedder, settings=settings, stage=stage, **models))
    shown = answers.filter("NOT abstained AND NOT cached AND reason <> 'chitchat'").select("query_id")
    page = F.col("page") if "page" in chunks.columns else F.lit(None).cast("int")
    texts = chunks.select("id", "text", "header", page.alias("page"))
    sources = guard.sources(stage.kept["retrieve"].join(shown, "query_id", "left_semi").join(texts, "id"))
    memorised = answers.filter("reason <> 'chitchat'").select("session_id", F.col("query_id").alias("_q"), "question", F.col("text").alias("answer"))
    if turns is not None:
        top = turns.groupBy("session_id").agg(F.max("seq").alias("_top"))
        memorised = memorised.join(top, "session_id", "left")
    else:
        memorised = memorised.withColumn("_top", F.lit(None).cast("long"))
    order = Window.partitionBy("session_id").orderBy("_q")
    added = memorised.withColumn("seq", F.coalesce("_top", F.lit(-1).cast("long")) + F.row_number().over(order)).select("session_id", "seq", "question", "answer")
    after = added if turns is None else turns.select("session_id", F.col("seq").cast("long").alias("seq"), "question", "answer").unionByName(added)
    stage.ms["total"] = (time.monotonic() - stage.began) * 1000
    timings = spark.createDataFrame(sorted(stage.ms.items()), "stage string, ms double")
    return Exchange(answers, sources, guard.section_line(sources), memory.last_turns(after, settings.memory_max_turns), stored, timings)


def _with_cache(small: DataFrame, asked: DataFrame, cache: DataFrame, now: int, settings: Settings, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers of a batch that uses the cache in order, and the cache after it.

    Only questions that miss are answered. Whether an answer may be stored is known once it is there, so questions not yet answered
    count as storable; where one turns out not to be, later questions may miss in turn and are answered in another round.
    """
    keyed = asked.select("query_id", F.lower(tx.strip(F.col("standalone"))).alias("key"), F.col("embedding").alias("vec"), F.col("language").alias("lang"))
    held = cache.withColumn("last_query", F.col("last_query").cast("long") if "last_query" in cache.columns else F.lit(None).cast("long"))
    known = None
    while True:
        verdicts = keyed.withColumn("cacheable", F.lit(True)) if known is None else keyed.join(known.select("query_id", "cacheable"), "query_id", "left").fillna(True, ["cacheable"])
        used = cache_replay(verdicts, held, settings.semantic_cache_size, settings.semantic_cache_threshold)
        missed = used.decisions.filter("hit_key IS NULL").select("query_id")
        if known is not None:
            missed = missed.join(known.select("query_id"), "query_id", "left_anti")
        missed = missed.checkpoint()
        if missed.isEmpty():
            break
        more = answer(asked.join(missed, "query_id")).checkpoint()
        known = more if known is None else known.unionByName(more).checkpoint()
    hits = used.decisions.filter("hit_key IS NOT NULL")
    old = hits.filter("hit_source IS NULL").join(cache.select(F.col("key").alias("hit_key"), "answer"), "hit_key").select("query_id", "answer")
    columns = ["query_id", "session_id", "question", "standalone", "language"]
    out = small
    if known is not None:
        out = out.unionByName(known.join(used.decisions.filter("hit_key IS NULL").select("query_id"), "query_id", "left_semi"))
        old = old.unionByName(hits.join(known.select(F.col("query_id").alias("hit_source"), F.col("text").alias("answer")), "hit_source").select("query_id", "answer"))
    served = asked.join(old, "query_id").select(*columns, F.col("answer").alias("text"), F.lit(False).alias("abstained"), F.lit("").alias("reason"), F.lit(True).alias("cached"), F.lit(False).alias("cacheable"))
    fields = ["question", "key", "vec", "lang", "answer", "last_access", "last_query"]
    state = used.state.withColumns({"last_query": F.col("used")})
    kept = state.filter("source IS NULL").join(held.withColumnRenamed("last_query", "_before"), "key").withColumns({"last_access": F.when(F.col("used").isNull(), F.col("last_access")).otherwise(F.lit(now)).cast("long"), "last_query": F.coalesce("used", "_before")}).select(*fields)
    if known is not None:
        fresh = known.select(F.col("query_id").alias("source"), F.col("standalone").alias("question"), F.col("text").alias("answer"))
        entries = state.filter("source IS NOT NULL").join(fresh, "source").join(keyed.select(F.col("query_id").alias("source"), "vec", "lang"), "source").withColumn("last_access", F.lit(now).cast("long"))
        kept = kept.unionByName(entries.select(*fields))
    return out.unionByName(served.select(*out.columns)).checkpoint(), kept


def prepare(questions: DataFrame, history: DataFrame | None, embedder: providers.Embedder, rewriter: providers.Rewriter, settings: Settings, stage: "Stages") -> tuple[DataFrame, DataFrame]:
    """Answered small talk, and the other questions with language, history, standalone form and embedding."""
    base = questions.select("query_id", "session_id", "question").withColumns({"language": nlu.detect_language(F.col("question")), "kind": nlu.route(F.col("question"))})
    small = nlu.route_reply(base.filter("kind IS NOT NULL")).select("query_id", "session_id", "question", F.col("question").alias("standalone"), "language", F.col("reply").alias("text"), F.lit(False).alias("abstained"), F.lit("chitchat").alias("reason"), F.lit(False).alias("cached"), F.lit(False).alias("cacheable"))
    asked = base.filter("kind IS NULL").drop("kind")
    if history is not None:
        asked = asked.join(history.select("session_id", "history"), "session_id", "left").fillna("", ["history"])
    else:
        asked = asked.withColumn("history", F.lit(""))
    return small, stage("embed", embed(stage("rewrite", _rewrite(asked, rewriter)), embedder, "standalone", settings.embedding_batch))


def answer_questions(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, history: DataFrame | None = None, cache: DataFrame | None = None,
    embedder: providers.Embedder | None = None, generator: providers.Generator = providers.first_sentence_generator, rewriter: providers.Rewriter = providers.identity_rewriter, settings: Settings = DEFAULTS, reranker: providers.Reranker | None = None, stage: "Stages | None" = None,
) -> DataFrame:
    """query_id, session_id, question, standalone, language, text, abstained, reason, cached, cacheable.

    questions: query_id, session_id, question; chunks: id, text, header, section_no, prev_id, next_id; vectors: id,
    embedding; history: session_id, history (text); cache: key, vec, lang, answer, last_access.
    """
    embedder, stage = embedder or providers.hashed_embedder(), stage or Stages()
    small, asked = prepare(questions, history, embedder, rewriter, settings, stage)
    out = small
    if cache is not None:
        found = memory.cache_lookup(asked.select("query_id", F.col("embedding").alias("vec"), F.col("language").alias("lang")), cache, settings.semantic_cache_threshold)
        hits = found.filter("hit_key IS NOT NULL").join(cache.select(F.col("key").alias("hit_key"), "answer"), "hit_key")
        known = asked.join(hits, "query_id")
        out = out.unionByName(known.select("query_id", "session_id", "question", "standalone", "language", F.col("answer").alias("text"), F.lit(False).alias("abstained"), F.lit("").alias("reason"), F.lit(True).alias("cached"), F.lit(False).alias("cacheable")))
        asked = asked.join(hits.select("query_id"), "query_id", "left_anti")
    return out.unionByName(answer_prepared(asked, chunks, vectors, embedder, generator, settings, reranker, stage))


def answer_prepared(asked: DataFrame, chunks: DataFrame, vectors: DataFrame, embedder: providers.Embedder, generator: providers.Generator = providers.first_sentence_generator, settings: Settings = DEFAULTS, reranker: providers.Reranker | None = None, stage: "Stages | None" = None) -> DataFrame:
    """Answers of prepared questions by retrieval, generation and the gates."""
    judged = said_prepared(asked, chunks, vectors, embedder, generator, settings, reranker, stage)
    decided = guard.decide(judged).withColumn("cached", F.lit(False))
    return decided.select("query_id", "session_id", "question", "standalone", "language", "text", "abstained", "reason", "cached", "cacheable")


def said_prepared(asked: DataFrame, chunks: DataFrame, vectors: DataFrame, embedder: providers.Embedder, generator: providers.Generator = providers.first_sentence_generator, settings: Settings = DEFAULTS, reranker: providers.Reranker | None = None, stage: "Stages | None" = None) -> DataFrame:
    """Prepared questions with what was generated (raw) and what the gates say of it: abstain, pre_reason, passes, why."""
    stage = stage or Stages()
    texts = asked.select("query_id", F.col("standalone").alias("text"))
    expanded = embed(texts.withColumn("asked", nlu.expand_query(F.col("text"))), embedder, "asked", settings.embedding_batch)
    hits = stage("retrieve", retrieve.retrieve(chunks, vectors, texts, expanded.select("query_id", F.col("embedding").alias("qvec")), settings, reranker))
    gate = guard.pre_gate(texts, hits, settings.rerank_abstain_threshold).withColumnRenamed("reason", "pre_reason")
    context = guard.build_context(hits.join(chunks.select("id", "text", "header"), "id"))
    ready = asked.join(gate, "query_id").join(context, "query_id", "left")
    prompt = guard.build_prompt(F.coalesce("context", F.lit("")), F.col("standalone"), F.col("language"))[1]["content"]
    said = stage("llm", _generate(ready.filter("NOT abstain").withColumn("prompt", prompt), generator).drop("prompt"))
    both = said.unionByName(ready.filter("abstain").withColumn("raw", F.lit("")))
    passes, why = guard.grounding(F.col("raw"), F.coalesce("context", F.lit("")), F.col("language"), settings.grounding_min_overlap, settings.enable_grounding_check)
    return both.withColumns({"passes": passes, "why": why})


def spoken_answers(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, history: DataFrame | None = None, embedder: providers.Embedder | None = None, rewriter: providers.Rewriter = providers.identity_rewriter, settings: Settings = DEFAULTS, **models) -> DataFrame:
    """query_id, session_id, question, language, kind, abstain, raw, passes, why: what the events of served exchanges are made of.

    The served stream never asks the cache, and sends what was generated before it is judged.
    """
    embedder = embedder or providers.hashed_embedder()
    small, asked = prepare(questions, history, embedder, rewriter, settings, Stages())
    fields = ["query_id", "session_id", "question", "language", "kind", "abstain", "raw", "passes", "why"]
    none = F.lit(None).cast("string")
    chat = small.withColumns({"kind": nlu.route(F.col("question")), "abstain": F.lit(False), "raw": none, "passes": F.lit(True), "why": F.lit("")})
    said = said_prepared(asked, chunks, vectors, embedder, settings=settings, **models).withColumn("kind", none)
    return chat.select(*fields).unionByName(said.select(*fields))
