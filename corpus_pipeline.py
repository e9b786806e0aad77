"""Corpus pipeline over `documents`: from raw texts to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of `docs`;
the last returns doc_id, n_tokens and the ids. Texts and n_chars change with the lines that go. A document whose lines
are all copies of earlier lines stays as an empty text. SQL cannot express the classifier, so there is no ORACLE_SQL.

Edge cases, the same in every stage: a null text counts as empty (it is clean, has no lines to lose, no near-duplicates and no
tokens, and weighs one token in mixing); rows that repeat, or share an id, are rows of their own, and of equal texts near-dedup
keeps the one of least id; a row without an id is never a near-duplicate that goes; an empty table stays empty; further columns pass through
unchanged, whatever their names, and only the last stage leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir, table, unused
from quarry.llm.bpe import bpe_encode
from quarry.llm.linededup import dedup_lines
from quarry.llm.mixing import free_prefix, mix_documents
from quarry.llm.neardup import near_duplicates
from quarry.llm.queries import TOXIC_FROM
from quarry.llm.toxicity import fit_toxicity, held_out, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    score = unused(docs, "_toxicity")
    return score_toxicity(docs, model, score_column=score).filter(F.col(score) < TOXIC_FROM).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; rows that share an id are judged each by its text."""
    text = unused(docs, "_text_of")
    named = docs.withColumn(text, F.xxhash64("text"))
    gone = near_duplicates(named.select("doc_id", "text", text), carry=(text,)).filter(~F.col("kept")).select("doc_id", text)
    return named.join(gone, ["doc_id", text], "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token mass meets the targets of source, language and topic, as far as whole values reach them."""
    return mix_documents(docs, table(spark, sf_dir, "embeddings"), bounded=True).filter(F.col(f"{free_prefix(docs)}kept")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is checkpointed before the next reads it, so each stage runs once."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = docs.checkpoint()
    return docs
