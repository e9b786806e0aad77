"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._arrow import table
from quarry.llm.additive import op6_nearest
from quarry.llm.linededup import OP8_SQL, op8_line_dedup
from quarry.llm.maxscore import OP2_SQL, op2_exact_top_k
from quarry.llm.mixing import OP10_SQL, op10_mixing
from quarry.llm.positional import OP11_SQL, op11_decontaminate
from quarry.llm.resampling import OP12_SQL, op12_resample


#: Scores from here on are rejected.
TOXIC_FROM = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import fit_toxicity, held_out, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_toxicity(docs.select("doc_id", "text"), model, keep=("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.wrappers import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_main_text": op3_main_text,
    "op4_near_dedup": op4_near_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_nearest": op6_nearest,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_decontaminate": op11_decontaminate,
    "op12_resample": op12_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": OP2_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op11_decontaminate": OP11_SQL,
    "op12_resample": OP12_SQL,
}
