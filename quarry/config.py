"""Settings of the engine, fixed once made; every operator takes what it needs as parameters with these defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    memory_max_turns: int = 6
    memory_turns_for_rewrite: int = 3
    chunk_target_tokens: int = 320
    chunk_min_tokens: int = 8
    chunk_overlap_sentences: int = 1
    dense_k: int = 25
    sparse_k: int = 25
    rrf_k: int = 60
    fusion_k: int = 20
    final_k: int = 4
    neighbor_expansion: bool = True
    rerank_abstain_threshold: float = 0.15
    rerank_confident_threshold: float = 0.5
    grounding_min_overlap: float = 0.40
    enable_grounding_check: bool = True
    semantic_cache_threshold: float = 0.94
    semantic_cache_size: int = 256
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    embedding_batch: int = 90
    speech_max_chars: int = 2500
    #: Rows up to which a side of a similarity search is broadcast; beyond it the search runs in blocks.
    broadcast_queries: int = 20_000

    @classmethod
    def load(cls, env_file: str | None = None, environ: dict[str, str] | None = None, spark: SparkSession | None = None) -> "Settings":
        """Defaults, then NAME=value lines of a file, then environment variables, then `quarry.<name>` of the session.

        Unknown names are ignored. The session's are set with `spark.conf.set` or `--conf spark.quarry.<name>=value`, as
        spark-submit passes only names that begin with `spark.`.
        """
        found: dict[str, str] = {}
        if env_file and Path(env_file).exists():
            for line in Path(env_file).read_text().splitlines():
                name, eq, value = line.partition("=")
                if eq and not name.lstrip().startswith("#"):
                    found[name.strip().lower()] = value.strip().strip("\"'")
        found |= {k.lower(): v for k, v in (os.environ if environ is None else environ).items()}
        if spark is not None:
            for f in fields(cls):
                for name in (f"spark.quarry.{f.name}", f"quarry.{f.name}"):
                    value = spark.conf.get(name, None)
                    if value is not None:
                        found[f.name] = value
        values = {}
        for f in fields(cls):
            if f.name in found:
                kind = type(f.default)
                values[f.name] = found[f.name].lower() in ("1", "true", "yes", "on") if kind is bool else kind(found[f.name])
        return cls(**values)


DEFAULTS = Settings()
