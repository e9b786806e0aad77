"""What external models offer, and deterministic stand-ins for use without them.

Scores of the stand-ins are not those of the models they stand for, and thresholds do not carry over.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Rewriter(Protocol):
    def __call__(self, questions: list[str], histories: list[str]) -> list[str | None]: ...


class Reranker(Protocol):
    """(place, score) of the documents of one question, in any order; places left out score 0."""

    def __call__(self, question: str, documents: list[str]) -> list[tuple[int, float]]: ...


class Transcriber(Protocol):
    def __call__(self, audio: bytes) -> str: ...


class Synthesizer(Protocol):
    def __call__(self, text: str, language: str) -> bytes: ...


def hashed_embedder(dim: int = 64) -> Embedder:
    """Signed hashes of words, weighed by the square root of their count."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts: dict[str, int] = {}
            for w in re.findall(r"[a-z0-9$%.]+", text.lower()):
                counts[w] = counts.get(w, 0) + 1
            v = [0.0] * dim
            for w, n in counts.items():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += math.sqrt(n) * (1 if h >> 63 else -1)
            out.append(v)
        return out

    return embed


def first_sentence_generator(prompts: list[str]) -> list[str]:
    """The first sentence of the first passage of a prompt."""
    out = []
    for p in prompts:
        m = re.search(r"\[Passage 1 \| [^\]]*\]\n(.+?[.!?])(?=\s|\Z)", p, re.S)
        out.append(m[1] if m else "")
    return out


def prompted_rewriter(generator: Generator, user: str = "Customer", assistant: str = "Assistant") -> Rewriter:
    """A rewriter that asks a generator for the standalone question."""

    def rewrite(questions: list[str], histories: list[str]) -> list[str | None]:
        return generator([rewrite_prompt(q, h, user, assistant) for q, h in zip(questions, histories)])

    return rewrite


def rewrite_prompt(question: str, history: str, user: str = "Customer", assistant: str = "Assistant") -> str:
    return (
        f"Below are the last turns between {user} and {assistant}, then a new message of {user}.\n"
        "State the new message as one question that can be understood without the turns: put the thing meant where a pronoun or an "
        "omission points to it, keep the language of the message, add nothing else. Reply with the question alone.\n\n"
        f"{history}\n\nNew message: {question}\nQuestion:"
    )


def identity_rewriter(questions: list[str], histories: list[str]) -> list[str | None]:
    return list(questions)
