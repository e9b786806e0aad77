"""Toxicity by a counterfactual-regularised linear classifier.

A sparse logistic model over the words of a text and the beginnings of its words. Every labelled text that names a
group (an identity term) also enters with its identity terms swapped for others of the same group; the loss adds
`swap_penalty` times the squared change of the logit under that swap, so that a neutral mention carries no weight of
its own. An L1 term keeps the weights of ordinary words at zero, which keeps very long texts from adding up noise.

Fitting uses a sample of at most `max_train` labelled rows (those of least crc32 of a salted id; the bound is a
documented parameter). Scoring covers every whole text.

Edge cases: null and empty texts get the score of the model's intercept; labels that are null, or whose id has no
document, are not used; without any usable labels every score is 0.0; repeated label rows count as repeated
evidence; rows of documents that repeat are each scored; extra columns of either input play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrow import frugal, texts

#: Terms that name groups of people, by kind; a term is swapped for the next of its kind.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives"), ("old", "young"), ("disabled", "abled"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
WORD = re.compile(r"[^\W\d_]+").findall
BITS = 20
PREFIXES = (4, 5, 6)
MAX_TRAIN = 8_000


def _swaps(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    return {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}


def word_features(word: str) -> list[int]:
    """Buckets of a lower-case word: the word itself and its beginnings."""
    mask = (1 << BITS) - 1
    found = [zlib.crc32(b"w" + word.encode()) & mask]
    found += [zlib.crc32(b"p" + word[:n].encode()) & mask for n in PREFIXES if len(word) >= n]
    return found


def features(words: set[str]) -> np.ndarray:
    return np.unique(np.array([b for w in words for b in word_features(w)], "int32"))


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # one float32 a bucket
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[features(set(WORD((text or "").lower())))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_rows(rows: list[np.ndarray], swapped: list[np.ndarray | None], y: np.ndarray, l1: float = 5e-5, swap_penalty: float = 1.0, min_rows: int = 4, least_chi2: float = 6.0, steps: int = 250) -> ToxicityModel:
    """Accelerated proximal gradient descent on the penalised logistic loss."""
    weights = np.zeros(1 << BITS, "float32")
    if not len(rows) or y.min() == y.max():
        return ToxicityModel(weights, -40.0 if not len(rows) or y[0] == 0 else 40.0)
    seen, hits = np.zeros(1 << BITS, "float32"), np.zeros(1 << BITS, "float32")
    for r, label in zip(rows, y):  # row by row, so that nothing of the size of all rows is made
        seen[r] += 1
        hits[r] += label
    # buckets that are rare, or as common in one class as in the other (chi-squared below `least_chi2`), stay at zero
    part = seen * y.mean()
    chi2 = (hits - part) ** 2 / np.maximum(part * (1 - y.mean()) * (1 - seen / (len(rows) + 1)), 1e-9)
    used = np.flatnonzero((seen >= min(min_rows, max(1, len(rows) // 50))) & (chi2 >= least_chi2))
    place = np.full(1 << BITS, -1, "int32")
    place[used] = np.arange(len(used))

    def used_of(part: np.ndarray) -> np.ndarray:
        found = place[part]
        return found[found >= 0]

    def packed(parts: list[np.ndarray], owners: np.ndarray):
        return np.concatenate([*parts, np.zeros(0, "int32")]), np.repeat(owners, [len(c) for c in parts])

    # from here on only what is used of each row is held
    rows, swapped = [used_of(r) for r in rows], [None if r is None else used_of(r) for r in swapped]
    cols, who = packed(rows, np.arange(len(rows)))
    pairs = [(a, b) for a, b in zip(rows, swapped) if b is not None]
    gone, came = [np.setdiff1d(a, b) for a, b in pairs], [np.setdiff1d(b, a) for a, b in pairs]
    d_cols, d_who = packed(gone + came, np.tile(np.arange(len(pairs)), 2))
    d_vals = np.repeat([1.0, -1.0], [sum(map(len, gone)), sum(map(len, came))])
    n, p = len(rows), len(used)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = float(np.log(rate / (1 - rate)))
    w, v, vb, t = np.zeros(p), np.zeros(p), b, 1.0

    def loss_grad(w: np.ndarray, b: float):
        z = np.bincount(who, w[cols], n) + b
        prob = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.bincount(cols, ((prob - y) / n)[who], p)
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        if len(d_cols):
            change = np.bincount(d_who, w[d_cols] * d_vals, len(pairs))
            g += swap_penalty * 2 / n * np.bincount(d_cols, change[d_who] * d_vals, p)
            loss += swap_penalty * float(np.sum(change**2)) / n
        return loss, g, float(np.mean(prob - y))

    step = 1.0
    for _ in range(steps):
        loss, g, gb = loss_grad(v, vb)
        while True:
            new = v - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            nb = vb - step * gb
            moved = new - v
            if loss_grad(new, nb)[0] <= loss + float(g @ moved) + gb * (nb - vb) + (float(moved @ moved) + (nb - vb) ** 2) / (2 * step) + 1e-12 or step < 1e-4:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        done = float(np.abs(new - w).max(initial=0)) < 1e-4
        w, b, t, step = new, nb, t2, step * 1.2
        if done:
            break
    weights[used] = w
    return ToxicityModel(weights, b)


def _training_rows(swaps: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, other = [], []
            for text in texts(batch, "text"):
                words = set(WORD((text or "").lower()))
                plain.append(features(words).tobytes())
                other.append(features({swaps.get(w, w) for w in words}).tobytes() if not words.isdisjoint(swaps) else None)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(plain, pa.binary()), pa.array(other, pa.binary())], ["label", "plain", "swapped"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", identity_groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, **options) -> ToxicityModel:
    """Fit on at most `max_train` labelled documents; `labels` must already lack the held-out rows."""
    chosen = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("label")).dropna().withColumn("_order", F.crc32(F.concat(F.lit("train:"), F.col("_id").cast("string")).cast("binary"))).orderBy("_order", "_id", "label").limit(max_train)
    joined = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "_id").select("label", "text")  # at most max_train ids
    got = joined.mapInArrow(frugal(_training_rows(_swaps(identity_groups))), "label int, plain binary, swapped binary").toArrow()
    rows, swapped = ([None if not x.is_valid else np.frombuffer(x.as_buffer(), "int32") for x in got.column(c)] for c in ("plain", "swapped"))  # views, not copies
    y = np.array(got.column("label").to_pylist(), "float64")
    order = sorted(range(len(rows)), key=lambda k: (zlib.crc32(rows[k]), len(rows[k]), y[k]))  # partitions arrive in any order
    model = fit_rows([rows[k] for k in order], [swapped[k] for k in order], y[order], **options)
    del got, rows, swapped
    pa.default_memory_pool().release_unused()
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text_column: str = "text", score_column: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """`df` (its columns `keep`, if named) with the score of each whole text in a further column.

    A column that is named like the score gives way to it; a null text scores like an empty one.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != score_column.lower()]
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value

        class Weights(dict):
            """What a word adds: its buckets of weight other than zero."""

            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) > 200_000:
                    self.clear()
                found = self[word] = tuple(b for b in word_features(word) if weights[b])
                return found

        known = Weights()
        for batch in batches:
            scores = []
            for text in texts(batch, text_column):
                buckets = set().union(*map(known.__getitem__, set(WORD(text.lower())))) if text else ()
                z = intercept + float(sum(weights[b] for b in sorted(buckets)))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(scores, pa.float64())], [*keep, score_column])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)
    return df.mapInArrow(frugal(run), f"{fields}, `{score_column}` double")


def held_out(id_column: str = "doc_id"):
    """Rows whose labels are kept from training."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2
