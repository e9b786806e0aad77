"""Approximate nearest neighbours by inner product, with additive quantisation.

A vector is stood for by the sum of `BOOKS` full-dimensional codewords. Codebooks begin as residual k-means and are
then fitted jointly by least squares on beam-search codes; fitting uses a sample of at most `MAX_TRAIN` vectors
(those of least hash; the bound is a documented parameter). Every vector is encoded by beam search and stored with
its norm and that of its approximation. A query scores codes by lookup tables (one inner product for each codeword),
scaled by the stored norms; the best `RERANK_SHARE` of each block, `RERANK_LEAST` at least, are reranked by the exact
inner product of the original vectors in double precision.

Equal vectors of a block are one class: it is encoded, scored and reranked once, and only then stands for its rows, of
which no query needs more than the k + 1 of least id. So copies do not crowd each other out of the reranked share.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; ties go to the smaller
id; a query with fewer candidates than asked for gets all of them; with fewer training vectors than codewords the
codebooks are smaller; vectors of a dimension without training vectors are searched exactly; vectors meet those of
their own dimension; an empty table gives an empty table; rows that share an id are rows of their own, as queries and as
candidates; other columns play no part. A block of no more classes than are reranked is searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.maxscore import best_of
from quarry.llm.vectors import BLOCK_ROWS, block_top_k, pack, sharded, usable

BOOKS, WORDS, BEAM = 12, 256, 4
MAX_TRAIN = 8_192
RERANK_SHARE, RERANK_LEAST = 0.04, 100


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.r_[first, len(x)])[:, None]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) by beam search: each step keeps the `beam` partial sums of least error."""
    m, k, _ = books.shape
    out = np.empty((len(x), m), "uint8")
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        n = len(part)
        rest, codes = part[:, None, :], np.zeros((n, 1, 0), "uint8")
        error = np.zeros((n, 1), "float32")
        for book in books:
            cost = error[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, -1, k) + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            at = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            from_, word = at // k, at % k
            rows = np.arange(n)[:, None]
            error = flat[rows, at]
            rest = rest[rows, from_] - book[word]
            codes = np.concatenate([codes[rows, from_], word[:, :, None].astype("uint8")], axis=2)
        out[start : start + n] = codes[np.arange(n), error.argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books x words x dimension, float32)."""
    x = x.astype("float32")
    rng = np.random.default_rng(seed)
    k = min(words, len(x))
    rest, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, k, rng)
        rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c**2).sum(1), axis=1)]
        out.append(c)
    found = np.stack(out)
    # joint least squares for the codewords, given beam-search codes
    codes = encode(x, found).astype("int64") + np.arange(books) * k
    gram, right = np.zeros((books * k, books * k)), np.zeros((books * k, x.shape[1]))
    for a in range(books):
        np.add.at(right, codes[:, a], x)
        for b in range(books):
            np.add.at(gram, (codes[:, a], codes[:, b]), 1)
    gram[np.diag_indices_from(gram)] += 1.0
    prior = found.reshape(books * k, -1)
    return np.linalg.solve(gram, right + prior).reshape(books, k, -1).astype("float32")


def fit(rows: DataFrame, max_train: int = MAX_TRAIN, **options) -> dict[int, np.ndarray]:
    """Codebooks by dimension, from a sample of bounded size."""
    got = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(max_train).toArrow()
    vectors = [np.array(v) for v in got.column("vector").to_pylist()]
    return {d: train(np.stack([v for v in vectors if len(v) == d]), **options) for d in sorted({len(v) for v in vectors})}


def classes(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different vectors, the ids by vector and then rising, and where each vector's ids start."""
    x = np.ascontiguousarray(x + 0.0)  # -0.0 equals 0.0
    _, first, which = np.unique(x.view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    return x[first], ids[order], np.searchsorted(which[order], np.arange(len(first)))


def index(rows: DataFrame, books: dict[int, np.ndarray], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every vector in blocks with its codes and the scale of its norms: dim, ids, data, codes, scales, starts (bytes).

    data, codes and scales have a row each different vector; its ids are those from its place in `starts` on, rising.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)  # books * words * dimension floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, codes, scales, starts = [], [], [], [], []
            for dim, members, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "data"))):
                book = shared.value.get(dim)
                x, held, begin = classes(np.frombuffer(data, "float64").reshape(-1, dim), np.frombuffer(members, "int64"))
                ids.append(held.tobytes())
                vectors.append(x.tobytes())
                starts.append(begin.tobytes())
                if book is None:
                    codes.append(b"")
                    scales.append(b"")
                    continue
                c = encode(x.astype("float32"), book)
                norm, near = np.linalg.norm(x, axis=1), np.linalg.norm(decode(c, book), axis=1)
                codes.append(c.tobytes())
                scales.append((norm / np.maximum(near, 1e-12)).astype("float32").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("dim"), *(pa.array(c, pa.binary()) for c in (ids, vectors, codes, scales, starts))], ["dim", "ids", "data", "codes", "scales", "starts"])

    return pack(rows, block_rows).mapInArrow(run, "dim int, ids binary, data binary, codes binary, scales binary, starts binary")


def _searcher(shared, k: int, share: float, least: int):
    def search(q_ids, q, ids, x, floors, codes, scales, starts):
        begin = np.frombuffer(starts, "int64")
        sizes = np.minimum(np.diff(np.r_[begin, len(ids)]), k + 1)
        book = shared.value.get(x.shape[1])
        wide = max(least, k + 1, int(np.ceil(share * len(ids))))
        if book is not None:
            c = np.ascontiguousarray(np.frombuffer(codes, "uint8").reshape(len(x), -1).T)
            scale = np.frombuffer(scales, "float32")
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            if book is None or wide >= len(x):
                near = np.tile(np.arange(len(x)), (len(part), 1))
            else:
                approx = np.zeros((len(part), len(x)), "float32")
                for m in range(len(book)):
                    approx += np.take(part.astype("float32") @ book[m].T, c[m], axis=1)
                approx *= scale
                near = np.argpartition(-approx, wide - 1, axis=1)[:, :wide]
            found = []
            for a in range(len(part)):
                at = near[a]
                exact = (x[at] * part[a]).sum(axis=1)
                if len(at) > k + 1:  # one class may hold the query alone
                    best = exact >= np.partition(exact, len(at) - k - 1)[len(at) - k - 1]
                    at, exact = at[best], exact[best]
                n = sizes[at]
                place = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score = np.repeat(exact, n)
                top = best_of(score, ids[place], k + 1)
                mine, of = ids[place[top]], np.repeat(at, n)[top]
                same = mine == q_ids[start + a]
                same[same] = (x[of[same]] == part[a]).all(axis=1)
                found.append((np.full(len(top), start + a), mine, score[top], same))
            yield tuple(np.concatenate(c) for c in zip(*found))

    return search


def nearest(df: DataFrame, is_query: Column, k: int = 20, share: float = RERANK_SHARE, least: int = RERANK_LEAST, id_column: str = "vec_id", vector_column: str = "embedding", max_train: int = MAX_TRAIN) -> DataFrame:
    """query_id, rank, vec_id, score (the exact inner product) of the nearest found."""
    rows = usable(df, id_column, vector_column, nonzero=True)
    books = fit(rows, max_train)
    shared = df.sparkSession.sparkContext.broadcast(books)
    return block_top_k(index(sharded(rows, df.count()), books), rows.filter(is_query), k, _searcher(shared, k, share, least), ("codes", "scales", "starts"))


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
