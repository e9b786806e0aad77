"""Exact top-k over integer vectors by MaxScore.

A dimension is a term, a vector's component its posting. Within a block of vectors a term adds between least_d and
least_d + width_d to a query's score. A query's threshold is the least of the best k scores found so far; it rises from
block to block of a shard. The non-essential terms are the longest run of least widths that cannot lift a vector to the
threshold by themselves. The postings of the essential terms are traversed for all vectors of the block; the others are
probed by falling width, in chunks, for the vectors that what remains can still lift to the threshold. In the first
block there is no threshold, and all terms are essential. The best of all shards are merged.

Edge cases: vectors that are null or hold null or non-finite components take no part; ties go to the smaller id; a
query with fewer candidates gets all of them; vectors meet those of their own dimension; an empty table gives an
empty table; rows that share an id are rows of their own, as queries and as candidates; other columns play no part.
Scores beyond the range of a long are cut to its ends (after ranking).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.vectors import BLOCK_ROWS, block_top_k, pack, sharded, usable

SCALE = 256
STEP = 16


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score and rising id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def essential_terms(width: np.ndarray, base: float, floor: float) -> int:
    """How many of the terms, sorted by falling width, are essential: the others add too little to `base` for the floor."""
    rest = np.r_[np.cumsum(width[::-1])[::-1], 0]  # what the terms from place t on can add at most
    return int(np.argmax(base + rest < floor)) if base < floor else len(width)


def maxscore(q: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int, floor: float = -np.inf, step: int = STEP, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best k candidates (places, scores) of one query, but for those below `floor`.

    terms: one row of postings a dimension. `counts` takes up the numbers of postings traversed and probed.
    """
    ends = q * low, q * high
    least, width = np.minimum(*ends), np.abs(ends[1] - ends[0])
    order = np.argsort(-width, kind="stable")
    order = order[: np.count_nonzero(width)]  # the other terms add the same to all
    base = least.sum()
    n = terms.shape[1]
    done = essential_terms(width[order], base, floor)
    partial = q[order[:done]] @ terms[order[:done]] + (base - least[order[:done]].sum())
    rest = np.r_[np.cumsum(width[order][::-1])[::-1], 0]
    live = np.arange(n)
    probed = 0
    while done < len(order):
        # `partial` counts what is not yet probed at its least
        fit = partial + rest[done] >= floor
        live, partial = live[fit], partial[fit]
        if not len(live):
            break
        chunk = order[done : done + step]
        partial = partial + q[chunk] @ terms[np.ix_(chunk, live)] - least[chunk].sum()
        probed += len(chunk) * len(live)
        done += len(chunk)
    if counts is not None:
        counts += [n * (essential_terms(width[order], base, floor)), probed]
    fit = partial >= floor
    live, partial = live[fit], partial[fit]
    top = best_of(partial, ids[live], k)
    return live[top], partial[top]


def _searcher(k: int, scale: int):
    def search(q_ids, q, ids, x, floors):
        q, x = np.floor(q * scale), np.floor(x * scale)
        # doubles hold the sums exactly up to 2 ** 53; beyond that Python's integers do
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
        if bound >= 2**51:
            found = []
            wide_q, wide_x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
            for a in range(len(q)):
                scores = wide_x @ wide_q[a]
                at = np.array(sorted(range(len(scores)), key=lambda b: (-scores[b], ids[b]))[: k + 1], "int64")
                found.append((at, [max(-(2**63), min(2**63 - 1, int(scores[b]))) for b in at]))
        else:
            terms = np.ascontiguousarray(x.T)
            low, high = terms.min(axis=1), terms.max(axis=1)
            found = [maxscore(q[a], terms, low, high, ids, k + 1, floors[a]) for a in range(len(q))]
        rows = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
        at, scores = np.concatenate([at for at, _ in found]), np.concatenate([np.array(s, "int64") for _, s in found])
        same = ids[at] == q_ids[rows]
        same[same] = (x[at[same]] == q[rows[same]]).all(axis=1)
        yield rows, ids[at], scores, same

    return search


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long) for the rows that `is_query` (over `id`) picks, against all other rows."""
    rows = usable(df, id_column, vector_column)
    return block_top_k(pack(sharded(rows, df.count()), BLOCK_ROWS), rows.filter(is_query), k, _searcher(k, scale), score_type="long")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP2_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
"""
