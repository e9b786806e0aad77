import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import additive, maxscore, vectors


def rows_of(n=400, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1000, None), (1001, [None] + [0.1] * (dim - 1)), (1002, [math.nan] * dim), (1003, [math.inf] * dim), (1004, []), (None, [0.1] * dim), (1100, rows[50][1]), (1150, rows[50][1])]
    return rows


def scores(rows, step, k, scale=None, nonzero=False):
    """The best k of every query row against all other rows; rows that share an id are rows of their own."""
    ok = [(i, [float(v) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and not (nonzero and not any(x))]
    if scale:
        ok = [(i, [math.floor(v * scale) for v in x]) for i, x in ok]
    out = {}
    for n, (q, x) in enumerate(ok):
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), c) for m, (c, y) in enumerate(ok) if m != n and len(x) == len(y))[:k]
            out.setdefault(q, []).extend((r + 1, c, -v) for r, (v, c) in enumerate(s))
    return {q: sorted(found) for q, found in out.items()}


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank, r.vec_id, r.score)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("broadcast", [10**9, -1])
def test_exact_top_k_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", broadcast)
    rows = rows_of()
    df = spark.createDataFrame([(i, x, 9) for i, x in rows], "vec_id long, embedding array<float>, rank int")
    rows32 = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    assert collected(maxscore.exact_top_k(df, F.col("id") % 50 == 0)) == scores(rows32, 50, 5, 256)


def test_exact_top_k_with_large_and_few_vectors(spark):
    big = [(0, [1e6, -3e5, 2.5]), (50, [2e6, 1e6, -1.0]), (3, [5.0, 1e6, 7.0]), (4, [1.0, 2.0])]
    got = collected(maxscore.exact_top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0))
    assert got == scores(big, 50, 5, 256)
    assert maxscore.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


def test_maxscore_prunes_without_loss():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.floor(rng.normal(size=(300, 40)) * rng.choice([1, 8, 64], 40))
        q = np.floor(rng.normal(size=40) * rng.choice([0, 1, 50], 40))
        terms, ids = np.ascontiguousarray(x.T), rng.permutation(300)
        want = sorted((-(x[c] @ q), ids[c]) for c in range(300))[:5]
        for floor in (-np.inf, -want[-1][0], -want[0][0], -want[0][0] + 1):
            at, s = maxscore.maxscore(q, terms, terms.min(1), terms.max(1), ids, 5, floor, step=8)
            assert [(-v, i) for v, i in zip(s, ids[at])] == [w for w in want if -w[0] >= floor]


def test_maxscore_probes_what_the_threshold_leaves():
    """Few terms are essential under a high threshold, and the other postings are probed for few vectors."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4000, 64)) * np.r_[[60] * 8, [2] * 56])
    q = np.floor(rng.normal(size=64) * 20)
    terms, ids = np.ascontiguousarray(x.T), np.arange(4000)
    best = np.sort(x @ q)
    args = (q, terms, terms.min(1), terms.max(1), ids, 6)
    without, under = [], []
    maxscore.maxscore(*args, counts=without)
    maxscore.maxscore(*args, best[-6], counts=under)
    assert without == [4000 * np.count_nonzero(q), 0]
    assert under[0] <= 4000 * 12 and sum(under) < 0.5 * sum(without)
    width = np.sort(np.abs(q * (terms.max(1) - terms.min(1))))[::-1]
    base = float(np.minimum(q * terms.min(1), q * terms.max(1)).sum())
    n = maxscore.essential_terms(width, base, best[-6])
    assert base + width[n:].sum() < best[-6] <= base + width[n - 1 :].sum()


@pytest.mark.parametrize("broadcast", [10**9, 200])
def test_rows_that_share_an_id_are_rows_of_their_own(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 2)
    rows = [(100, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [-1.0, 0.25]), (7, [0.5, 0.5]), (7, [1.0, 0.5]), (7, [0.5, 0.5]), (9, [0.25, -1.0]), (200, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found, k, scale in ((maxscore.exact_top_k(df, F.col("id") % 50 == 0, 4), 4, 256), (additive.nearest(df, F.col("id") % 20 == 0, 5), 5, 1)):
        want = []
        for n, (q, x) in enumerate(rows):
            if q % 100 == 0:
                best = sorted((-sum(a * b for a, b in zip(x, y)) * scale * scale, c) for m, (c, y) in enumerate(rows) if m != n)[:k]
                want += [(q, r + 1, c, -v) for r, (v, c) in enumerate(best)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(want)


def test_nearest_reaches_its_recall_and_scores_are_exact(spark):
    rows = rows_of(3000, 32, 2) + [(5000, [0.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows32 = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    want = scores(rows32, 100, 20, nonzero=True)
    got = collected(additive.nearest(df, F.col("id") % 100 == 0, share=0.04, least=60))
    assert got.keys() == want.keys() and all(len(v) == len(want[q]) for q, v in got.items())
    assert sum(len({c for _, c, _ in got[q]} & {c for _, c, _ in want[q]}) for q in want) / sum(len({c for _, c, _ in v}) for v in want.values()) >= 0.9
    every = scores(rows32, 100, 10**6, nonzero=True)
    true = {q: {c: [s for _, d, s in every[q] if d == c] for _, c, _ in got[q]} for q in list(want)[:3]}
    for q in true:
        assert all(any(abs(t - s) < 1e-12 for t in true[q][c]) for _, c, s in got[q])
        assert [s for *_, s in got[q]] == sorted((s for *_, s in got[q]), reverse=True)


def test_nearest_where_a_third_of_the_vectors_are_equal(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16)).astype("float32")
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = collected(additive.nearest(df, F.col("id") % 100 == 0))
    wide, copies, hits = x.astype("float64"), set(ids[::3].tolist()), []
    for q in got:
        s = (wide * wide[ids == q][0]).sum(axis=1)
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -s))[:20]].tolist()
        if q in copies:
            assert [c for _, c, _ in got[q]] == want
        hits.append(len(set(want) & {c for _, c, _ in got[q]}) / 20)
    assert len(got) == 60 and np.mean(hits) >= 0.9 and any(q in copies for q in got)


def test_nearest_with_few_vectors_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert collected(additive.nearest(spark.createDataFrame(few, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0)) == scores(few, 20, 20)
    assert additive.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


def test_beam_search_beats_greedy_codes():
    x = np.random.default_rng(4).normal(size=(600, 16)).astype("float32")
    books = additive.train(x, books=4, words=16)
    error = [float(((x - additive.decode(additive.encode(x, books, beam), books)) ** 2).sum()) for beam in (1, 8)]
    assert error[1] < error[0]


def test_recall_on_the_test_table(spark):
    from quarry.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    data = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype("float64")
    got = QUERIES["op6_nearest"](spark, d).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in ids[ids % 20 == 0]:
        s = x @ x[ids == i][0]
        s[ids == i] = -9
        hits.append(len(set(ids[np.argsort(-s, kind="stable")[:20]]) & got[i]) / 20)
    assert np.mean(hits) >= 0.9


