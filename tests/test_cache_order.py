"""The cache in the order of questions against a plain loop."""

import random

import numpy as np
import pytest

from quarry.operators.cache_order import cache_replay

Q = "query_id long, key string, vec array<double>, lang string, cacheable boolean"


def plain(questions, cache, size, threshold):
    held = {key: (None, None, vec, lang) for key, vec, lang, _ in sorted(cache, key=lambda e: (e[3], e[0]))[-size:]}
    out = []
    for query, key, vec, lang, cacheable in sorted(questions, key=lambda q: q[0]):
        if vec is None:
            out.append((query, None, None, False))
            continue
        best, name = -np.inf, None
        for k, (_, _, v, other) in held.items():
            sim = np.round(np.dot(vec, v) / (np.linalg.norm(vec) * np.linalg.norm(v) + 1e-9), 6)
            if other == lang and sim > best:
                best, name = sim, k
        if name is not None and best >= threshold:
            source, _, v, other = held.pop(name)
            held[name] = (source, query, v, other)
            out.append((query, name, source, False))
        elif cacheable is False:
            out.append((query, None, None, False))
        else:
            held.pop(key, None)
            held[key] = (query, query, vec, lang)
            while len(held) > size:
                held.pop(next(iter(held)))
            out.append((query, None, None, True))
    return out, [(k, source, used) for k, (source, used, _, _) in held.items()]


def made(seed, n, topics, spread):
    rng = random.Random(seed)
    centres = [np.array([rng.gauss(0, 1) for _ in range(6)]) for _ in range(topics)]
    rows = []
    for i in range(n):
        topic = 0 if i % 3 == 0 else rng.randrange(topics)  # one topic holds a third of all questions
        vec = None if rng.random() < 0.02 else [float(x) for x in centres[topic] + spread * np.array([rng.gauss(0, 1) for _ in range(6)])]
        rows.append((i * 3, f"k{topic}-{rng.randrange(4)}" if rng.random() < 0.9 else f"q{i}", vec, rng.choice(["en", "en", "hinglish"]), rng.choice([True, True, True, False, None])))
    return rows


@pytest.mark.parametrize("seed,size,topics,spread,block_rows", [(1, 5, 30, 0.05, 60), (2, 16, 12, 0.4, 80), (3, 64, 200, 0.2, 70), (4, 3, 4, 0.0, 10_000)])
def test_replay_equals_one_question_after_the_other(spark, seed, size, topics, spread, block_rows):
    rows = made(seed, 400, topics, spread)
    cache = [(f"old{k}", rows[k * 7 + 1][2] or [1.0] * 6, "en", k // 2) for k in range(8)]
    got = cache_replay(spark.createDataFrame(rows, Q).repartition(5), spark.createDataFrame(cache, "key string, vec array<double>, lang string, last_access long"), size, 0.94, block_rows)
    decisions, held = plain(rows, cache, size, 0.94)
    assert sorted((r.query_id, r.hit_key, r.hit_source, r.stored) for r in got.decisions.collect()) == decisions
    assert [(r.key, r.source, r.used) for r in sorted(got.state.collect(), key=lambda r: r.nth)] == held
    assert any(d[1] for d in decisions) and any(d[2] is not None for d in decisions)


def test_few_rounds_where_a_text_has_one_vector(spark):
    made_ = made(5, 600, 40, 0.02)
    first = {}
    for _, key, vec, lang, _ in made_:
        first.setdefault(key, (vec, lang))
    rows = [(query, key, *first[key], True) for query, key, *_ in made_]
    got = cache_replay(spark.createDataFrame(rows, Q), None, 100, 0.94, 60)
    assert sorted((r.query_id, r.hit_key, r.hit_source, r.stored) for r in got.decisions.collect()) == plain(rows, [], 100, 0.94)[0]
    assert got.rounds <= 6  # of 10 blocks


def test_empty_batch(spark):
    got = cache_replay(spark.createDataFrame([], Q), spark.createDataFrame([("a", [1.0], "en", 1)], "key string, vec array<double>, lang string, last_access long"))
    assert got.decisions.count() == 0 and [r.key for r in got.state.collect()] == ["a"]
