"""Decontamination and importance resampling against plain models."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import positional, resampling

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain_matches(docs, tests, width=10, slack=None):
    windows = []
    for item, text in tests:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.append(("" if item is None else str(item), w[i : i + width]))
    out = []
    for doc, text in docs:
        w, hit, items, near = words(text), set(), set(), set()
        for item, window in windows:
            n = len(window)
            for i in range(len(w) - n + 1):
                if w[i : i + n] == window:
                    hit.update(range(i, i + n))
                    items.add(item)
            if slack is not None and any(set(window) <= set(w[i : i + n + slack]) for i in range(len(w))):
                near.add(item)
        out.append((doc, len(w), len(hit), sorted(items), sorted(near)))
    return out


def rows_of(df):
    return sorted(((r.id, r.n_words, r.n_hit, list(r["items"]), list(r.near)) for r in df.collect()), key=repr)


def corpus(seed, vocabulary=6):
    rng = random.Random(seed)
    letters = ["a", "B", "été", "Ö", "x1", "Q"][:vocabulary]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    tests = [(i, text(rng.choice([1, 2, 3, 5, 7, 12]))) for i in range(12)] + [(None, "a a"), (3, "Q Q x1"), (40, None), (41, ""), (42, "?!"), (3, "Q Q x1")]
    docs = [(i, text(rng.choice([0, 1, 2, 8, 30, 80]))) for i in range(60)]
    docs += [(1, docs[5][1]), (1, docs[5][1]), (None, "a\nA, a-a"), (70, None), (71, ""), (72, ".,;"), (73, text(20_000))]
    return docs, tests


@pytest.mark.parametrize("seed,width,slack", [(1, 4, 2), (2, 10, None), (3, 1, 0), (4, 3, 5)])
def test_matches_equal_brute_force(spark, monkeypatch, seed, width, slack):
    monkeypatch.setattr(positional, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(positional, "CANDIDATES", 50)
    docs, tests = corpus(seed)
    docs = docs[:-1] + [(73, docs[-1][1][:1500])]
    found = positional.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(tests, "item_id long, text string"), width=width, slack=slack)
    assert rows_of(found) == sorted(plain_matches(docs, tests, width, slack), key=repr)


def test_blocks_of_test_texts_give_the_same(spark):
    docs, tests = corpus(5)
    docs = docs[:-1]
    index = positional.build_index(spark.createDataFrame(docs, "doc_id long, text string"), positional.scratch(spark, "positions"))
    tests = spark.createDataFrame(tests, "item_id long, text string")
    one = rows_of(positional.find_matches(index, tests, width=3, slack=1))
    assert rows_of(positional.find_matches(index, tests, width=3, slack=1, block_bytes=200)) == one


def test_runs_tell_where_the_hits_are(spark):
    docs = spark.createDataFrame([("d", "x a b c y b c d z")], "doc_id string, text string")
    (row,) = positional.contamination(docs, spark.createDataFrame([(7, "a b c d")], "item_id int, text string"), width=3).collect()
    assert [(r["first"], r["after"]) for r in row.runs] == [(1, 4), (5, 8)] and row["items"] == ["7"] and row.n_hit == 6


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "s")], "doc_id long, text string, segment int, runs string")
    none = docs.filter("false")
    tests = spark.createDataFrame([(1, "A", 5)], "item_id long, text string, id int")
    assert rows_of(positional.contamination(none, tests)) == []
    assert rows_of(positional.contamination(docs, tests.filter("false"))) == [(1, 2, 0, [], [])]
    assert rows_of(positional.contamination(docs, tests)) == [(1, 2, 1, ["1"], [])]


def test_hot_groups_of_copies_and_frequent_words(spark):
    docs = [(i, "the same text over and over " * 5 if i % 3 == 0 else f"the {i} the") for i in range(600)]
    tests = [(1, "over the same text over"), (2, "text over and over the same text over and over the same text"), (3, "the")]
    found = positional.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(tests, "item_id long, text string"))
    assert rows_of(found) == sorted(plain_matches(docs, tests), key=repr)


def test_too_wide_a_span_is_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        positional.find_matches(docs, docs, width=60, slack=10)


def plain_resample(docs, target, percent=25, min_words=20, buckets=10_000):
    def features(text):
        w = words(text)
        return w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(b for text in texts for b in map(bucket, features(text))) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        f = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, f)]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def drawn(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = drawn(resampling.op12_resample(spark, DIR))
    assert got == plain_resample(docs, target) and sum(r[4] is not None for r in got) > 20


def test_copies_nulls_ties_and_other_columns(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Un", "deux", "träis", "4", "fünf,", "x" * 300]) for _ in range(n))
    same = text(40)
    docs = [(i, same if i % 3 == 0 else text(rng.choice([0, 1, 19, 20, 90]))) for i in range(400)]
    docs += [(9, same), (9, same), (None, None), (None, same), (500, ""), (501, None), (502, "?!"), (503, text(60_000))]
    target = [text(30), None, "", same]
    rows = [(i, x, 1, "k") for i, x in docs]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string, weight int, key string").repartition(5), spark.createDataFrame([(x,) for x in target], "text string"))
    assert drawn(got) == plain_resample(docs, target)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert drawn(resampling.resample(docs.filter("false"), docs)) == []
    assert drawn(resampling.resample(docs, docs.filter("false"), percent=100)) == plain_resample([(1, "a " * 30)], [], percent=100)


def test_longer_runs_hash_like_their_text():
    w = [b"ab", "é".encode(), b"c" * 40]
    assert resampling.feature_hashes(w, 3) == [zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(4 - n)]


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("score"))
    got = {r.id: r["rank"] for r in resampling.ranked(rows, [F.desc("score"), F.asc("id")]).collect()}
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.id))
    assert got == {r.id: k for k, r in enumerate(want, 1)}
