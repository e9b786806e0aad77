"""Sketches of times against exact quantiles."""

import numpy as np
import pytest

from quarry.operators.evaluate import latency_sketches, merge_sketches, sketched_latency

SCHEMA = "stage string, day int, ms double"


def test_merged_sketches(spark, tmp_path):
    rng = np.random.default_rng(2)
    times = {"embed": rng.gamma(2, 30, 20_000), "llm": rng.lognormal(5, 1, 9_000), "one": np.array([7.0])}
    rows = [(s, k % 5, float(x)) for s, v in times.items() for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    for day in range(5):  # of each day alone, stored, then merged
        latency_sketches(df.filter(f"day = {day}"), ["stage", "day"]).write.parquet(f"{tmp_path}/daily/d={day}")
    stored = spark.read.parquet(f"{tmp_path}/daily").drop("d")
    got = {r["stage"]: r for r in sketched_latency(merge_sketches(stored, ["stage"])).collect()}
    assert set(got) == set(times)
    for stage, v in times.items():
        r = got[stage]
        assert (r["n"], r["max"]) == (len(v), v.max())
        assert r["mean"] == pytest.approx(v.mean())
        for name, rank in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            if len(v) > 1:
                assert abs((v <= r[name]).mean() - rank) <= 0.03
            else:
                assert r[name] == 7.0


def test_odd_times(spark):
    rows = [("a", 1, None), ("a", 1, float("nan")), ("a", 1, float("inf")), ("a", 1, 3.0), ("a", 1, 3.0), (None, 1, 5.0), ("b", 1, None)]
    got = sketched_latency(latency_sketches(spark.createDataFrame(rows, SCHEMA), ["stage"]), (0.5,)).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 2, 3.0, 3.0, 3.0), (None, 1, 5.0, 5.0, 5.0)]
    assert sketched_latency(latency_sketches(spark.createDataFrame([], SCHEMA), ["stage"])).count() == 0
