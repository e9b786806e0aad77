"""Search over cells against all pairs."""

import math
import re

import numpy as np
import pytest

from quarry.operators.dense_index import DenseIndex
from quarry.operators.retrieve import dense_topk


def table(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} array<double>")


def clustered(n, dims=12, groups=20, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] * 3 + rng.normal(size=(n, dims)) * 0.2
    x[: n // 3] = x[0]  # a third are copies of one vector
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("limit", [32_000_000, 0])
def test_equals_all_pairs(spark, tmp_path, limit):
    rows = clustered(1500)
    vectors, queries = table(spark, rows, ("id", "embedding")), table(spark, rows[::50], ("query_id", "qvec"))
    index = DenseIndex(spark, str(tmp_path / "i"), cells=12)
    index.begin(vectors)
    index.add(vectors.filter("id % 3 > 0"), 0)
    index.add(vectors.filter("id % 3 = 0"), 1)
    index.add(vectors.filter("id % 3 = 0"), 1)  # again: replaces itself
    want = sorted(dense_topk(vectors, queries, 10).collect())
    assert sorted(index.search(queries, 10, limit).collect()) == want


def test_cells_are_skipped(spark, tmp_path):
    rows = clustered(3000)
    vectors, queries = table(spark, rows, ("id", "embedding")), table(spark, rows[1000::100], ("query_id", "qvec"))
    index = DenseIndex(spark, str(tmp_path / "i"), cells=12)
    index.begin(vectors)
    index.add(vectors, 0)
    assert index.counts().agg({"n": "sum"}).first()[0] == len(rows)
    first, _, later = index.pairs(queries, 10)
    read = first.select("query_id", "n").union(later.select("query_id", "n")).agg({"n": "sum"}).first()[0]
    assert read < 0.25 * len(rows) * queries.count()
    plan = index.search(queries.limit(1), 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+", plan), [x for x in plan.splitlines() if "parquet" in x]


def test_odd_rows(spark, tmp_path):
    odd = [(90, None), (91, []), (92, [1.0]), (93, [math.nan, 0.0]), (94, [math.inf, 0.0]), (95, [None, 1.0])]
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])]
    index = DenseIndex(spark, str(tmp_path / "i"))
    vectors = table(spark, rows + odd, ("id", "embedding"))
    index.begin(vectors)
    index.add(vectors, 0)
    queries = table(spark, [(7, [1.0, 0.0]), (8, [0.0, 0.0]), *odd], ("query_id", "qvec"))
    got = sorted(map(tuple, index.search(queries, 3).select("query_id", "dense_rank", "id", "sim").collect()))
    assert got == [(7, 0, 1, 1.0), (7, 1, 1, 1.0), (7, 2, 2, 0.0), (8, 0, 1, 0.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0)]


def test_empty_index(spark, tmp_path):
    index = DenseIndex(spark, str(tmp_path / "i"))
    none = table(spark, [], ("id", "embedding"))
    index.begin(none)
    index.add(none, 0)
    assert index.search(table(spark, [(7, [1.0])], ("query_id", "qvec"))).collect() == []
