import math

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
NAMES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 13)}
    assert "pipeline" in entry.queries() and QUERIES.items() <= entry.queries().items()


def test_pipeline_stages_against_their_inputs(spark, tmp_path):
    from tests.llm.test_dedup import components, near_lines

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept[name] = ({r.doc_id: getattr(r, "text", None) for r in before.collect()}, {r.doc_id: getattr(r, "text", None) for r in docs.collect()})
    before, after = kept["toxicity"]
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)
    before, after = kept["line_dedup"]
    assert after == near_lines(sorted(before.items()))
    before, after = kept["near_dedup"]
    roots, _ = components(sorted(before.items()))
    assert set(after) == {i for i, r in roots.items() if i == r}
    before, after = kept["mixing"]
    assert 0 < len(after) < len(before)
    before, after = kept["encoding"]
    assert set(after) == set(before)
