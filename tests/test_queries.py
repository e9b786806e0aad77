import math

import duckdb
import pytest

from quarry.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows
    if name in ORACLE_SQL:
        got = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
        assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
