"""Pages of large text files, read in parts."""

import pytest
from pyspark.errors import AnalysisException

from quarry.sources.lines import read_pages, scan_pages

BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def folder(spark, tmp_path):
    def pages(name, n):
        return [f"{name} {k}\nsecond line ü {'x' * (k * 37 % 300)}" if k % 5 else "" for k in range(1, n + 1)]

    for name, n in (("big", 400), ("small", 3), ("one", 1)):
        (tmp_path / f"{name}.txt").write_text("\f".join(pages(name, n)), encoding="utf-8")
    before = spark.conf.get(BYTES)
    spark.conf.set(BYTES, "4096")
    yield tmp_path
    spark.conf.set(BYTES, before)


def named(df):
    return sorted((r["path"].split("/")[-1], r["page"], r["text"]) for r in df.collect())


def test_equals_whole_read(spark, folder):
    got = scan_pages(spark, str(folder))
    assert spark.read.option("lineSep", "\f").text(str(folder)).rdd.getNumPartitions() > 4  # the big file is read in parts
    want = [x for x in named(read_pages(spark, str(folder))) if x[:2] != ("big.txt", 400)]  # k % 5: the last page is empty
    assert named(got) == want
    assert len(want) == 403


def test_one_page(spark, folder):
    got = scan_pages(spark, str(folder), page="page BETWEEN 201 AND 203")
    assert [x[:2] for x in named(got)] == [("big.txt", k) for k in (201, 202, 203)]
    assert named(got) == [x for x in named(read_pages(spark, str(folder))) if 201 <= x[1] <= 203]


def test_one_file(spark, folder):
    path = next(r["path"] for r in scan_pages(spark, str(folder)).collect() if r["path"].endswith("small.txt"))
    got = scan_pages(spark, str(folder), files=[path])
    rows = got.collect()
    assert len(rows) == 3
    assert {r["path"] for r in rows} == {path}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "small.txt" in scan
    assert scan_pages(spark, str(folder), files=[]).count() == 0


def test_edges(spark, tmp_path):
    (tmp_path / "a.txt").write_text("", encoding="utf-8")
    (tmp_path / "b.txt").write_text("one\f", encoding="utf-8")
    assert named(scan_pages(spark, str(tmp_path))) == [("b.txt", 1, "one")]
    with pytest.raises(AnalysisException):
        scan_pages(spark, str(tmp_path / "none"))
