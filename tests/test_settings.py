from quarry.config import Settings
from quarry.operators.retrieve import warm_up


def test_session_goes_over_environment_and_file(spark, tmp_path):
    (tmp_path / "env").write_text("DENSE_K=7\nfinal_k = 9\nother=1\n# rrf_k=1\n")
    spark.conf.set("quarry.final_k", "3")
    spark.conf.set("spark.quarry.neighbor_expansion", "off")
    try:
        s = Settings.load(str(tmp_path / "env"), {"FINAL_K": "5", "BM25_B": "0.5"}, spark)
    finally:
        spark.conf.unset("quarry.final_k")
        spark.conf.unset("spark.quarry.neighbor_expansion")
    assert (s.dense_k, s.final_k, s.bm25_b, s.neighbor_expansion, s.rrf_k) == (7, 3, 0.5, False, 60)
    assert Settings.load(None, {}, spark) == Settings()


def test_warm_up_reads_once(spark, tmp_path):
    for name in ("docs", "vectors"):
        spark.range(10).write.parquet(f"{tmp_path}/{name}")
    docs, vectors = warm_up(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "vectors")))
    try:
        assert docs.is_cached and vectors.is_cached
        assert "InMemoryTableScan" in docs._jdf.queryExecution().executedPlan().toString()
        assert docs.count() == vectors.count() == 10
    finally:
        docs.unpersist(), vectors.unpersist()
