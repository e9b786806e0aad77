"""Steps that must be dealt over tasks, or give the same, whatever the size of their input."""

import duckdb
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_phrases_are_dealt_over_tasks(spark):
    """a small file of customers, of which phrases are many, was one task."""
    from quarry.plans.dialogue import _phrases

    phrases = _phrases(spark, DIR)
    rows = phrases.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in rows) == 23 * 150


def test_units_keep_the_sign_of_zero(spark, tmp_path):
    """of many vectors some have a component that rounds to zero from below; DuckDB leaves it negative."""
    from quarry.plans.registry import ORACLE_SQL
    from quarry.plans.texts import l2_normalize

    rows = [(0, [1.0, -1e-8, 1e-8, -0.5]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1e30, -1e-30]), (4, None), (5, [0.5, None]), (6, [3.0, -4.0, 0.0000005])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = ORACLE_SQL["l2_normalize"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(duckdb.sql(sql).fetchall())
    assert "-0.0" in repr(want[0])
    assert repr(sorted((r.vec_id, r.unit) for r in l2_normalize(spark, str(tmp_path)).collect())) == repr(want)


def test_pages_of_a_language_are_in_files_of_several_tasks(spark, tmp_path, monkeypatch):
    """the texts of a language went through one task into one file."""
    from quarry.plans import texts

    docs = spark.createDataFrame([(k, f"text {k % 30}\nmore", "en") for k in range(90)], "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(texts, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    assert {tuple(r) for r in texts.page_scan(spark, str(tmp_path)).collect()} == {("en", f"text {k}\nmore", 3) for k in range(30)}
    assert len(list(tmp_path.glob("pages/lang=en/part-*"))) > 1


def test_the_best_of_parts_are_the_best_of_all(spark, monkeypatch):
    """F12, F16-F18, F20, F22: searches shuffled a row for each pair of question and document; ties, odd vectors and several parts a task."""
    import random

    from quarry.operators import retrieve

    rnd = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for k in range(300)] + [(300 + k, "w1 w2 w3") for k in range(40)] + [(900, None)]
    docs = spark.createDataFrame(docs, "id long, text string").coalesce(2)
    queries = spark.createDataFrame([(k, " ".join(rnd.choice(words) for _ in range(5))) for k in range(8)] + [(8, "w1 w2"), (9, ""), (10, "unknown")], "query_id long, text string")
    monkeypatch.setattr(retrieve, "MATRIX_ROWS", 50)

    def rows(df):
        return sorted((r.query_id, r[-1], r.id, round(r[2], 6)) for r in df.collect())

    want = retrieve.bm25_topk(retrieve.bm25_scores(docs, queries), 5)
    best = retrieve.bm25_best(docs, queries, 5)
    assert rows(best) == rows(want) == rows(retrieve.bm25_best(docs, queries, 5, cells=1)) and best.columns == want.columns
    odd = [(400, None), (401, [1.0]), (402, [float("nan"), 0.0, 0.0]), (403, [None, 1.0, 1.0])]
    vectors = spark.createDataFrame([(k, [rnd.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for k in range(300)] + odd, "id long, embedding array<float>").coalesce(2)
    asked = vectors.filter("id < 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    nan = lambda rows: [tuple(map(repr, r)) for r in rows]
    plain = retrieve.best(retrieve.similarities(vectors, asked).withColumn("sim", F.round("sim", 6)), 30, F.desc("sim"), F.asc("id")).select("query_id", "id", "sim", (F.col("rn") - 1).alias("dense_rank"))
    assert nan(rows(retrieve.dense_topk(vectors, asked, 30))) == nan(rows(plain))


def test_alignments_do_not_depend_on_the_size_of_their_table(monkeypatch):
    """beyond CELLS pairs of children the next of equal shape was taken, so the main text of long pages came by another way."""
    import random

    from quarry.llm import wrappers

    rnd = random.Random(5)

    def tree():
        parts = ["<p>1</p>", "<ul><li>a</li></ul>", "<ul><li>a</li><li>b</li></ul>", "<div><p>x</p></div>", "<div><h2>y</h2><p>x</p></div>"]
        root = wrappers.parse("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))))
        wrappers.numbered(root)
        return root

    trees = [(tree(), tree()) for _ in range(30)]
    want = [wrappers.match(a, b) for a, b in trees]
    for cells in (1, 10, 200):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        assert [wrappers.match(a, b) for a, b in trees] == want
