"""Words are dealt into parts by their count, and what is stored and searched is not a row for each posting or pair."""

from pyspark.sql import functions as F

from quarry.operators.layout import find_tables
from quarry.operators.retrieve import bm25_scores, bm25_topk
from quarry.operators.stored_index import StoredIndex

WORDS = "doc_id long, page int, x0 double, x1 double, top double, bottom double, text string"


def test_parts_follow_the_count_of_words_and_change_no_table(spark):
    words = [(d, 1, x, x + 20.0, y, y + 10.0, f"w{d}") for d in range(40) for x in (10.0, 90.0) for y in (10.0, 24.0, 38.0)]
    df = spark.createDataFrame(words, WORDS)
    few, many = find_tables(df), find_tables(df, part_words=10)
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (4, 24)  # a task a core, or 240 words in tens
    assert few.count() == 40 and sorted(few.collect()) == sorted(many.collect())


def test_a_bucket_is_written_by_as_many_tasks_as_its_postings_ask_for(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * j) % 37}" for j in range(1, 12))) for i in range(200)], "id string, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w36 w5")], "query_id int, text string")
    whole, split = (StoredIndex(spark, f"{tmp_path}/{n}", buckets=4, task_postings=n) for n in (1_000_000, 100))
    for index in (whole, split):
        index.add(docs, 0)
    files = [len(list((tmp_path / str(n) / "postings" / "batch=0").glob("*.parquet"))) for n in (1_000_000, 100)]
    assert files[0] <= 4 < files[1]
    assert sorted(split.postings().collect()) == sorted(whole.postings().collect())
    ranked = [sorted((r.query_id, r.id, round(r.score, 9)) for r in i.scores(asked).collect()) for i in (whole, split)]
    plain = sorted((r.query_id, r.id, round(r.score, 9)) for r in bm25_scores(docs, asked).collect())
    assert ranked == [plain, plain]


def test_blocks_hold_the_postings_and_pass_on_the_best(spark, tmp_path):
    """each posting was a row that was shuffled and sorted, and each pair of question and document another."""
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(1, 12)) for i in range(400)] + ["w1 w2"] * 50 + [None, "", "  ", "w5", "w6", "$5.00%w7", "\u0130W8 \u212aw9\u00e9w1\n\tW2", "\u00e9\u00e9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3 w2"), (2, "w36 w5"), (3, "unknown"), (4, "kw9 $5.00%w7"), (5, None), (6, " ".join(f"w{k}" for k in range(37)))], "query_id int, text string")
    index = StoredIndex(spark, f"{tmp_path}/i", buckets=2, id_type="bigint", task_postings=200)
    index.add(docs.filter("id % 3 = 0"), 0)
    index.add(docs.filter("id % 3 > 0"), 1)
    index.add(docs.filter("id % 3 > 0"), 1)  # a batch that is written again replaces itself
    index.add(docs.filter("id < 0"), 2)
    ranked = lambda df: sorted((r.query_id, r.bm25_rank, r.id, round(r.score, 9)) for r in df.collect())
    want = ranked(bm25_topk(bm25_scores(docs, asked), 7))
    assert len(want) > 20 and ranked(index.best(asked, 7)) == ranked(index.best(asked, 7, broadcast_terms=0)) == want
    rows, postings = spark.read.parquet(f"{tmp_path}/i/postings"), index.postings().count()
    assert rows.agg(F.sum(F.when(F.col("token").isNotNull(), F.col("n")))).first()[0] == postings and rows.count() < postings / 2
    whole = StoredIndex(spark, f"{tmp_path}/w", buckets=2, id_type="bigint")
    whole.add(docs, 0)
    assert whole._scored(asked, 7, 1.5, 0.75, 1_000).count() < whole.scores(asked).count() / 2  # pairs that leave their block


def test_of_documents_with_equal_scores_a_block_passes_on_as_many_as_can_be_best(spark, tmp_path):
    """all copies of a text left their block."""
    docs = spark.createDataFrame([(f"{i}", "w1 w2") for i in range(300)] + [("x", "w3 w4")] * 1 + [(f"y{i}", "w5") for i in range(400)], "id string, text string")
    index = StoredIndex(spark, f"{tmp_path}/i", buckets=2)
    index.add(docs, 0)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w4")], "query_id int, text string")
    assert index._scored(asked, 7, 1.5, 0.75, 1_000).count() <= 2 * 7 + 1
    ranked = [(r.id, r.bm25_rank) for r in index.best(asked, 7).orderBy("query_id", "bm25_rank").collect()]
    assert ranked == [*((i, k) for k, i in enumerate(sorted(map(str, range(300)))[:7])), ("x", 0)]
