"""Target-distribution importance resampling over hashed word runs.

1. Identical texts are collapsed by grouping the full text; each class keeps its number of copies.
2. The features of a class (runs of 1 to `longest` words) are hashed into buckets once and written as a table of
   (bucket, count). Corpus totals are sums over classes, each times its copies.
3. A bucket's gain is the scaled log-ratio of its smoothed shares in the target and in the corpus; a class's weight is the
   floored mean gain of its features, looked up in the table of buckets (of constant size).
4. Weights go back to the documents by the SHA-256 of the text. Classes with more than a `1 / HOT_SHARE` of all rows are at most
   `HOT_SHARE` many and are broadcast; the others meet their documents in a shuffle of hashes.
5. Each document adds its own noise (Gumbel, from a hash of its id), and the highest scores are drawn: sampling
   without replacement in proportion to the weights.
6. Ranks come from a range partitioning by score: place in the partition plus the sizes of those before it. No
   task holds more than its range.

Edge cases: a null text counts as ''; texts without words have no features and weight 0; a null id is hashed as '' and sorts
first; rows that repeat get the same weight and noise and are ranked one after the other; empty tables give empty
results, and with an empty target the gains are those of smoothing alone; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir, frugal, shuffle_partitions, table, texts
from quarry.llm.packed import pack, unpack, word_bytes
from quarry.llm.positional import WORDS_SQL
from quarry.sources.folders import scratch

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
HOT_SHARE = 1_000


def feature_hashes(words: list[bytes], longest: int = LONGEST) -> list[int]:
    """CRC-32 of every run of 1 to `longest` words, joined by one blank; a longer run goes on from the shorter one's."""
    runs = list(map(crc32, words))
    out = list(runs)
    for n in range(1, longest):
        runs = list(map(crc32, words[n:], map(crc32, repeat(b" "), runs)))
        out += runs
    return out


def text_key(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def text_classes(df: DataFrame, text_column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """key, copies, n_words, n_features, buckets, counts: one row for each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, which, counts = [], [], [], []
            for text in texts(batch, "text"):
                words = word_bytes(text)
                found, count = np.unique(np.array(feature_hashes(words, longest), "int64") % buckets, return_counts=True)
                n_words.append(len(words))
                n_features.append(int(count.sum()))
                which.append(pack(found))
                counts.append(pack(count))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(which, pa.binary()), pa.array(counts, pa.binary())], ["key", "copies", "n_words", "n_features", "buckets", "counts"])

    whole = df.select(F.coalesce(F.col(text_column), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = whole.select(text_key("text").alias("key"), "copies", F.col("text").cast("binary").alias("text"))
    return keyed.mapInArrow(frugal(run), "key binary, copies long, n_words long, n_features long, buckets binary, counts binary")


def bucket_totals(classes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, total: occurrences in all copies. A task returns a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "int64")
        for batch in batches:
            for copies, which, counts in zip(*(batch.column(c).to_pylist() for c in ("copies", "buckets", "counts"))):
                total[unpack(which)] += unpack(counts).astype("int64") * copies
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "total"])

    return classes.select("copies", "buckets", "counts").mapInArrow(run, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def bucket_gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log-ratio) of every bucket; `corpus` and `target` are totals."""
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("total", "s"), "bucket", "left").join(target.withColumnRenamed("total", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = both.select("bucket", "s", "t").collect()  # one row a bucket
    big_s, big_t = sum(r.s for r in rows), sum(r.t for r in rows)
    pairs = spark.createDataFrame([(r.bucket, float(r.s), float(r.t)) for r in rows], "bucket long, s double, t double")
    ratio = (F.col("t") + 1.0) * F.lit(float(big_s + buckets)) / ((F.col("s") + 1.0) * F.lit(float(big_t + buckets)))
    gains = np.zeros(buckets, "int64")
    for r in pairs.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        gains[r.bucket] = r.gain
    return gains


def class_weights(classes: DataFrame, gains: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features, weight."""
    sent = classes.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int((sent.value[unpack(b)] * unpack(c)).sum()) for b, c in zip(batch.column("buckets").to_pylist(), batch.column("counts").to_pylist())]
            weights = [s // n if n else 0 for s, n in zip(sums, batch.column("n_features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "copies", "n_words", "n_features")), pa.array(weights, pa.int64())], ["key", "copies", "n_words", "n_features", "weight"])

    return classes.mapInArrow(run, "key binary, copies long, n_words long, n_features long, weight long")


def joined_back(rows: DataFrame, weights: DataFrame, count: int) -> DataFrame:
    """`rows` (id, key) with n_words, n_features and weight of their class."""
    hot = weights.filter(F.col("copies") * HOT_SHARE > count)  # at most HOT_SHARE classes
    cold = weights.filter(F.col("copies") * HOT_SHARE <= count)
    columns = ["id", "n_words", "n_features", "weight"]
    hot_rows = rows.join(F.broadcast(hot), "key").select(*columns)
    return hot_rows.union(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key").select(*columns))


def noise(seed: int = SEED) -> F.Column:
    """floor(1000 * Gumbel noise) of the column id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Add `rank`, 1, 2, 3 ... in the given order, without holding all rows in one task."""
    parts = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    numbered = parts.withColumn("_at", F.monotonically_increasing_id()).checkpoint()  # partition number, then place in it
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, numbered.groupBy(part.alias("p")).count().collect()))  # one row a partition
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    starts = rows.sparkSession.createDataFrame(list(before.items()), "_p long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("rank", F.col("_before") + place + 1).drop("_at", "_p", "_before")


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id_column, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Of the documents with `min_words` words at least, floor(percent / 100) are drawn.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch(spark, "classes")
    text_classes(docs, text_column, longest, buckets).write.option("compression", "zstd").parquet(path)
    classes = spark.read.parquet(path)
    wanted = text_classes(target, target_column, longest, buckets)
    gains = bucket_gains(spark, bucket_totals(classes, buckets), bucket_totals(wanted, buckets), buckets)
    rows = docs.select(F.col(id_column).alias("id"), text_key(text_column).alias("key")).checkpoint()
    weights = class_weights(classes, gains).checkpoint()  # a hash and four numbers a class, read by both joins
    scored = joined_back(rows, weights, rows.count()).withColumn("score", F.col("weight") + noise(seed)).checkpoint()
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("weight")]
    with_rank = ranked(scored.filter(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = with_rank.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")


def op12_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_sql(x: str) -> str:
    """CRC-32 of a string in DuckDB: byte by byte over its hex form, each byte as two half bytes, the low one first."""
    table = "[" + ", ".join(str(crc32(bytes([k << 4])) ^ crc32(b"\0")) for k in range(16)) + "]::BIGINT[]"
    step = lambda c, b: f"xor(({c}) >> 4, ({table})[(xor(({c}), {b}) & 15) + 1])"
    octets = f"list_transform(range(0, octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: {step(step('c', 'b'), '(b >> 4)')}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP12_SQL = f"""WITH texts AS (SELECT row_number() OVER () AS rid, true AS own, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -row_number() OVER (), false, NULL, coalesce(text, '') FROM benchmark),
parts AS (SELECT rid, own, doc_id, {WORDS_SQL.format(x='text')} AS w FROM texts),
runs AS (SELECT rid, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM parts),
hashed AS (SELECT f, {_crc_sql('f')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM runs)),
placed AS (SELECT rid, own, bucket FROM runs JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + {BUCKETS}) / ((s + 1)::DOUBLE * (big_t + {BUCKETS}))))::BIGINT AS gain FROM counts CROSS JOIN sums),
weights AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE own GROUP BY rid),
noised AS (SELECT rid, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM parts WHERE own),
scored AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(CASE WHEN total >= 0 THEN total // n_features ELSE -((-total + n_features - 1) // n_features) END, 0) AS weight, floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM parts JOIN noised USING (rid) LEFT JOIN weights USING (rid)),
able AS (SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features, weight) AS rank FROM scored WHERE n_words >= {MIN_WORDS}),
drawn AS (SELECT rid, rank FROM able WHERE rank <= {PERCENT} * (SELECT count(*) FROM able) // 100)
SELECT doc_id, n_features, weight, weight + noise AS score, rank FROM scored LEFT JOIN drawn USING (rid)"""
