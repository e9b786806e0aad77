"""The search index: postings, term statistics and vectors as tables."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions.text import index_tokens


def indexed_text(header: Column, text: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n"), text)).otherwise(text)


def tokens(docs: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """id, pos, token: the index tokens in order."""
    return docs.select(F.col(id_column).alias("id"), F.posexplode(index_tokens(F.col(text_column))).alias("pos", "token"))


def postings(docs: DataFrame, id_column: str = "id", text_column: str = "text", only: DataFrame | None = None) -> DataFrame:
    """id, token, tf, dl (length of the document in tokens); one shuffle, with partial counts. `only`: (token) to keep."""
    listed = docs.select(F.col(id_column).alias("id"), index_tokens(F.col(text_column)).alias("t"))
    rows = listed.select("id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    if only is not None:
        rows = rows.join(only, "token", "left_semi")
    return rows.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """n_docs and avgdl in one row."""
    n = F.size(index_tokens(F.col(text_column)))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum(F.coalesce(n, F.lit(0))) / F.count(F.lit(1))).alias("avgdl"))


def token_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """token, df, length: of each token the documents that have it; of the token null all documents and their length."""
    listed = docs.select(index_tokens(F.col(text_column)).alias("t"))
    own = F.array_append(F.array_distinct(F.coalesce("t", F.array().cast("array<string>"))), F.lit(None).cast("string"))
    rows = listed.select(F.coalesce(F.size("t"), F.lit(0)).alias("n"), F.explode(own).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("token").isNull(), F.greatest("n", F.lit(0)))).alias("length"))


def counted_stats(counted: DataFrame) -> DataFrame:
    """n_docs and avgdl in one row, of token_counts."""
    return counted.filter("token IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), (F.sum("length") / F.sum("df")).alias("avgdl"))


def counted_terms(counted: DataFrame, stats: DataFrame, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
    """token, df, idf, of token_counts."""
    return _idf(counted.filter("token IS NOT NULL").select("token", "df"), stats, epsilon)


def term_stats(posted: DataFrame, stats: DataFrame, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
    """token, df, idf: Okapi idf, where negative values become `epsilon` times the mean of all idf values."""
    return _idf(posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")), stats, epsilon)


def _idf(counts: DataFrame, stats: DataFrame, epsilon: float) -> DataFrame:
    df = counts.crossJoin(F.broadcast(stats.select("n_docs")))  # one row
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + F.lit(0.5).cast("double")) - F.log(F.col("df") + F.lit(0.5).cast("double")))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("mean_idf") * F.lit(epsilon)).otherwise(F.col("raw")).alias("idf"))  # one row


def l2_normalize(vector: Column, eps: float = 1e-9) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0)))) + F.lit(eps)
    return F.transform(vector, lambda x: x.cast("double") / norm)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero on its binary value; unlike F.round it leaves a negative value's zero negative."""
    scale = float(10**digits)
    scaled = F.abs(x) * F.lit(scale)
    down = F.floor(scaled).cast("double")
    near = F.signum(x) * ((down + F.when(scaled - down >= F.lit(0.5).cast("double"), F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale))
    return F.when(F.isnan(x) | (scaled >= F.lit(float(2**52))), x).otherwise(near)  # no fraction to round, or none that a double holds


def embed(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text_column: str = "text", batch: int = DEFAULTS.embedding_batch) -> DataFrame:
    """Adds `embedding`, L2-normalised, by calls of at most `batch` texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[float]] = []
            values = [t if isinstance(t, str) else "" for t in texts]
            for k in range(0, len(values), batch):
                out += [list(map(float, v)) for v in embedder(values[k : k + batch])]
            yield pd.Series(out)

    udf = F.pandas_udf("array<double>")(run)
    return df.withColumn("_raw", udf(F.col(text_column))).withColumn("embedding", l2_normalize(F.col("_raw"))).drop("_raw")

