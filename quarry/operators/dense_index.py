"""Exact dense search over stored cells of vectors, most of which a question never reads.

    pivots/              pivot, centre, width     at most `cells` centres, fitted on a bounded sample
    vectors/batch=N/     id, embedding, part      in folders cell=C: the nearest pivot and the ring of distance around it
    cells/batch=N/       cell, n, least, most, norm     of each cell its rows, distances to its pivot and largest norm

For a question q, a pivot c and vectors x at distances [least, most] of c, with D = |q - c|:

    q.x <= q.c + |q| most                                            (Cauchy-Schwarz on x - c)
    q.x <= (|q|^2 + norm^2 - max(0, D - most, least - D)^2) / 2      (triangle inequality on q, c, x)

A question first reads its cells of the highest bounds, until they hold k vectors; the k-th best of these is a threshold,
and of the other cells only those are read whose bound reaches it. Results are those of comparing all pairs. Folders of cells
that no question reads are pruned from the scan. Few pairs of question and cell (counted) are broadcast; more meet the
vectors by (cell, part), where `part` splits a cell of any size by its ids.

Vectors and questions that are null, of another length than the pivots, or hold null or non-finite numbers take no part. Rows that
repeat are rows of their own. Cells of a batch that is written again are replaced. An empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.operators.retrieve import best, dot
from quarry.sources.folders import ensure_checkpoint_dir

#: Rings of distance around a pivot; the last one is open.
RINGS = 8


def whole(vector: Column, size: int | None = None) -> Column:
    """Whether a vector takes part: of `size` numbers, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    long = (F.size(vector) > 0) & (F.lit(size is None) | (F.size(vector) == (size or 0)))
    return F.coalesce(vector.isNotNull() & long & finite, F.lit(False))


def fit_pivots(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """At most `count` centres of the rows of x: each the farthest from those before, then means of the rows nearest to them."""
    chosen = [0]
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class DenseIndex:
    """An index below `base`. `cells` bounds the pivots, `sample` the vectors that they are fitted on."""

    spark: SparkSession
    base: str
    cells: int = 256
    sample: int = 10_000
    parts: int = 8
    id_type: str = "bigint"

    def _pivots(self) -> tuple[np.ndarray, float]:
        rows = sorted(self.spark.read.schema("pivot int, centre array<double>, width double").parquet(f"{self.base}/pivots").collect())  # at most `cells`
        if not rows:
            return np.zeros((0, 0)), 1.0
        return np.array([r["centre"] for r in rows], "float64"), rows[0]["width"]

    def begin(self, vectors: DataFrame) -> None:
        """Fit and store the pivots on the `sample` vectors of least hash."""
        rows = vectors.filter(whole(F.col("embedding"))).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        drawn = [r["embedding"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(self.sample).collect()]
        sizes = [len(v) for v in drawn]
        size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
        out: list[tuple] = []
        if size:
            x = np.array([v for v in drawn if len(v) == size])
            centres = fit_pivots(x, max(1, min(self.cells, len(x) // 16)))
            away = np.sqrt(((x - centres[nearest(x, centres)]) ** 2).sum(axis=1))
            out = [(k, c.tolist(), float(away.mean()) / 2 or 1.0) for k, c in enumerate(centres)]
        self.spark.createDataFrame(out, "pivot int, centre array<double>, width double").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/pivots")

    def add(self, vectors: DataFrame, batch: int) -> None:
        """Add vectors (id, embedding) as batch number `batch`, each vector in one batch only; `begin` comes before."""
        centres, width = self._pivots()
        dims = centres.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                x = _matrix(rows.column("embedding"), dims)
                near = nearest(x, centres)
                away = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
                ring = np.minimum(away / width, RINGS - 1).astype("int32")
                added = [pa.array((near * RINGS + ring).astype("int32")), pa.array(away), pa.array(np.sqrt((x**2).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("embedding"), *added], ["id", "embedding", "cell", "away", "norm"])

        rows = vectors.filter(whole(F.col("embedding"), dims)).select(F.col("id").cast(self.id_type).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        placed = rows.mapInArrow(place, f"id {self.id_type}, embedding array<double>, cell int, away double, norm double")
        stored = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int"))
        stored.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").option("maxRecordsPerFile", 1_000_000).parquet(f"{self.base}/vectors/batch={batch}")
        written = self.vectors().filter(F.col("batch") == batch)
        counted = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"), F.max("norm").alias("norm"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/cells/batch={batch}")  # a row for each cell

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, embedding array<double>, away double, norm double, part int, batch long, cell int").parquet(f"{self.base}/vectors")

    def counts(self) -> DataFrame:
        """cell, n, least, most, norm over all batches."""
        stored = self.spark.read.schema("cell int, n long, least double, most double, norm double, batch long").parquet(f"{self.base}/cells")
        return stored.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("norm").alias("norm"))

    def bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, qvec, probe, cells: all cells (cell, n, bound) from the highest bound down; the first `probe` hold k vectors."""
        centres, _ = self._pivots()
        dims = centres.shape[1]
        counts = self.counts().orderBy("cell").toPandas()  # at most RINGS rows a pivot
        cell, n = counts["cell"].to_numpy("int64"), counts["n"].to_numpy("int64")
        least, most, norm = (counts[c].to_numpy("float64") for c in ("least", "most", "norm"))
        kind = dict(queries.dtypes)["query_id"]
        struct = pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("bound", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivot = centres[cell // RINGS]
            for rows in batches:
                probes, lists = [], []
                for q in _matrix(rows.column("qvec"), dims):
                    size, apart = np.sqrt(q @ q), np.sqrt(((q - pivot) ** 2).sum(axis=1))
                    gap = np.maximum(0, np.maximum(apart - most, least - apart))
                    bound = np.minimum(pivot @ q + size * most, (size * size + norm * norm - gap * gap) / 2)
                    bound = bound + 1e-6 + 1e-9 * (size + norm) ** 2  # similarities are rounded to six places, sums to doubles
                    order = np.lexsort((cell, -bound))
                    probes.append(int(min(len(order), np.searchsorted(np.cumsum(n[order]), k) + 1)))
                    lists.append(pa.StructArray.from_arrays([pa.array(cell[order].astype("int32")), pa.array(n[order]), pa.array(bound[order])], fields=list(struct)))
                offsets = pa.array(np.arange(len(lists) + 1, dtype="int32") * len(cell))
                values = pa.concat_arrays(lists) if lists else pa.array([], struct)
                yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("qvec"), pa.array(probes, pa.int32()), pa.ListArray.from_arrays(offsets, values)], ["query_id", "qvec", "probe", "cells"])

        rows = queries.filter(whole(F.col("qvec"), dims)).select("query_id", F.col("qvec").cast("array<double>").alias("qvec"))
        return rows.mapInArrow(run, f"query_id {kind}, qvec array<double>, probe int, cells array<struct<cell: int, n: bigint, bound: double>>")

    def _meet(self, pairs: DataFrame, k: int, limit: int) -> DataFrame:
        """The best k of each query over its cells (pairs: query_id, qvec, cell)."""
        count, numbers, cells = pairs.agg(F.count(F.lit(1)), F.sum(F.size("qvec")), F.collect_set("cell")).first()  # at most RINGS cells a pivot
        vectors = self.vectors().filter(F.col("cell").isin(cells)).select("id", "embedding", "cell", "part")
        if 8 * (numbers or 0) + 100 * count <= limit:
            met = vectors.join(F.broadcast(pairs), "cell")
        else:
            met = vectors.join(pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))), ["cell", "part"])
        scored = met.select("query_id", "id", F.round(dot(F.col("embedding"), F.col("qvec")), 6).alias("sim"))
        return best(scored, k, F.desc("sim"), F.asc("id")).drop("rn")

    def pairs(self, queries: DataFrame, k: int = DEFAULTS.dense_k, limit: int = 32_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a search reads: the pairs (query_id, qvec, cell, n) read first, the best k of these, and the pairs read after."""
        ensure_checkpoint_dir(self.spark)
        planned = self.bounds(queries, k).checkpoint()  # used three times
        first = planned.select("query_id", "qvec", F.inline(F.slice("cells", F.lit(1), F.col("probe"))))
        top = self._meet(first.select("query_id", "qvec", "cell"), k, limit).checkpoint()  # k rows a query
        reached = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("reached"))
        later = planned.join(reached, "query_id", "left").select("query_id", "qvec", "reached", F.inline(F.slice("cells", F.col("probe") + 1, F.size("cells"))))
        return first, top, later.filter("reached IS NULL OR bound >= reached").select("query_id", "qvec", "cell", "n")

    def search(self, queries: DataFrame, k: int = DEFAULTS.dense_k, limit: int = 32_000_000) -> DataFrame:
        """query_id, id, sim, dense_rank (from 0) as retrieve.dense_topk gives them; queries: query_id (unique), qvec."""
        _, top, later = self.pairs(queries, k, limit)
        both = top.unionByName(self._meet(later.select("query_id", "qvec", "cell"), k, limit))
        ranked = best(both, k, F.desc("sim"), F.asc("id"))
        return ranked.select("query_id", "id", "sim", (F.col("rn") - 1).cast("long").alias("dense_rank"))
