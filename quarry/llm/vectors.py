"""Vectors in blocks: what the two searches share.

Rows take part when their id and vector are not null and every component is a finite number. Rows that share an id are
rows of their own, as queries and as candidates. Vectors are packed into blocks of equal dimension, and every query block
meets every candidate block of its dimension: by broadcast where the queries' bytes are checked to be few; beyond that
the query blocks are dealt into groups of as many bytes, and candidate blocks are copied once a group and joined on it.

A query must not find its own row, but other rows of its id. Searches look for one row more than asked for and mark rows
that have the query's id and vector; one marked row, which cannot be told from the query's own, is taken out at last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4_096
QUERY_ROWS = 1_024
BROADCAST_BYTES = 32_000_000
#: Vectors in a shard: a task returns its best k of a query once, so rows between tasks are queries * k * shards.
SHARD_ROWS = 16_384


def usable(df: DataFrame, id_column: str, vector_column: str, nonzero: bool = False) -> DataFrame:
    """id (long), vector (array<double>)."""
    fine = F.forall(vector_column, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    kept = df.filter(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector_column) > 0))
    if nonzero:
        kept = kept.filter(F.exists(vector_column, lambda x: x != 0))
    return kept.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))


def sharded(rows: DataFrame, at_most: int) -> DataFrame:
    """`rows` (id, vector) in shards of about SHARD_ROWS; `at_most` bounds their number from above."""
    return rows.repartition(max(1, -(-at_most // SHARD_ROWS)), "id")


def pack(rows: DataFrame, block_rows: int, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of at most `block_rows` vectors of one dimension: dim, ids and data as bytes (long and double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            x = np.concatenate(data)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([(transform(x) if transform else x).tobytes()], pa.binary())], ["dim", "ids", "data"])

        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                ids, vectors = part.column("id").to_numpy(zero_copy_only=False), part.column("vector")
                sizes = np.asarray(vectors.value_lengths())
                flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    mine, data = held.setdefault(dim, ([], []))
                    mine.append(ids[at])
                    data.append(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                    if sum(map(len, mine)) >= block_rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Numbered blocks of the queries (qb, dim, qids, qdata), written so that the numbers stand, and their bytes."""
    width = queries.select(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("s")).first()
    packed = pack(queries.repartition(max(1, -(-width["n"] // QUERY_ROWS)), "id"), QUERY_ROWS).withColumnsRenamed({"ids": "qids", "data": "qdata"})
    return packed.checkpoint().withColumn("qb", F.monotonically_increasing_id()), (width["s"] or 0) * 8


def block_pairs(candidates: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Every candidate block beside every query block of its dimension."""
    if size <= BROADCAST_BYTES:
        return candidates.join(F.broadcast(blocks), "dim")
    groups = -(-size // BROADCAST_BYTES)
    parts = max(1, -(-2 * candidates.sparkSession.sparkContext.defaultParallelism // groups))  # of the candidates, so that groups alone do not bound the tasks
    left = candidates.withColumn("_part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("_group", F.pmod(F.xxhash64("qb"), F.lit(groups)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, ["_group", "_part", "dim"])


def best_rows(parts: list[tuple], k: int) -> tuple:
    """The best k of each query among (query row, id, score, marked) arrays, by falling score and rising id."""
    a, ids, score, same = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((~same, ids, -score, a))
    a, ids, score, same = a[order], ids[order], score[order], same[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, "int64")
    nth = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return a[nth < k], ids[nth < k], score[nth < k], same[nth < k]


def block_top_k(candidates: DataFrame, queries: DataFrame, k: int, search: Callable, extra: tuple[str, ...] = (), score_type: str = "double") -> DataFrame:
    """query_id, rank, vec_id, score: the best k of each query, ties to the smaller id.

    `candidates` has blocks (dim, ids, data and the `extra` columns); `queries` has single vectors (id, vector).
    search(qids, q, ids, x, floors, *extra) yields (query row, id, score, marked) arrays: the k + 1 best of the block, of
    which those below the query's floor may be left out. Floors are the least of k + 1 scores of blocks before.
    """
    blocks, size = query_blocks(queries)
    pairs = block_pairs(candidates, blocks, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # of each query block, at most its rows * (k + 1)
        names: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                qb, ids = row["qb"], np.frombuffer(row["ids"], "int64")
                names[qb] = np.frombuffer(row["qids"], "int64")
                q, x = (np.frombuffer(row[c], "float64").reshape(-1, row["dim"]) for c in ("qdata", "data"))
                floors = np.full(len(q), -np.inf)
                if qb in held:
                    a, _, score, _ = held[qb]
                    full = np.bincount(a, minlength=len(q)) > k
                    last = np.searchsorted(a, np.arange(len(q)), "right") - 1
                    floors[full] = score[last[full]]
                parts = list(search(names[qb], q, ids, x, floors, *(row[c] for c in extra)))
                held[qb] = best_rows(parts + [held[qb]] if qb in held else parts, k + 1)
        for qb, (a, ids, score, same) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), qb)), pa.array(a.astype("int32")), pa.array(names[qb][a]), pa.array(ids), pa.array(score, pa.int64() if score_type == "long" else pa.float64()), pa.array(same)], ["qb", "qrow", "query_id", "vec_id", "score", "same"])

    found = pairs.select("dim", "qb", "qids", "qdata", "ids", "data", *extra).mapInArrow(run, f"qb long, qrow int, query_id long, vec_id long, score {score_type}, same boolean")
    order = Window.partitionBy("qb", "qrow").orderBy(F.desc("score"), F.asc("vec_id"), F.desc("same"))
    marked = F.sum(F.col("same").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = found.withColumns({"_n": F.row_number().over(order), "_m": marked}).filter(F.col("_n") <= k + 1)
    ranked = ranked.filter(~(F.col("same") & (F.col("_m") == 1))).withColumn("rank", F.col("_n") - F.least("_m", F.lit(1)).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
