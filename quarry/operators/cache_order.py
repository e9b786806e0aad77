"""The semantic cache used in the order of questions: an answer stored early in a batch serves later ones, and eviction happens in between.

A cache of bounded size in order of use always holds the most recently used keys, so what a stretch of questions needs to know of
all before it is a list of at most `size` entries. Questions are cut into blocks by their order. All blocks run at once, each
from an assumed state; what each block used is then put together over all blocks before it (by doubling), and only blocks
whose state turns out different run again. When no state changes, the result is that of one question after the other: the first
block starts from the true state, so each next one does too. Blocks are settled as far as their entries are, which takes a few rounds
where questions repeat earlier ones, and at most as many rounds as there are blocks.

Edge cases: questions without a vector neither hit nor are stored; a question that may not be stored (`cacheable` false) only looks up, null
counts as true; a key that is stored again replaces its entry; of equal similarities (six digits) the entry used longest
ago wins; an empty cache and an empty batch are fine. query_id must be unique and gives the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.sources.folders import scratch

BLOCK_ROWS = 4_096
#: Entries in order of use; `own` is false where a stretch only hit an entry, whose source then lies before the stretch.
ENTRY = "array<struct<key:string,source:long,used:long,own:boolean>>"


@dataclass(frozen=True)
class Replayed:
    """decisions: query_id, hit_key, hit_source, sim, stored. state: nth (order of use from 0), key, source, used.

    `source` is the question whose answer an entry holds, null for entries of the cache at the start; `used` is the last
    question that stored or hit it, null if none has.
    """

    decisions: DataFrame
    state: DataFrame
    rounds: int


def _written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder. A checkpoint would keep what Spark has inferred of its columns, which doubles with every merge."""
    path = scratch(df.sparkSession, "cache")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _simulate(size: int, threshold: float):
    """One block: its questions in order over the entries that it starts with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["_block"].iloc[0])
        held, asked = rows[rows["nth"].notna()].sort_values("nth"), rows[rows["nth"].isna()].sort_values("query_id")
        given = [v for v in rows["vec"] if v is not None]
        width = len(given[0]) if given else 0
        vectors, norms = np.zeros((size + 1, width)), np.zeros(size + 1)
        langs, stamps = np.full(size + 1, None, object), np.full(size + 1, np.inf)  # a free place has no stamp
        slot: dict[str, int] = {}
        sources: dict[str, tuple] = {}  # key -> source, used
        free, clock, touched, stored, out = list(range(size + 1)), 0, set(), set(), []

        def put(key: str, vec, lang, source, used) -> None:
            at = slot.pop(key) if key in slot else free.pop()
            slot[key] = at
            vectors[at], langs[at], stamps[at] = vec, lang, clock
            norms[at] = np.sqrt(vectors[at] @ vectors[at])
            sources[key] = (source, used)
            if len(slot) > size:
                oldest = next(iter(slot))
                free.append(slot.pop(oldest))
                stamps[free[-1]], langs[free[-1]] = np.inf, None
                sources.pop(oldest)

        for r in held.itertuples():
            put(r.key, r.vec, r.lang, None if pd.isna(r.source) else int(r.source), None if pd.isna(r.used) else int(r.used))
            clock += 1
        names = {at: key for key, at in slot.items()}
        for r in asked.itertuples():
            query = int(r.query_id)
            if r.vec is None:
                out.append((block, query, None, None, None, False))
                continue
            vec = np.asarray(r.vec, "float64")
            sims = np.where(langs == r.lang, np.round(vectors @ vec / (norms * np.sqrt(vec @ vec) + 1e-9), 6), -np.inf)
            sims[np.isinf(stamps)] = -np.inf
            best = sims.max(initial=-np.inf)
            if best >= threshold:
                at = int(min(np.flatnonzero(sims == best), key=stamps.__getitem__))
                key = names[at]
                slot[key] = slot.pop(key)
                stamps[at] = clock
                source = sources[key][0]
                sources[key] = (source, query)
                touched.add(key)
                out.append((block, query, key, source, float(best), False))
            elif r.cacheable is None or pd.isna(r.cacheable) or r.cacheable:
                put(r.key, vec, r.lang, query, query)
                names[slot[r.key]] = r.key
                touched.add(r.key)
                stored.add(r.key)
                out.append((block, query, None, None, None, True))
            else:
                out.append((block, query, None, None, None, False))
            clock += 1
        used = [{"key": k, "source": sources[k][0], "used": sources[k][1], "own": k in stored} for k in slot if k in touched]
        frame = pd.DataFrame([(*r, None) for r in out] + [(block, None, None, None, None, None, used)], columns=["_block", "query_id", "hit_key", "hit_source", "sim", "stored", "entries"], dtype=object)
        return frame.astype({"_block": "int64", "query_id": "Int64", "hit_source": "Int64", "sim": "float64", "stored": "boolean"})

    return run


def _merged(older: Column, newer: Column, size: int) -> Column:
    """The most recently used entries of two stretches, oldest first."""
    keys = F.transform(newer, lambda e: e["key"])

    def traced(e: Column) -> Column:
        before = F.get(F.filter(older, lambda o: o["key"] == e["key"]), F.lit(0))
        return F.when(e["own"] | before.isNull(), e).otherwise(F.struct(e["key"].alias("key"), before["source"].alias("source"), e["used"].alias("used"), before["own"].alias("own")))

    newer = F.transform(newer, traced)
    both = F.concat(F.filter(older, lambda e: ~F.array_contains(keys, e["key"])), newer)
    return F.when(F.size(both) > size, F.slice(both, F.size(both) - size + 1, size)).otherwise(both)


def _named(entries: str) -> Column:
    """What decisions depend on."""
    return F.transform(entries, lambda e: F.struct(e["key"], e["source"]))


def _starts(used: DataFrame, blocks: int, size: int) -> DataFrame:
    """_block, entries: the state before each block, from what each block has used (block 0: the cache at the start)."""
    step = 1
    while step <= blocks:
        before = used.select((F.col("_block") + step).alias("_block"), F.col("entries").alias("_older"))
        used = _written(used.join(before, "_block", "left").select("_block", F.when(F.col("_older").isNull(), F.col("entries")).otherwise(_merged(F.col("_older"), F.col("entries"), size)).alias("entries")))
        step *= 2
    return used


def cache_replay(questions: DataFrame, cache: DataFrame | None = None, size: int = DEFAULTS.semantic_cache_size, threshold: float = DEFAULTS.semantic_cache_threshold, block_rows: int = BLOCK_ROWS) -> Replayed:
    """questions: query_id (order), key, vec, lang, cacheable; cache: key, vec, lang, last_access and, if there is one, last_query."""
    spark = questions.sparkSession
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "key", F.col("vec").cast("array<double>").alias("vec"), "lang", F.col("cacheable").cast("boolean").alias("cacheable"))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = _written(asked.repartitionByRange(blocks, "query_id").withColumn("_block", F.spark_partition_id() + 1))
    known = None
    if cache is not None:
        order = ["last_access", *(["last_query"] if "last_query" in cache.columns else []), "key"]
        held = cache.select("key", F.col("vec").cast("array<double>").alias("vec"), "lang", F.struct(*order).alias("_order"))
        known = _written(held.orderBy(F.desc("_order")).limit(size))  # bounded by the size of the cache
    if known is None:
        start = spark.range(1).select(F.lit(0).alias("_block"), F.array().cast(ENTRY).alias("entries"))
    else:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_order", "key"))), lambda e: F.struct(e["key"].alias("key"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("used"), F.lit(True).alias("own")))
        start = known.agg(listed.alias("entries")).select(F.lit(0).alias("_block"), "entries")
    empty = F.array().cast(ENTRY)
    numbers = spark.range(1, blocks + 1).select(F.col("id").cast("int").alias("_block"))
    states = _written(numbers.select("_block", empty.alias("entries")).filter("_block > 1").union(start.select(F.lit(1).alias("_block"), "entries")))
    pending, results, last = states, [], numbers.withColumn("_round", F.lit(-1))
    used = None
    while True:
        entries = pending.select("_block", F.posexplode("entries").alias("nth", "e")).select("_block", "nth", "e.key", "e.source", "e.used")
        own = entries.filter("source IS NOT NULL").join(asked.select(F.col("query_id").alias("source"), "vec", "lang"), "source")
        rows = own.select("_block", "nth", "key", "source", "used", "vec", "lang")
        if known is not None:
            rows = rows.unionByName(entries.filter("source IS NULL").join(F.broadcast(known.select("key", "vec", "lang")), "key").select("_block", "nth", "key", "source", "used", "vec", "lang"))
        rows = rows.withColumns({"query_id": F.lit(None).cast("long"), "cacheable": F.lit(None).cast("boolean")})
        todo = asked.join(pending.select("_block"), "_block").withColumns({"nth": F.lit(None).cast("int"), "source": F.lit(None).cast("long"), "used": F.lit(None).cast("long")})
        ran = rows.unionByName(todo).groupBy("_block").applyInPandas(_simulate(size, threshold), f"_block int, query_id long, hit_key string, hit_source long, sim double, stored boolean, entries {ENTRY}")
        results.append(_written(ran.withColumn("_round", F.lit(len(results)))))
        now = results[-1].filter("entries IS NOT NULL").select("_block", "entries")
        last = _written(last.join(pending.select("_block", F.lit(len(results) - 1).alias("_new")), "_block", "left").select("_block", F.coalesce("_new", "_round").alias("_round")))
        used = now if used is None else used.join(now.select("_block"), "_block", "left_anti").unionByName(now)
        used = _written(numbers.join(used, "_block", "left").select("_block", F.coalesce("entries", empty).alias("entries")))
        reached = _starts(used.union(start.select(F.col("_block").cast("int"), "entries")), blocks, size)
        before = reached.select((F.col("_block") + 1).alias("_block"), F.filter("entries", lambda e: e["own"]).alias("entries")).filter(F.col("_block") <= blocks)
        pending = _written(before.join(states.select("_block", F.col("entries").alias("_was")), "_block").filter(_named("entries") != _named("_was")).select("_block", "entries"))
        if pending.isEmpty():
            break
        states = before
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    decisions = every.filter("query_id IS NOT NULL").join(last, ["_block", "_round"]).select("query_id", "hit_key", "hit_source", "sim", "stored")
    end = reached.filter(F.col("_block") == blocks).select(F.posexplode("entries").alias("nth", "e")).select("nth", "e.key", "e.source", "e.used")
    return Replayed(decisions, end, len(results))
