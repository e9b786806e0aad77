"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Two collections of `GROUPS` keys each come from 2 * `GROUPS` * `ROWS` minhashes: u_1..u_g and v_1..v_g, every key made
of `ROWS` values. The tables are the pairs (i, j) with j from i to i + `BAND` - 1 (round about), keyed by (u_i, v_j):
g * BAND tables of 2 * ROWS values each for the minhashes of about 2 * g tables. A narrow band keeps the rows of very
similar sets few, which meet in nearly all tables. Measured with g = 32, ROWS = 4 and a band of 12, two sets of
similarity 0.75 fail to meet in 3 of 100,000 cases, while of the pairs at 0.5 some 0.6 meet, at 0.3 some 0.02 and at 0.1 none
of a million, so that loosely similar texts rarely chain.

A table key is only formed from values that another set shares; a lone u_i or v_j cannot meet anything, so this loses
no pair and leaves few rows. Sets that meet in a table are put into one candidate group (components over the tables'
links to the least member, never all pairs of a table). Within a candidate group every pair is settled exactly on the
full sets: an inverted index counts the common shingles of a set with all others at once. Groups beyond `BLOCK_SETS`
sets or `BLOCK_SHINGLES` shingles are cut by size class, and classes by blocks: a link needs sizes within the threshold
of each other, so only blocks of the same class or of neighbouring ones are settled together.

Equal sets are collapsed first, so copies cost nothing beyond one row each. A set, not an id, is a node of the links.

Edge cases: null and empty texts, and texts without words, have empty sets, link with nothing and are kept; texts of
fewer than five words have one shingle, the whole sequence; rows that repeat share a component; rows that share an id
but not a text are linked each by its own text; rows without an id lead no component; an empty table gives an empty
table; other columns play no part. Sets are compared as 64-bit fingerprints of shingles and named by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir, frugal, texts
from quarry.llm.components import connected_components
from quarry.llm.shingles import WordHashes, minhashes, mix, salts, shingle_set

GROUPS, ROWS, BAND = 32, 4, 12
BLOCK_SETS, BLOCK_SHINGLES = 1_000, 1_000_000
#: Most candidate documents for which their ids are broadcast to the scan of the texts (2 longs each); so for large groups.
BROADCAST_IDS = 200_000


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set, as signed integers; (0, 0) if it is empty."""
    if not len(s):
        return 0, 0
    return int(s.sum(dtype="uint64").astype("int64")), int(mix(s).sum(dtype="uint64").astype("int64"))


def _node(one: int, two: int) -> int:
    """The name of a set among the links."""
    return int(mix(np.array([one], "int64").view("uint64") * np.uint64(3) + np.array([two], "int64").view("uint64")).view("int64")[0])


def _mask(groups: int) -> int:
    """The last bits of a key: its place among u_1..u_g, v_1..v_g."""
    return (1 << (2 * groups - 1).bit_length()) - 1


def _sketch(groups: int, rows: int, id_column: str, text_column: str, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known, functions = WordHashes(), salts(2 * groups * rows)
        place = np.arange(2 * groups, dtype="uint64")
        mask = np.uint64(_mask(groups))
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in texts(batch, text_column):
                s = shingle_set(text, known)
                one, two = _hashes(s)
                k = np.zeros(0, "uint64")
                if len(s):
                    m = minhashes(s, functions).reshape(2 * groups, rows)
                    k = place + np.uint64(1)
                    for r in range(rows):
                        k = mix(k * np.uint64(3) + m[:, r])
                    k = k & ~mask | place
                for column, value in zip(columns, (len(s), one, two, _node(one, two), k.view("int64"))):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *map(pa.array, columns, types), *map(batch.column, carry)], ["doc_id", "n_shingles", "h1", "h2", "node", "keys", *carry])

    return run


def sketches(df: DataFrame, groups: int = GROUPS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, its node, and the 2 * groups keys (none for an empty set)."""
    kinds = dict(df.dtypes)
    schema = ", ".join([f"doc_id {kinds[id_column]}, n_shingles long, h1 long, h2 long, node long, keys array<long>", *(f"{c} {kinds[c]}" for c in carry)])
    return df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *carry).mapInArrow(frugal(_sketch(groups, rows, "_id", "_text", carry)), schema)


def candidate_links(sets: DataFrame, groups: int = GROUPS, band: int = BAND) -> DataFrame:
    """Distinct (a, b) where b is the least member of a table key that a has; sets: node, keys."""
    place = sets.select("node", F.explode("keys").alias("k"))
    counted = place.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    shared = place.join(counted, "k", "left_semi")
    per_set = shared.groupBy("node").agg(F.collect_list("k").alias("s"))  # 2 * groups at most
    at = lambda k: k.bitwiseAND(F.lit(_mask(groups)))
    per_set = per_set.select("node", F.filter("s", lambda k: at(k) < groups).alias("u"), F.filter("s", lambda k: at(k) >= groups).alias("v"))
    per_set = per_set.select("node", F.explode("u").alias("u"), "v")
    tables = per_set.select("node", "u", F.explode(F.filter("v", lambda k: F.pmod(at(k) - groups - at(F.col("u")), F.lit(groups)) < band)).alias("v"))
    keyed = tables.select("node", F.xxhash64("u", "v").alias("t"))
    least = keyed.groupBy("t").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keyed.join(least, "t").filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def linked_roots(sizes: np.ndarray, flat: np.ndarray, percent: int) -> np.ndarray:
    """For sets laid end to end in `flat`: the least index reachable over links of 100 * common >= percent * union."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    values = flat[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    lengths = np.diff(np.r_[first, len(values)])
    group = np.empty(len(flat), "int64")
    group[order] = np.repeat(np.arange(len(first)), lengths)
    posted = owner[order]
    ends = np.cumsum(sizes)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(n):
        g = group[ends[x] - sizes[x] : ends[x]]
        g = g[lengths[g] > 1]
        if not len(g):
            continue
        ls = lengths[g]
        at = np.repeat(first[g] - np.r_[0, np.cumsum(ls)[:-1]], ls) + np.arange(ls.sum())
        shared = np.bincount(posted[at], minlength=n)
        for y in np.flatnonzero(100 * shared >= percent * (sizes[x] + sizes - shared)):
            a, b = root(x), root(int(y))
            parent[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(n)])


def _settle(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        blobs = table.column("fingerprints").to_pylist()
        sizes = np.array([len(blobs[k]) // 8 for k in order], "int64")
        flat = np.frombuffer(b"".join([blobs[k] for k in order]), "uint64")
        roots = linked_roots(sizes, flat, percent)
        nodes = nodes[order]
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[roots[moved]], pa.int64())})

    return run


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted nodes, once a task; rows that share an id with them but not the set are left out."""
    np.seterr(over="ignore")
    known, seen = WordHashes(), set()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingle_set(x, known) for x in part.column("text").to_pylist()]
            nodes = part.column("node").to_pylist()
            kept = [k for k, node in enumerate(nodes) if node not in seen and not seen.add(node) and _node(*_hashes(sets[k])) == node]
            if len(seen) > 100_000:
                seen.clear()
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("node").take(rows), part.column("candidate").take(rows), pa.array([sets[k].tobytes() for k in kept], pa.binary())], ["node", "candidate", "fingerprints"])


def _size_class(size: Column, percent: int) -> Column:
    """Sets that may link lie in the same class or in neighbouring ones."""
    return F.floor(F.log(size) / F.log(F.lit(100.0 / percent))).cast("int")


def _places(percent: int) -> Column:
    """The block pairs (class and block of the lesser, class and block of the other) in which a set of a candidate group takes part."""
    kind = _size_class(F.col("n_shingles"), percent)
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("node"), F.get(blocks, kind)).cast("int")

    def pairs(other: Column, pair) -> Column:
        count = F.coalesce(F.when(other >= 0, F.get(blocks, other)), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda z: pair(other, z))).otherwise(F.expr("array()").cast("array<struct<k1:int,b1:int,k2:int,b2:int>>"))

    def place(k1: Column, b1: Column, k2: Column, b2: Column) -> Column:
        return F.struct(k1.cast("int").alias("k1"), b1.cast("int").alias("b1"), k2.cast("int").alias("k2"), b2.cast("int").alias("b2"))

    same = pairs(kind, lambda other, z: place(kind, F.least(own, z), kind, F.greatest(own, z)))
    up = pairs(kind + 1, lambda other, z: place(kind, own, other, z))
    down = pairs(kind - 1, lambda other, z: place(other, z, kind, own))
    one = F.array(place(*[F.lit(0)] * 4))
    return F.when(blocks.isNull(), one).otherwise(F.concat(same, up, down))


def settled_links(texts: DataFrame, groups_of: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b): links that join what 100 * common >= percent * union joins in each candidate group.

    texts: doc_id, text; groups_of: node, candidate, doc_id (a row that has the set), n_shingles.
    """
    by_class = groups_of.groupBy("candidate", _size_class(F.col("n_shingles"), percent).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    need = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    by_group = by_class.withColumn("need", need).groupBy("candidate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("kind").alias("top"), F.map_from_entries(F.collect_list(F.struct("kind", "need"))).alias("m"))  # a class for each third of size
    blocks = F.transform(F.sequence(F.lit(0), F.col("top")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    large = by_group.filter((F.col("n") > BLOCK_SETS) | (F.col("s") > BLOCK_SHINGLES)).select("candidate", blocks.alias("blocks")).checkpoint()
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS // 20 else large
    wanted = groups_of.withColumnRenamed("doc_id", "_rep")
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, F.col("doc_id") == F.col("_rep")).select("node", "candidate", "text")
    sets = picked.mapInArrow(frugal(_fingerprints), "node long, candidate long, fingerprints binary").withColumn("n_shingles", F.length("fingerprints") / 8)
    placed = sets.join(large, "candidate", "left").withColumn("p", F.explode(_places(percent))).select("candidate", "p", "node", "fingerprints")
    return placed.groupBy("candidate", "p").applyInArrow(_settle(percent), "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 75, groups: int = GROUPS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id), one row each row of `df`.

    `carry` names columns of `df` that are returned too, such as one that tells rows apart that share an id.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sketched = sketches(df, groups, rows, id_column, text_column, carry).checkpoint()
    full = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    reps = classes.drop("keys")
    candidates = connected_components(candidate_links(classes, groups)).withColumnRenamed("component", "candidate")
    groups_of = candidates.join(reps, "node").checkpoint()
    links = settled_links(df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), groups_of, percent)
    linked = connected_components(links).join(groups_of.select("node", "doc_id"), "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = reps.select("node", F.col("doc_id").alias("_rep")).join(linked.join(least, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "_rep").alias("component_id"))
    out = sketched.drop("keys").join(named, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), *carry)
