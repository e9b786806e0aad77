"""Exact removal of long repeated byte strings, by merging shard Burrows-Wheeler transforms.

A byte goes when it is covered by a `LENGTH`-byte string that also starts anywhere else in the corpus, in the same
document included; strings never cross documents and are judged on the input.

1. Anchors. Every window of LENGTH bytes picks the place of its least `GRAM`-byte hash (the rightmost of equals). Equal
   strings pick the same place, so two occurrences of a string meet under the hash of their anchor. An anchor carries
   the starts [lo, hi] of the windows that picked it; its context is the bytes [lo, hi + LENGTH).
2. Contexts that occur twice or more are repeated from end to end. Anchors whose hash occurs once repeat nothing. What
   is left are single contexts of hashes with several different contexts: the edges of repeated passages.
3. These contexts are cut into shards. The alphabet is the hashes of `BLOCK`-byte blocks, and the successor of place p is
   p + BLOCK, so a LENGTH-byte string is LENGTH / BLOCK symbols. Each shard builds its own transform. The transforms
   are merged by refining their interleave: a round takes the symbols of all transforms in the present order and
   sorts them stably, which orders the merged suffixes by one symbol more. The round in which neighbours part gives
   their common prefix; runs that never part within LENGTH / BLOCK rounds are the repeated intervals. No suffix of
   one shard is ever compared with a suffix of another.
4. Hashes with more than `HOT_CONTEXTS` different contexts, whose contexts one task should not hold, count the hashes
   of their LENGTH-byte strings by aggregation instead.

Edge cases: a null text counts as empty; texts below LENGTH bytes lose nothing; texts of any length are taken whole, in
overlapping segments of `SEGMENT` bytes; rows that repeat are occurrences of their own; rows that share an id but not a
text are kept apart by a hash of the text; an empty table gives an empty table; other columns play no part. Blocks and
contexts are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir
from quarry.llm.shingles import mix

LENGTH, GRAM, BLOCK = 400, 100, 100
SEGMENT = 4_000_000
SHARD_BYTES, SHARDS = 400_000, 4
HOT_CONTEXTS = 5_000
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from every place on, by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    out, have, done = None, data.astype("uint64") + np.uint64(1), 0
    width = 1
    while True:
        if size & width:
            if out is None:
                out, done = have, width
            else:
                power = np.uint64(pow(_BASE, width, 1 << 64))
                out = out[: len(data) - done - width + 1] * power + have[done : done + len(data) - done - width + 1]
                done += width
        if width * 2 > size:
            break
        power = np.uint64(pow(_BASE, width, 1 << 64))
        have = have[: len(have) - width] * power + have[width:]
        width *= 2
    return mix(out[:n])


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` values."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo("uint64").max, "uint64")
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, anchor hash, lo, hi) of texts that lie in data[starts:ends]; places count from the start of data."""
    empty = np.zeros(0, "int64")
    long = ends - starts >= length
    if not long.any():
        return empty, empty, empty, empty
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype="uint64")
    least = window_least((h & ~_PLACE) | (_PLACE - place), length - gram + 1)
    at = (_PLACE - (least & _PLACE)).astype("int64")
    change = np.zeros(len(at) + 1, "int32")
    change[starts[long]] += 1
    change[ends[long] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    own = at[p]
    new = np.r_[True, (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1
    lo, hi = p[first], p[last]
    return np.searchsorted(starts, lo, "right") - 1, h[own[first]].view("int64"), lo, hi


def _segments(batch: pa.RecordBatch):
    """Runs of texts as (bytes, starts, ends, row numbers, offsets in the text), each of about SEGMENT bytes."""
    blobs = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    held, rows, offsets, size = [], [], [], 0
    for row, blob in enumerate(blobs):
        for at in range(0, max(1, len(blob) - LENGTH + 1), SEGMENT):
            piece = blob[at : at + SEGMENT + LENGTH - 1]
            if held and size + len(piece) > SEGMENT:
                yield _laid_out(held, rows, offsets)
                held, rows, offsets, size = [], [], [], 0
            held.append(piece)
            rows.append(row)
            offsets.append(at)
            size += len(piece)
    if held:
        yield _laid_out(held, rows, offsets)


def _laid_out(held: list[bytes], rows: list[int], offsets: list[int]):
    ends = np.cumsum([len(x) for x in held])
    return b"".join(held), np.r_[0, ends[:-1]], ends, np.array(rows), np.array(offsets)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        ids, hashes = batch.column("doc_id"), batch.column("th")
        for blob, starts, ends, rows, offsets in _segments(batch):
            doc, key, lo, hi = anchors(np.frombuffer(blob, "uint8"), starts, ends)
            context = np.array([xxhash.xxh3_64_intdigest(blob[a : b + LENGTH]) for a, b in zip(lo.tolist(), hi.tolist())], "uint64").view("int64")
            if len(lo):
                # in periodic text anchor after anchor has the same context: a run becomes one row, marked by ~hi
                new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (lo[1:] != hi[:-1] + 1)]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(lo)] - 1
                doc, key, context, lo, hi, run = doc[first], key[first], context[first], lo[first], hi[last], last > first
            else:
                run = np.zeros(0, bool)
            shift = offsets[doc] - starts[doc]
            lo, hi = lo + shift, hi + shift
            hi = np.where(run, ~hi, hi)
            row = pa.array(rows[doc])
            yield pa.RecordBatch.from_arrays([ids.take(row), hashes.take(row), pa.array(key), pa.array(context), pa.array(lo), pa.array(hi)], ["doc_id", "th", "key", "context", "lo", "hi"])


# ---- transforms ----


def chain_symbols(blobs: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """All places of the contexts that begin a whole block: their symbols (hashes), and places in the joined contexts."""
    data = np.frombuffer(b"".join(blobs), "uint8")
    sizes = np.array([len(b) for b in blobs])
    h = gram_hashes(data, block)
    ok = np.zeros(len(data) + 1, "int32")
    ends = np.cumsum(sizes)
    ok[ends - sizes] += 1
    ok[ends - block + 1] -= 1
    places = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    return h[places], places


def shard_transform(symbols: np.ndarray, places: np.ndarray, rounds: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The transform of one shard: for each suffix in sorted order the symbol before it (-1: none), and its place.

    Suffixes are chains p, p + block, ...; the empty suffix behind every chain is a row too (place of the chain's last
    symbol plus block). They are sorted by their first `rounds` symbols, by doubling.
    """
    top = int(places[-1]) + block + 1 if len(places) else 0
    symbol_at = np.full(top + block, -1, "int64")
    symbol_at[places] = symbols
    tails = places[symbol_at[places + block] < 0] + block  # where chains end
    # a tail may share its place with the start of the next context's chain: rows are (place, is a tail)
    where = np.r_[places, tails]
    rank_of = np.full(top + block, 0, "int64")  # 0: nothing follows
    rank_of[places] = symbols + 1
    is_tail = np.r_[np.zeros(len(places), bool), np.ones(len(tails), bool)]
    follows = symbol_at[places + block] >= 0
    ranks, have = symbols + 1, 1
    # the successor of a place only counts within its own chain
    succ = np.where(follows, np.searchsorted(places, places + block), -1)
    step = succ.copy()
    while have < rounds:
        second = np.where(step >= 0, ranks[step], 0)
        _, ranks = np.unique(ranks * (ranks.max(initial=0) + 1) + second, return_inverse=True)
        ranks = ranks + 1
        step = np.where(step >= 0, step[step], -1)
        have *= 2
    order = np.argsort(np.r_[ranks, np.zeros(len(tails), "int64")], kind="stable")
    before = np.full(len(where), -1, "int64")
    before[: len(places)][succ[follows]] = symbols[follows]
    before[len(places) :] = symbol_at[tails - block]
    return before[order], np.where(is_tail, -1, where)[order]


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge by iterative interleave refinement.

    Returns the places in merged order (shard by shard they are those of `shards`; -1 for the empty suffix) and the
    common prefix of each row with the row before, in symbols and at most `rounds`.
    """
    owner = np.repeat(np.arange(len(shards), dtype="int32"), [len(b) for b, _ in shards])  # the interleave
    symbols = np.concatenate([b for b, _ in shards])
    starts = np.cumsum([0, *(len(b) for b, _ in shards)])
    n = len(owner)
    ends = int((symbols < 0).sum())  # rows before which a chain begins; as many chains, as many empty suffixes
    block = np.zeros(n, "int64")  # rows of one block agree on all symbols so far
    common = np.full(n, rounds, "int64")
    common[:1] = 0

    def rows_of(owner: np.ndarray) -> np.ndarray:
        """For each merged row, the row of its shard (joined numbering): shards keep their own order."""
        by_shard = np.argsort(owner, kind="stable")
        out = np.empty(n, "int64")
        out[by_shard] = np.arange(n)
        return out

    for done in range(rounds):
        seen = symbols[rows_of(owner)]
        order = np.argsort(seen, kind="stable")[ends:]  # symbols before suffixes; chains' beginnings lead nowhere
        # merged rows of the next round: the empty suffixes of all shards first, then one row for each symbol seen
        next_owner = np.concatenate([np.repeat(np.arange(len(shards), dtype="int32"), [int((p < 0).sum()) for _, p in shards]), owner[order]])
        parts = np.zeros(n, bool)
        parts[:1] = True
        s, b = seen[order], block[order]
        if len(s):
            parts[ends] = True
            parts[ends + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        new = parts & (common == rounds)
        common[new] = done
        owner, block = next_owner, np.cumsum(parts)
        if parts.all():
            break
    places = np.concatenate([p for _, p in shards])
    return places[rows_of(owner)], common


def repeated_starts(blobs: list[bytes], length: int = LENGTH, block: int = BLOCK, shards: int = SHARDS) -> list[np.ndarray]:
    """For each context, the places where a `length`-byte string starts that starts at another place of the contexts too."""
    rounds = length // block
    sizes = np.array([len(b) for b in blobs])
    ends = np.cumsum(sizes)
    symbols, places = chain_symbols(blobs, block)
    _, dense, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    # a string with a block that occurs once is not repeated: only runs of `rounds` other blocks are kept
    good = np.zeros(ends[-1] + length, bool)
    good[places[counts[dense] > 1]] = True
    runs = good[: ends[-1]].copy()
    for k in range(1, rounds):
        runs &= good[k * block : k * block + ends[-1]]
    late = np.zeros(ends[-1] + 1, "int32")  # places too near the end of their context
    late[np.maximum(ends - length + 1, ends - sizes)] += 1
    late[ends] -= 1
    runs &= np.cumsum(late[:-1]) == 0
    kept = runs.copy()
    for k in range(1, rounds):
        kept[k * block :] |= runs[: ends[-1] - k * block]
    some = kept[places]
    dense, places = dense[some], places[some]
    cut = np.searchsorted(ends, np.linspace(0, ends[-1], shards + 1)[1:-1])
    edges = np.unique(np.r_[0, ends[cut] if len(cut) else [], ends[-1]]).astype("int64")
    built = []
    for a, b in zip(edges, edges[1:]):
        i, j = np.searchsorted(places, [a, b])
        if i < j:
            built.append(_own_chains(dense[i:j], places[i:j], ends, rounds, block))
    if not built:
        return [np.zeros(0, "int64") for _ in blobs]
    at, common = merge_transforms(built, rounds)
    equal = common >= rounds
    twice = equal | np.r_[equal[1:], False]
    found = np.sort(at[twice & (at >= 0)])
    found = found[runs[found]]  # shorter suffixes may agree up to their ends
    which = np.searchsorted(ends, found, "right")
    cuts = np.searchsorted(which, np.arange(len(blobs) + 1))
    return [found[cuts[k] : cuts[k + 1]] - (ends[k] - sizes[k]) for k in range(len(blobs))]


def _own_chains(symbols: np.ndarray, places: np.ndarray, ends: np.ndarray, rounds: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """shard_transform on places spread out so that chains of different contexts cannot touch."""
    spread = np.searchsorted(ends, places, "right") * block
    before, at = shard_transform(symbols, places + spread, rounds, block)
    back = np.full(int((places + spread).max()) + 1, -1, "int64")
    back[places + spread] = places
    return before, np.where(at >= 0, back[np.maximum(at, 0)], -1)


def _cover(lo: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Intervals of bytes covered by the strings at `starts`, counted from lo."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip((starts[np.r_[0, cut + 1]] + lo).tolist(), (starts[np.r_[cut, len(starts) - 1]] + lo + LENGTH).tolist()))


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for doc, th, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "spans"))):
            blob = (text or "").encode()
            for s in spans:
                for column, value in zip(columns, (doc, th, s["key"], s["lo"], s["hot"], blob[s["lo"] : s["hi"] + LENGTH])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["doc_id", "th", "key", "lo", "hot", "bytes"])


def _settle_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are gathered up to SHARDS * SHARD_BYTES, then merged."""
    np.seterr(over="ignore")
    held: list[tuple] = []
    size = 0
    kind = None

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for (doc, th, _, lo, _), starts in zip(rows, repeated_starts([r[4] for r in rows])):
            for a, b in _cover(lo, starts):
                for column, value in zip(out, (doc, th, a, b)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "th", "a", "b"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "key", "lo", "bytes"))):
            if size >= SHARDS * SHARD_BYTES and held[-1][2] != row[2]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield flush(held)


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        for k, (lo, blob) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("bytes").to_pylist())):
            h = gram_hashes(np.frombuffer(blob, "uint8"), LENGTH).view("int64")
            row = pa.array(np.full(len(h), k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(h), pa.array(np.arange(lo, lo + len(h)))], ["doc_id", "th", "h", "p"])


def _remove(want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                blob = (text or "").encode()
                merged: list[list[int]] = []
                for s in sorted((x["a"], x["b"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(blob[at:a])
                    at = b
                left = b"".join([*kept, blob[at:]]) if merged else blob
                for column, value in zip(columns, (len(blob), len(blob) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left if want_text else None)):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            count = 5 if want_text else 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[:count]], ["doc_id", *names[:count]])

    return run


def repeated_spans(rows: DataFrame) -> DataFrame:
    """doc_id, th, a, b: byte intervals that repeated strings cover (they may overlap); rows: doc_id, th, text."""
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(_find_anchors, f"doc_id {kind}, th int, key long, context long, lo long, hi long").checkpoint()
    end = F.when(F.col("hi") < 0, -F.col("hi") - 1).otherwise(F.col("hi"))
    one = F.struct("doc_id", "th", "lo", F.least(end, F.col("lo") + LENGTH - GRAM).alias("hi"))  # the windows of one anchor
    classes = found.groupBy("key", "context").agg(F.sum(F.when(F.col("hi") < 0, 2).otherwise(1)).alias("n"), F.min(one).alias("rep"))
    whole = found.join(classes.filter("n > 1").select("key", "context"), ["key", "context"], "left_semi").select("doc_id", "th", F.col("lo").alias("a"), (end + LENGTH).alias("b"))
    keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).filter("c > 1 AND least = 1").select("key", (F.col("c") > HOT_CONTEXTS).alias("hot"))
    todo = classes.join(keys, "key").select("rep.*", "key", "hot").checkpoint()
    by_doc = todo.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "lo", "hi", "hot")).alias("spans"))  # at most the anchors of a text
    texts = rows.join(by_doc.withColumnsRenamed({"doc_id": "_d", "th": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "th", "text", "spans")
    contexts = texts.mapInArrow(_cut_contexts, f"doc_id {kind}, th int, key long, lo long, hot boolean, bytes binary")
    apart = contexts.filter("NOT hot").drop("hot").repartition("key").dropDuplicates(["key", "doc_id", "th", "lo"])
    out = whole.unionByName(apart.sortWithinPartitions("key", "doc_id", "th", "lo").mapInArrow(_settle_contexts, f"doc_id {kind}, th int, a long, b long"))
    if todo.filter("hot").isEmpty():
        return out
    strings = contexts.filter("hot").dropDuplicates(["key", "doc_id", "th", "lo"]).mapInArrow(_string_hashes, f"doc_id {kind}, th int, h long, p long")
    again = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return out.unionByName(strings.join(again, "h", "left_semi").select("doc_id", "th", F.col("p").alias("a"), (F.col("p") + LENGTH).alias("b")))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", want_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, if wanted, the `kept` bytes), one row each row of `df`."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.hash(text_column).alias("th"))
    kind = dict(rows.dtypes)["doc_id"]
    spans = repeated_spans(rows).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove(want_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * want_text)

