"""Benchmark decontamination by a distributed positional inverted index.

1. `build_index`: every task turns its documents, a few megabytes at a time, into index segments: a sorted dictionary of
   the words, the number of postings of each, and all postings (positions) in order of words. No posting is left out and
   none is shuffled, so a frequent word is spread over all segments. The segments are written as a table, which cuts the
   lineage and serves any number of test sets.
2. `find_matches`: test texts are cut into windows of `width` words. In each segment a window that has a word unknown
   there is done. For the others the postings of the word rarest in the segment, less its offset, are the candidate
   starts; the lists of the other words follow from rare to frequent, each adjusted by its offset, and keep the starts that
   they hold. What is left are the exact phrase matches.
3. Proximity matches (`slack`): all different words of a window lie within its length plus `slack` words of a document,
   in any order. The rarest word gives the places to look at; the other lists are probed around them.

The test texts are a stated query set: they go to the executors in blocks of about `BLOCK_BYTES`; matches of
several blocks are put together by document. Positions of two documents are `GAP` apart, so no match crosses documents.

Edge cases: a null or empty text has no words, is never hit and has no windows; a text of fewer words than `width` is one
window; a null item id is written ''; items are counted by id, so repeated test rows count once; a null or repeated document id
is a row of its own with its own result; other columns are not read, whatever their names; empty tables give empty or
unhit results; a very long text makes a segment of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._arrow import frugal, slices, table
from quarry.llm.packed import pack, unpack, word_bytes
from quarry.sources.folders import scratch

WIDTH = 10
#: Positions left free between two documents of a segment; `width + slack` must not exceed it.
GAP = 64
#: Text of a segment, and of a block of test texts, in bytes; a single longer text is one of its own.
SEGMENT_BYTES = 4_000_000
BLOCK_BYTES = 4_000_000
#: Candidate starts that are looked at together.
CANDIDATES = 1_000_000


def _segment(ids: pa.Array, texts: list[bytes | None]) -> list:
    """ids, n_words, terms, counts, postings of a run of documents."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes, numbers = [], []
    for text in texts:
        words = word_bytes(text)
        sizes.append(len(words))
        numbers.append(np.fromiter(map(number.__getitem__, words), "uint32", len(words)))
    found = np.concatenate(numbers)
    terms = sorted(number)
    rank = np.empty(len(terms), "uint32")
    rank[[number[t] for t in terms]] = np.arange(len(terms), dtype="uint32")
    found = rank[found] if len(terms) else found
    order = np.argsort(found.astype("uint16") if len(terms) <= 65_536 else found, kind="stable")
    places = np.arange(len(found)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
    return [ids.to_pylist(), sizes, b" ".join(terms), pack(np.bincount(found, minlength=len(terms))), pack(places[order])]


def index_segments(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Segments of the index: ids, n_words (of each document), terms, counts, postings."""
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SEGMENT_BYTES):
                row = _segment(part.column("_id"), part.column("_text").to_pylist())
                types = [pa.list_(part.schema.field("_id").type), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["ids", "n_words", "terms", "counts", "postings"])

    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).cast("binary").alias("_text"))
    return rows.mapInArrow(frugal(run), f"ids array<{kind}>, n_words array<long>, terms binary, counts binary, postings binary")


def build_index(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the index of all texts to `path` and return it; `segment` numbers the segments."""
    segments = index_segments(df, id_column, text_column).withColumn("segment", F.monotonically_increasing_id())
    segments.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Windows:
    """The windows of a block of test texts, over the block's own numbering of words."""

    def __init__(self, tests: list[tuple[str, bytes]], width: int):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        rows, owners = [np.zeros((0, width), "int32")], [np.zeros(0, "int64")]
        for at, (_, text) in enumerate(tests):
            words = np.fromiter(map(number.__getitem__, word_bytes(text)), "int32")
            if len(words) >= width:
                rows.append(np.lib.stride_tricks.sliding_window_view(words, width))
            elif len(words):
                rows.append(np.pad(words, (0, width - len(words)), constant_values=-1)[None])
            else:
                continue
            owners.append(np.full(len(rows[-1]), at))
        self.items = [item for item, _ in tests]
        self.words = list(number)
        self.rows, self.owners = np.concatenate(rows), np.concatenate(owners)
        self.sizes = (self.rows >= 0).sum(axis=1)


class Segment:
    """Postings of a segment under keys (word, position), by which offset-adjusted lists are intersected."""

    def __init__(self, terms: bytes, counts: bytes, postings: bytes, n_words: list[int]):
        names = terms.split(b" ") if terms else []
        self.at = {t: i for i, t in enumerate(names)}
        self.counts = np.append(unpack(counts).astype("int64"), 0)  # the last stands for unknown words
        self.first = np.cumsum(self.counts) - self.counts
        self.places = unpack(postings).astype("int64")
        self.keys = (np.repeat(np.arange(len(self.counts)), self.counts) << 32) | self.places
        sizes = np.asarray(n_words, "int64")
        self.starts = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * GAP
        self.sizes = sizes

    def candidates(self, windows: Windows, distinct: bool) -> Iterator[tuple]:
        """Numbers of windows whose words all occur, with their words from rare to frequent (-1: none), the offsets of
        these, and the window (by place in those numbers) and position of every posting of the rarest."""
        local = np.array([self.at.get(w, len(self.counts) - 1) for w in windows.words] + [-1])
        rows = local[windows.rows]
        count = np.where(rows >= 0, self.counts[rows], np.iinfo("int64").max)
        alive = np.flatnonzero(count.min(axis=1, initial=np.iinfo("int64").max) > 0)
        alive = alive[windows.sizes[alive] > 0]
        ends = np.cumsum(count[alive].min(axis=1, initial=np.iinfo("int64").max))
        for part in np.split(alive, np.flatnonzero(np.diff(ends // CANDIDATES)) + 1) if len(alive) else []:
            words, count_of = rows[part], count[part]
            if distinct:  # a word that recurs in its window is looked for once
                by_word = np.argsort(words, axis=1, kind="stable")
                ordered = np.take_along_axis(words, by_word, 1)
                again = np.zeros_like(words, bool)
                np.put_along_axis(again, by_word[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
                words = np.where(again, -1, words)
                count_of = np.where(again, np.iinfo("int64").max, count_of)
            order = np.argsort(count_of, axis=1, kind="stable")
            words = np.take_along_axis(words, order, 1)
            amount = self.counts[words[:, 0]]
            window = np.repeat(np.arange(len(part)), amount)
            nth = np.arange(len(window)) - np.repeat(np.cumsum(amount) - amount, amount)
            yield part, words, order, window, self.places[self.first[words[window, 0]] + nth]

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
        for part, words, offsets, window, place in self.candidates(windows, distinct=False):
            start = place - offsets[window, 0]
            window, start = window[start >= 0], start[start >= 0]
            for k in range(1, words.shape[1]):
                word = words[window, k]
                want = (word << 32) | (start + offsets[window, k])
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                kept = (word < 0) | (self.keys[at] == want)
                window, start = window[kept], start[kept]
            out.append((part[window], start))
        return np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])

    def _next(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first posting of each word at or after each place."""
        at = np.searchsorted(self.keys, (word << 32) | np.maximum(place, 0))
        safe = np.minimum(at, len(self.keys) - 1)
        return np.where((at < len(self.keys)) & (self.keys[safe] >> 32 == word), self.keys[safe] & 0xFFFFFFFF, np.iinfo("int64").max)

    def near(self, windows: Windows, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its rarest word) wherever all words of a window lie within its length plus slack."""
        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
        for part, words, _, window, place in self.candidates(windows, distinct=True):
            span = windows.sizes[part] + slack
            for k in range(1, words.shape[1]):  # each word somewhere around the rarest
                word = words[window, k]
                kept = (word < 0) | (self._next(word, place - span[window] + 1) < place + span[window])
                window, place = window[kept], place[kept]
            met = np.zeros(len(window), bool)
            for back in range(int(span.max(initial=0))):  # all words in one stretch that holds the rarest
                open_ = np.flatnonzero(~met & (back < span[window]))
                start, fits = place[open_] - back, np.ones(len(open_), bool)
                for k in range(1, words.shape[1]):
                    word = words[window[open_], k]
                    fits &= (word < 0) | (self._next(word, start) < start + span[window[open_]])
                met[open_[fits]] = True
            out.append((part[window[met]], place[met]))
        return np.concatenate([w for w, _ in out]), np.concatenate([p for _, p in out])

    def documents_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def _names(segment: Segment, windows: Windows, found: np.ndarray, place: np.ndarray) -> dict[int, list[str]]:
    """Items found in each document, each once."""
    doc, owner = segment.documents_of(place), windows.owners[found]
    out: dict[int, set[str]] = defaultdict(set)
    for pair in np.unique((doc << 32) | owner).tolist():
        out[pair >> 32].add(windows.items[pair & 0xFFFFFFFF])
    return {d: sorted(items) for d, items in out.items()}


def _runs(segment: Segment, windows: Windows, found: np.ndarray, start: np.ndarray) -> dict[int, list[dict]]:
    """Hit words of each document as runs (first, after), numbered from 0."""
    if not len(found):
        return {}
    size = int(segment.starts[-1] + segment.sizes[-1]) + 1
    cover = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(start + windows.sizes[found], minlength=size + 1)) > 0
    edges = np.flatnonzero(np.diff(cover, prepend=False)).reshape(-1, 2)
    docs = segment.documents_of(edges[:, 0])
    out: dict[int, list[dict]] = defaultdict(list)
    for doc, (a, b) in zip(docs.tolist(), (edges - segment.starts[docs][:, None]).tolist()):
        out[doc].append({"first": a, "after": b})
    return out


MATCHES = "segment long, row int, id {kind}, n_words long, runs array<struct<first:long,after:long>>, items array<string>, near array<string>"


def _probe(index: DataFrame, tests: list[tuple[str, bytes]], width: int, slack: int | None, everything: bool) -> DataFrame:
    """Matches of one block of test texts; with `everything` also the documents without any."""
    sent = index.sparkSession.sparkContext.broadcast(tests)  # of about BLOCK_BYTES
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, width)
        runs_type = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
        for batch in batches:
            ids_type = batch.schema.field("ids").type.value_type
            for at in range(batch.num_rows):  # a segment at a time
                (row,) = batch.slice(at, 1).to_pylist()
                segment = Segment(row["terms"], row["counts"], row["postings"], row["n_words"])
                found, start = segment.phrases(windows)
                items, runs = _names(segment, windows, found, start), _runs(segment, windows, found, start)
                near = {} if slack is None else _names(segment, windows, *segment.near(windows, slack))
                docs = range(len(row["ids"])) if everything else sorted(items.keys() | near.keys())
                columns = [
                    pa.array([row["segment"]] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array([row["ids"][d] for d in docs], ids_type), pa.array([row["n_words"][d] for d in docs], pa.int64()),
                    pa.array([runs.get(d, []) for d in docs], runs_type), pa.array([items.get(d, []) for d in docs], pa.list_(pa.string())), pa.array([near.get(d, []) for d in docs], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "row", "id", "n_words", "runs", "items", "near"])

    return index.select("segment", "ids", "n_words", "terms", "counts", "postings").mapInArrow(frugal(run), MATCHES.format(kind=kind))


def find_matches(index: DataFrame, tests: DataFrame, item_column: str = "item_id", text_column: str = "text", width: int = WIDTH, slack: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, runs (hit words as first, after), n_hit, items (with an exact match), near (with a proximity match) of every document.

    `near` stays empty unless `slack` is given.
    """
    if width < 1 or width + (slack or 0) > GAP:
        raise ValueError(f"width + slack must lie between 1 and {GAP}")
    named = tests.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text")).distinct()
    size = named.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for k in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        found.append(_probe(index, [(r.item, bytes(r.text)) for r in rows], width, slack, everything=k == 0))
    out = found[0]
    if blocks > 1:
        for more in found[1:]:
            out = out.union(more)
        whole = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  of a document: at most as many as blocks
        out = out.groupBy("segment", "row").agg(F.any_value("id").alias("id"), F.any_value("n_words").alias("n_words"), whole("runs"), whole("items"), whole("near"))
        out = out.withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("items", "near")})
    hit = F.aggregate(F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, r: F.struct((a["n"] + F.greatest(r["after"] - F.greatest(r["first"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], r["after"]).alias("end")), lambda a: a["n"])
    return out.select("id", "n_words", "runs", hit.alias("n_hit"), "items", "near")


def contamination(docs: DataFrame, tests: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, **options) -> DataFrame:
    """`find_matches` over an index made for the occasion, in the shared folder or at `path`."""
    spark: SparkSession = docs.sparkSession
    return find_matches(build_index(docs, path or scratch(spark, "positions"), id_column, text_column), tests, **options)


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Words of a text in DuckDB.
WORDS_SQL = r"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({WORDS_SQL.format(x='text')}, []) AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS_SQL.format(x='text')} AS w FROM benchmark),
windows AS (SELECT item, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS size FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN sizes)),
found AS (SELECT rid, i, r.size, item FROM runs r JOIN (SELECT DISTINCT * FROM windows) v USING (phrase)),
hits AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)"""
