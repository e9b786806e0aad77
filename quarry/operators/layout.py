"""Tables and lines from words with positions, by sweeps over the gaps between them.

Input `words`: doc_id, page, x0, x1, top, bottom, text (points, from the upper left corner). A page is swept downwards
into lines, a line from left to right into fragments (cells, where a gap is wide), lines of several fragments that
follow each other closely are a table, and the fragments of a table, swept from left to right together, fall into columns.
Each sweep is a running maximum of the ends so far: what begins beyond it begins a new group.

A table of words is shuffled once, by page, into as many parts as its counted words ask for, so that the sort of a part stays in
memory at any size. Tables are found in arrays of some whole pages at a time (`page_tables`); a page is held in one task. Words without
text, place or page take no part; order is that of place, then text, so that words in one place have a defined order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.parse import outside_tables, parse_blocks

PAGE = ["doc_id", "page"]
SPANS = ["x0", "x1", "top", "bottom"]
#: Words of a part on average: some 60 MB in each of the few sorts that a task holds at once.
PART_WORDS = 500_000
#: Words that are swept at once at least, where a part has as many.
SWEPT_WORDS = 50_000


def sweep(df: DataFrame, within: list[str], order: list[str], start: str, end: str, gap: float, name: str) -> DataFrame:
    """Adds `name` (from 1): rows are of one group while they start less than `gap` beyond the furthest end so far."""
    w = Window.partitionBy(*within).orderBy(*order)
    furthest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) - furthest >= gap, F.lit(True)).cast("int")
    peers = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal rows get one number, whichever of them comes first
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(peers)).drop("_new")


def placed(words: DataFrame) -> DataFrame:
    columns = [*PAGE, "x0", "x1", "top", "bottom", "text"]
    return words.select(columns).dropna(subset=columns).filter("trim(text) <> ''")


def dealt(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Placed words, dealt by page. The number of parts is stated, because small shuffled bytes (words compress well) would be joined to few large parts."""
    return placed(words).repartition(max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // part_words)), *PAGE)


def word_lines(words: DataFrame, overlap: float) -> DataFrame:
    """Placed words with `line`; words that overlap the line above by less than `overlap` begin a new one."""
    return sweep(words, PAGE, ["top", "bottom", "x0", "x1", "text"], "top", "bottom", -overlap, "line")


def _joined(order: list[str]) -> Column:
    """The texts of a group in order, with blanks between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: s["text"]), " ")


def find_tables(words: DataFrame, gap: float = 12.0, row_gap: float = 20.0, gutter: float = 1.0, overlap: float = 1.0, least_rows: int = 2, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, page, table_no (from 1, downwards), top, bottom, x0, x1, cells (rows of cells, null where a row has none).

    gap: width that divides cells; row_gap: height that divides tables; gutter: width that is left free between columns. A cell that reaches over
    several columns makes one of them; runs of fewer than `least_rows` rows or of one column are no tables. The result
    is what parse.outside_tables, parse.linearize_tables and parse.parse_blocks take.
    """
    kind = dict(words.dtypes)
    exact = [F.col(c).cast("double").alias(c) if kind[c].startswith("decimal") else F.col(c) for c in SPANS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in whole_pages(batches):
            yield page_tables(pages, gap, row_gap, gutter, overlap, least_rows)

    # the words of a page come one after the other; pages that share a number are swept together
    held = dealt(words, part_words).withColumn("_at", F.xxhash64(*PAGE)).sortWithinPartitions("_at").select("_at", *PAGE, *exact, F.col("text").cast("string").alias("text"))
    spans = ", ".join(f"{c} {dict(held.dtypes)[c]}" for c in ("top", "bottom", "x0", "x1"))
    found = held.mapInArrow(run, f"doc_id {kind['doc_id']}, page {kind['page']}, table_no long, {spans}, cells array<array<string>>")
    return found.withColumns({c: F.col(c).cast(kind[c]) for c in SPANS if kind[c].startswith("decimal")})


def whole_pages(batches: Iterator[pa.RecordBatch], least: int = SWEPT_WORDS) -> Iterator[pa.Table]:
    """Tables of whole pages, of rows ordered by a number of their page, `_at`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if batch.num_rows and sum(b.num_rows for b in held) >= least:
            at = batch.column("_at").to_numpy()
            cut = int(np.searchsorted(at, at[-1]))  # the page of the last word goes on, perhaps
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _equal(a: np.ndarray) -> np.ndarray:
    """Whether a value is that before it; not a number is equal to itself, as in SQL."""
    return (a[1:] == a[:-1]) | ((a[1:] != a[1:]) & (a[:-1] != a[:-1]))


def _ordered(text: pa.Array, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, then text, and whether a row (in that order) is equal to the one before it."""
    order = np.lexsort(keys[::-1])
    tied = np.zeros(len(order), bool)
    tied[1:] = np.logical_and.reduce([_equal(k[order]) for k in keys])
    if tied.any():
        rows = np.flatnonzero(tied | np.append(tied[1:], False))
        coded = text.take(pa.array(order[rows])).dictionary_encode()
        rank = np.empty(len(coded.dictionary), "int64")
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        rank = rank[coded.indices.to_numpy()]
        within = np.lexsort((rank, np.cumsum(~tied)[rows]))
        order[rows], rank = order[rows][within], rank[within]
        tied[rows[1:]] &= rank[1:] == rank[:-1]
    return order, tied


def _swept(within: np.ndarray, start: np.ndarray, end: np.ndarray, gap: float, tied: np.ndarray) -> np.ndarray:
    """`sweep` over ordered rows of rising groups; the numbers rise over all groups, equal rows have one."""
    ends, rank = np.unique(end, return_inverse=True)
    furthest = ends[np.maximum.accumulate(within * len(ends) + rank)[:-1] % len(ends)]
    new = np.ones(len(start), bool)
    new[1:] = (within[1:] != within[:-1]) | ~(start[1:] - furthest < gap)
    last = np.flatnonzero(np.append(~tied[1:], True))
    return np.cumsum(new)[last[np.cumsum(~tied) - 1]]


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a group of equal neighbours begins."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _texts(text: pa.Array, order: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The texts of each group, with blanks between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), text.take(pa.array(order))), " ")


def page_tables(pages: pa.Table, gap: float, row_gap: float, gutter: float, overlap: float, least_rows: int) -> pa.RecordBatch:
    """The tables of whole pages (words in any order), as `find_tables` gives them."""
    words = pages.combine_chunks()
    keys = [words[c].combine_chunks() for c in PAGE]
    codes = [k.dictionary_encode().indices.to_numpy() for k in keys]
    _, some_word, page = np.unique(codes[0].astype("int64") * len(words) + codes[1], return_index=True, return_inverse=True)
    x0, x1, top, bottom = (words[c].combine_chunks().to_numpy() for c in SPANS)
    text = words["text"].combine_chunks().cast(pa.string())
    # words to lines, lines to cells
    order, tied = _ordered(text, page, top, bottom, x0, x1)
    line = np.empty(len(page), "int64")
    line[order] = _swept(page[order], top[order], bottom[order], -overlap, tied)
    order, tied = _ordered(text, line, x0, x1)
    line = line[order]
    begins = _begins(_swept(line, x0[order], x1[order], gap, tied))
    line, place = line[begins], page[order][begins]
    x0, x1 = np.fmin.reduceat(x0[order], begins), np.maximum.reduceat(x1[order], begins)
    top, bottom = np.fmin.reduceat(top[order], begins), np.maximum.reduceat(bottom[order], begins)
    text = _texts(text, order, begins)
    # lines to runs; a line of one cell is in no table
    begins = _begins(line)
    wide, place_of = np.diff(np.append(begins, len(line))) > 1, place[begins]
    tops, bottoms = np.fmin.reduceat(top, begins), np.maximum.reduceat(bottom, begins)
    goes_on = (place_of[1:] == place_of[:-1]) & wide[:-1] & (tops[1:] - bottoms[:-1] < row_gap)
    runs = np.cumsum(np.append(True, ~goes_on))
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(line))))
    cells = np.flatnonzero(wide[of])
    # the cells of a run, from left to right, to columns
    line, x0, x1, text = of[cells], x0[cells], x1[cells], text.take(pa.array(cells))
    order, tied = _ordered(text, runs[line], x0, x1, line)
    line, x0, x1 = line[order], x0[order], x1[order]
    if not len(line):
        return _tables(keys, np.zeros(0, "int64"), np.zeros(0, "int64"), [np.zeros(0, top.dtype)] * 2 + [np.zeros(0, x0.dtype)] * 2, pa.nulls(0, pa.list_(pa.list_(pa.string()))))
    column = _swept(runs[line], x0, x1, gutter, tied)
    begins = _begins(runs[line])
    column = column - np.repeat(np.append(0, np.maximum.reduceat(column, begins)[:-1]), np.diff(np.append(begins, len(line))))
    table_x0, table_x1, width = np.fmin.reduceat(x0, begins), np.maximum.reduceat(x1, begins), np.maximum.reduceat(column, begins)
    # slots: the cells of a line in a column are joined
    again = np.lexsort((column, line))
    slots = _begins(line[again], column[again])
    text, line, column = _texts(text, order[again], slots), line[again][slots], column[again][slots]
    rows = _begins(line)
    row_line = line[rows]
    tables = _begins(runs[row_line])
    n_rows = np.diff(np.append(tables, len(rows)))
    kept = (n_rows >= least_rows) & (width > 1)
    row_kept = np.repeat(kept, n_rows)
    row_width = np.where(row_kept, np.repeat(width, n_rows), 0)
    row_ends = np.append(0, np.cumsum(row_width))
    slot_row = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, len(line))))
    held = np.flatnonzero(row_kept[slot_row])
    source = np.full(row_ends[-1], -1)
    source[row_ends[slot_row[held]] + column[held] - 1] = held
    values = text.take(pa.array(source, mask=source < 0))
    row_lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(row_width[row_kept])), pa.int32()), values)
    cell_lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rows[kept])), pa.int32()), row_lists)
    spans = [np.fmin.reduceat(tops[row_line], tables)[kept], np.maximum.reduceat(bottoms[row_line], tables)[kept], table_x0[kept], table_x1[kept]]
    at = place_of[row_line[tables]][kept]
    first = np.searchsorted(at, at)
    return _tables(keys, some_word[at], np.arange(len(at)) - first + 1, spans, cell_lists)


def _tables(keys: list[pa.Array], words: np.ndarray, table_no: np.ndarray, spans: list[np.ndarray], cells: pa.Array) -> pa.RecordBatch:
    """Rows of tables; `words` are words of their pages."""
    return pa.RecordBatch.from_arrays([*(k.take(pa.array(words)) for k in keys), pa.array(table_no, pa.int64()), *map(pa.array, spans), cells], [*PAGE, "table_no", "top", "bottom", "x0", "x1", "cells"])


def words_to_lines(words: DataFrame, tables: DataFrame | None = None, overlap: float = 1.0, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, page, line_no (from 1 on each page), raw_line of the words that lie in no table."""
    words = dealt(words, part_words)
    rest = words if tables is None else outside_tables(words, tables.select(*PAGE, "top", "bottom"))
    lined = word_lines(rest, overlap)
    return lined.groupBy(*PAGE, F.col("line").alias("line_no")).agg(_joined(["x0", "x1", "text"]).alias("raw_line"))


def parse_words(words: DataFrame, **settings) -> DataFrame:
    """All blocks of documents given as words with positions, tables as sentences (parse.parse_blocks)."""
    tables = find_tables(words, **settings)
    return parse_blocks(words_to_lines(words, tables), tables.select(*PAGE, "table_no", "cells"))
