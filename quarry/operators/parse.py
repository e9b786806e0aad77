"""Documents given as lines become typed blocks, by window functions alone.

Input `lines`: doc_id, page, line_no, raw_line. `tables` (optional): doc_id, page, table_no, cells (rows of cells).
Everything is partitioned by document; order is (page, tables before text, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions.frame import once
from quarry.functions.text import clean_text, joined_cells, strip, tidy_cells

BLOCK_COLUMNS = ["doc_id", "block_no", "kind", "text", "section_no", "section_title", "subsection_no", "subsection_title", "page", "question", "row_subject"]


def classify_lines(lines: DataFrame) -> DataFrame:
    """Non-empty lines with `line` (cleaned), `idx` (order in the document), `class` and `body`.

    class: sub, sec, q, a, bullet or prose; a line is tested in this order. A bullet is told by its raw form, its marker
    is taken off the cleaned one; a line that is nothing but a marker is dropped.
    """
    line = F.col("line")
    sub, sec = F.regexp_extract(line, lx.SUBSECTION, 2), F.regexp_extract(line, lx.SECTION, 2)
    marked = F.col("raw_line").rlike(lx.BULLET)  # white space before the marker is part of the pattern
    body = F.when(line.rlike(lx.BULLET), strip(F.regexp_replace(line, lx.BULLET, ""))).otherwise(line)
    kind = (
        F.when(line.rlike(lx.SUBSECTION) & (F.length(sub) < 80), "sub")
        .when(line.rlike(lx.SECTION) & (F.length(sec) < 80) & ~line.endswith("."), "sec")
        .when(line.rlike(lx.FAQ_QUESTION), "q")
        .when(line.rlike(lx.FAQ_ANSWER), "a")
        .when(marked, "bullet")
        .otherwise("prose")
    )
    cleaned = once(lines, {"line": clean_text(F.col("raw_line"))}).filter(F.col("line") != "")
    placed = once(once(cleaned, {"class": kind}), {"body": F.when(F.col("class").isin("bullet", "prose", "a"), body)}).filter(~F.col("class").isin("bullet", "prose") | (F.col("body") != ""))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    return placed.withColumn("idx", F.row_number().over(order)).select("doc_id", "page", "line_no", "idx", "line", "class", "body", "raw_line")


def fill_sections(classified: DataFrame) -> DataFrame:
    """Adds the section and subsection in force at every line; a section heading clears the subsection."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda c: F.col("class") == c
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(w)
    line = F.col("line")
    sub_on = F.coalesce(F.max(F.when(is_("sub"), F.col("idx"))).over(w), F.lit(0)) > F.coalesce(F.max(F.when(is_("sec"), F.col("idx"))).over(w), F.lit(0))
    return classified.withColumns({
        "section_no": F.coalesce(last(is_("sec"), F.regexp_extract(line, lx.SECTION, 1)), F.lit("")),
        "section_title": F.coalesce(last(is_("sec"), F.regexp_extract(line, lx.SECTION, 2)), F.lit("")),
        "subsection_no": F.when(sub_on, last(is_("sub"), F.regexp_extract(line, lx.SUBSECTION, 1))).otherwise(""),
        "subsection_title": F.when(sub_on, last(is_("sub"), F.regexp_extract(line, lx.SUBSECTION, 2))).otherwise(""),
    })


def pair_questions(filled: DataFrame) -> DataFrame:
    """Adds `question` to answers that have an open question; other answers become prose with their whole line."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.coalesce(F.max(F.when(F.col("class") == c, F.col("idx"))).over(before), F.lit(0))
    asked = F.last(F.when(F.col("class") == "q", F.regexp_extract("line", lx.FAQ_QUESTION, 1)), ignorenulls=True).over(before)
    paired = (F.col("class") == "a") & (at("q") > at("a"))
    return filled.withColumn("question", F.when(paired, asked)).withColumn("class", F.when(paired, "faq").when(F.col("class") == "a", "prose").otherwise(F.col("class")))


def merge_paragraphs(paired: DataFrame) -> DataFrame:
    """Blocks: prose lines that continue a prose line of the same page and section are joined to it by a blank."""
    kept = paired.filter(F.col("class").isin("faq", "bullet", "prose"))
    text = F.when(F.col("class") == "faq", F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), F.regexp_extract("line", lx.FAQ_ANSWER, 1))).otherwise(F.col("body"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    ends = F.lag("text").over(w).rlike(r"[.:?]$(?!\n)")
    goes_on = (F.col("class") == "prose") & (F.lag("class").over(w) == "prose") & (F.lag("page").over(w) == F.col("page")) & (F.lag("section_no").over(w) == F.col("section_no")) & ~ends
    islands = kept.withColumn("text", text).withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    first = lambda c: F.min_by(c, "idx").alias(c)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ")
    return islands.groupBy("doc_id", "block").agg(F.min("idx").alias("idx"), F.min("line_no").alias("line_no"), first("class"), ordered.alias("text"), first("section_no"), first("section_title"), first("subsection_no"), first("subsection_title"), first("page"), first("question"))


def _clean_row(rows: DataFrame, name: str, cells: Column) -> DataFrame:
    """`name`: the cells, cleaned, null as ''. Rows of tidy cells, told by one look at all cells joined, are left as they are."""
    told = rows.withColumn("_joined", joined_cells(cells)).withColumn("_tidy", tidy_cells(F.col("_joined"))).drop("_joined")
    return once(told, {name: F.when(F.col("_tidy"), cells).otherwise(F.transform(cells, lambda c: clean_text(F.coalesce(c, F.lit("")))))}).drop("_tidy")


def linearize_tables(tables: DataFrame) -> DataFrame:
    """One sentence a table row: doc_id, page, table_no, row_no, row_subject, columns, text.

    The first row is the header (it must not be empty); rows without a subject or without further values are dropped.
    """
    t = _clean_row(tables.filter(F.size("cells") >= 2), "columns", F.col("cells")[0]).filter(F.exists("columns", lambda c: c != ""))
    rows = _clean_row(t.select("doc_id", "page", "table_no", "columns", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("row_no", "row")), "row", F.col("row"))
    rows = rows.withColumn("row_subject", F.get("row", F.lit(0))).filter(F.coalesce(F.col("row_subject"), F.lit("")) != "")
    label = F.when(F.col("columns")[0] != "", F.col("columns")[0]).otherwise("Item")
    width = F.least(F.size("columns"), F.size("row")) - 1
    pairs = F.zip_with(F.slice("columns", 2, F.greatest(width, F.lit(0))), F.slice("row", 2, F.greatest(width, F.lit(0))), lambda c, v: F.when((v != "") & (c != ""), F.concat(c, F.lit(": "), v)).when(v != "", v))
    named = once(rows, {"pairs": F.filter(pairs, lambda x: x.isNotNull())}).filter(F.size("pairs") > 0)
    return named.select("doc_id", "page", "table_no", "row_no", "row_subject", "columns", F.concat(F.lit("For "), label, F.lit(" '"), "row_subject", F.lit("' — "), F.array_join("pairs", "; "), F.lit(".")).alias("text"))


def outside_tables(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """Objects (doc_id, page, top, bottom, ...) whose vertical middle lies in no table region (top, bottom) of the page."""
    o, r = objects.alias("o"), regions.alias("r")
    mid = (F.col("o.top") + F.col("o.bottom")) / 2
    return o.join(r, (F.col("o.doc_id") == F.col("r.doc_id")) & (F.col("o.page") == F.col("r.page")) & (mid >= F.col("r.top")) & (mid <= F.col("r.bottom")), "left_anti")


def drop_noise(blocks: DataFrame) -> DataFrame:
    """Without blocks that begin with a fixed disclaimer."""
    noisy = F.lit(False)
    for start in lx.NOISE:
        noisy = noisy | F.col("text").startswith(start)
    return blocks.filter(~noisy)


def parse_blocks(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """All blocks of the documents (BLOCK_COLUMNS), numbered from 1 in page order; tables come first on their page and
    stand under the headings in force when the page began."""
    filled = fill_sections(classify_lines(lines))
    text = merge_paragraphs(pair_questions(filled)).withColumns({"kind": F.col("class"), "row_subject": F.lit(None).cast("string"), "source": F.lit(1), "a": F.col("idx").cast("long"), "b": F.lit(0).cast("long")})
    text = text.withColumn("subsection_no", F.when(F.col("kind") == "faq", "").otherwise(F.col("subsection_no"))).withColumn("subsection_title", F.when(F.col("kind") == "faq", "").otherwise(F.col("subsection_title")))
    own = ["section_no", "section_title", "subsection_no", "subsection_title"]
    blocks = drop_noise(text.select("doc_id", "page", "source", "a", "b", "kind", "text", *own, "question", "row_subject"))
    w = Window.partitionBy("doc_id").orderBy("page", "source", "a", "b")
    if tables is None:
        return blocks.withColumn("block_no", F.row_number().over(w).cast("long")).select(*BLOCK_COLUMNS)
    place = lambda source, a, b: [F.lit(source).alias("source"), F.col(a).cast("long").alias("a"), b.cast("long").alias("b")]
    rows = linearize_tables(tables).select("doc_id", "page", *place(0, "table_no", F.col("row_no")), F.lit("table_row").alias("kind"), "text", "row_subject")
    heads = headings(lines).select("doc_id", "page", *place(2, "idx", F.lit(0)), F.struct(*own).alias("head"))
    # one sort places rows of tables, blocks of text and headings; headings are not counted and go
    both = drop_noise(rows).unionByName(blocks, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    both = both.withColumns({
        "head": F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "block_no": F.sum(F.when(F.col("source") == 2, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }).filter("source <> 2")
    in_force = {c: F.when(F.col("source") == 0, F.coalesce(F.col("head")[c], F.lit(""))).otherwise(F.col(c)) for c in own}
    return both.withColumns(in_force).select(*BLOCK_COLUMNS)


def headings(lines: DataFrame) -> DataFrame:
    """The lines that are headings, with the section and subsection in force from each on; all of them begin with a digit."""
    first = F.ascii("raw_line")  # a digit, or what cleaning may take off before one
    told = once(lines, {"_begins": ((first <= 57) | (first > 127)) & clean_text(F.col("raw_line")).rlike(r"^\d")})  # told above the lines' shuffle, which is read twice
    begun = told.filter("_begins").drop("_begins")
    return fill_sections(classify_lines(begun).filter(F.col("class").isin("sec", "sub")))
