"""Cleaning of cells and the one sort of parsed blocks."""

import re

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import parse
from quarry.plans import knowledge

LINES = "doc_id long, page int, line_no long, raw_line string"
TABLES = "doc_id long, page int, table_no long, cells array<array<string>>"


def test_tidy_tells_what_cleaning_would_change(spark):
    texts = ["plain", "", "a b", " a", "a ", "a  b", "a\tb", "\n", "a\n", "\x0ba", "a b", "“q”", "ﬁt", "é", "a|b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tidy(F.col("t")).alias("tidy"), tx.clean_text(F.col("t")).alias("c")).collect()
    assert all(r.c == r.t for r in rows if r.tidy)
    assert [r.t for r in rows if r.tidy] == ["plain", "", "a b", "a|b"]
    assert [r.c for r in rows] == ["plain", "", "a b", "a", "a", "a b", "a b", "", "a", "a", "a b", '"q"', "fit", "é", "a|b", None]


def test_untidy_cells_are_cleaned_wherever_they_stand(spark):
    cells = [["Name", " Fee\t", None, "A | B", "Late"], ["x", "1  %", "y", "| ", " z"], [None, "no subject"], ["w ", None, " ", "v"]]
    out = parse.linearize_tables(spark.createDataFrame([(1, 1, 1, cells)], TABLES)).orderBy("row_no").collect()
    assert [(r.row_subject, r.text) for r in out] == [("x", "For Name 'x' — Fee: 1 %; y; A | B: |; Late: z."), ("w", "For Name 'w' — A | B: v.")]


def test_headings_that_cleaning_uncovers_stand_over_later_tables(spark):
    lines = [(1, 1, 1, "  3. Costs"), (1, 1, 2, "text"), (1, 1, 3, "3.1\tCards "), (1, 2, 1, "- b"), (2, 1, 1, "x")]
    tables = [(1, p, 1, [["N", "V"], ["a", "b"]]) for p in (1, 2, 3)] + [(3, 1, 1, [["N", "V"], ["a", "b"]])]
    out = parse.parse_blocks(spark.createDataFrame(lines, LINES), spark.createDataFrame(tables, TABLES)).orderBy("doc_id", "block_no").collect()
    assert [(r.doc_id, r.block_no, r.page, r.kind, r.section_no, r.subsection_title) for r in out] == [
        (1, 1, 1, "table_row", "", ""), (1, 2, 1, "prose", "3", ""), (1, 3, 2, "table_row", "3", "Cards"), (1, 4, 2, "bullet", "3", "Cards"), (1, 5, 3, "table_row", "3", "Cards"),
        (2, 1, 1, "prose", "", ""), (3, 1, 1, "table_row", "", ""),
    ]


def test_blocks_are_placed_by_one_sort_and_no_cells_are_shuffled(spark):
    plan = knowledge._blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[doc_id#\d+L? ASC NULLS FIRST, page#\d+ ASC NULLS FIRST, source#", plan)) == 1
    cells = knowledge._tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert cells.index("AS cells") < cells.index("Exchange")  # made above the shuffle
