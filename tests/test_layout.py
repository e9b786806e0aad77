"""Tables planted among words are found, and what lies around them is left as lines."""

import random

import duckdb
import pyarrow as pa

from quarry.operators.layout import find_tables, parse_words, whole_pages, words_to_lines

SCHEMA = "doc_id long, page int, x0 double, x1 double, top double, bottom double, text string"
PROSE = ["Everything", "about", "fees", "stands", "below:"]


def spoken(doc, page, y, x, text):
    """The words of a text, with narrow gaps."""
    out = []
    for word in text.split():
        out.append((doc, page, float(x), x + 5.0 * len(word), float(y), y + 9.0, word))
        x += 5 * len(word) + 4
    return out


def page_of(rng, doc, page):
    """Words of a page and its tables, as rows of cells."""
    words, tables, y = spoken(doc, page, 10, 40, " ".join(PROSE)), [], 40
    for _ in range(rng.randint(0, 3)):
        width = rng.randint(2, 5)
        rows = [[f"head {c}" for c in range(width)]]
        rows += [[f"r{r}" if c == 0 else (f"v{r} {c}" if rng.random() < 0.8 else None) for c in range(width)] for r in range(rng.randint(2, 6))]
        for row in rows:
            if sum(x is not None for x in row) < 2:
                row[1] = "x"
            for c, text in enumerate(row):
                words += spoken(doc, page, y + rng.random(), 40 + 90 * c + rng.randint(0, 6), text or "")
            y += 13
        tables.append(rows)
        words += spoken(doc, page, y + 20, 40, "A line between tables")
        y += 60
    return words, tables


def test_planted_tables(spark):
    rng = random.Random(4)
    words, want = [], {}
    for doc in range(12):
        for page in (1, 2):
            more, tables = page_of(rng, doc, page)
            words += more
            want |= {(doc, page, k): t for k, t in enumerate(tables, 1)}
    rng.shuffle(words)
    df = spark.createDataFrame(words, SCHEMA)
    found = find_tables(df)
    assert {(r["doc_id"], r["page"], r["table_no"]): r["cells"] for r in found.collect()} == want
    lines = words_to_lines(df, found).collect()
    assert {r["raw_line"] for r in lines} == {" ".join(PROSE), "A line between tables"}
    assert len(lines) == 24 + len(want)
    plan = find_tables(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_blocks_of_words(spark):
    rows = [["Plan", "Fee"], ["Basic", "$5"], ["Plus", "$9"]]
    words = spoken(1, 1, 10, 40, "1. Fees and Limits") + spoken(1, 1, 25, 40, "All fees are listed.")
    for k, row in enumerate(rows):
        for c, text in enumerate(row):
            words += spoken(1, 1, 60 + 13 * k, 40 + 90 * c, text)
    got = parse_words(spark.createDataFrame(words, SCHEMA)).orderBy("block_no").select("kind", "text").collect()
    assert [tuple(r) for r in got] == [("table_row", "For Plan 'Basic' — Fee: $5."), ("table_row", "For Plan 'Plus' — Fee: $9."), ("prose", "All fees are listed.")]


def test_odd_words(spark):
    pair = spoken(1, 1, 10, 40, "a") + spoken(1, 1, 10, 200, "b")
    odd = [(1, 1, None, 5.0, 10.0, 19.0, "x"), (1, 1, 300.0, 310.0, 10.0, 19.0, None), (1, 1, 300.0, 310.0, 10.0, 19.0, "  ")]
    assert find_tables(spark.createDataFrame(pair + odd, SCHEMA)).count() == 0  # one row is no table
    again = pair + pair + spoken(1, 1, 23, 40, "c") + spoken(1, 1, 23, 200, "d") + odd  # words that repeat
    assert find_tables(spark.createDataFrame(again, SCHEMA)).first()["cells"] == [["a a", "b b"], ["c", "d"]]
    over = pair + spoken(1, 1, 23, 40, "title") + [(1, 1, 60.0, 260.0, 36.0, 45.0, "over"), (1, 1, 300.0, 320.0, 36.0, 45.0, "e")]
    assert find_tables(spark.createDataFrame(over, SCHEMA)).count() == 0
    assert find_tables(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_are_swept_as_in_sql_without_windows(spark):
    """F2: a chain of windows and groups took 20 microseconds a word; words that tie, overlap and reach over others."""
    from quarry.plans import kb
    from quarry.plans.knowledge import LAYOUT

    rng = random.Random(9)
    words = []
    for doc in range(300):
        for page in range(rng.randint(1, 3)):
            for y in range(0, rng.choice([14, 40, 70, 120]), 14):
                for x in rng.choices([0, 1, 60, 60, 61, 130.5, 200], k=rng.randint(1, 6)):
                    top = y + rng.choice([0, 0, 0.25, 3]) + rng.choice([0, 0, 0, 9])
                    words.append((doc, page, float(x), x + rng.choice([0.0, 4.0, 15.0, 50.0, 90.0]), float(top), top + rng.choice([0.5, 9.0, 12.0]), rng.choice(["a", "B", "\u00e9", "z z", " ", ""])))
    con = duckdb.connect()
    con.execute("CREATE TABLE given (doc_id BIGINT, page INT, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?, ?, ?)", words)
    sql = LAYOUT.replace(kb.duck(kb.KB_WORDS), "SELECT * FROM given")
    want = con.execute(f"WITH {sql} SELECT doc_id, page, table_no, top, bottom, list(cells ORDER BY row_no) FROM grid GROUP BY ALL").fetchall()
    found = find_tables(spark.createDataFrame(words, SCHEMA), part_words=500)
    got = [(r.doc_id, r.page, r.table_no, r.top, r.bottom, r.cells) for r in found.collect()]
    assert len(want) > 50 and sorted(map(repr, got)) == sorted(map(repr, want))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_are_not_divided_between_batches():
    rng = random.Random(2)
    rows = [(page, k) for page in range(40) for k in range(rng.choice([1, 5, 60]))]
    batches, at = [], 0
    while at < len(rows):
        some = rows[at : at + rng.randint(1, 17)]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], ["_at", "k"]))
        at += len(some)
    parts = [[(r["_at"], r["k"]) for r in t.to_pylist()] for t in whole_pages(iter(batches), 25)]
    assert [r for p in parts for r in p] == rows and len(parts) > 5
    assert sum(len({at for at, _ in p}) for p in parts) == 40
