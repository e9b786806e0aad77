"""A knowledge base derived from the relational tables, in SQL that Spark and DuckDB both run.

Raw documents hold none of the patterns that the parser and the facets look for; these statements build lines, tables
and phrases that do, for every row of their tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MONEY = "'$' || CAST(CAST(floor(abs({x})) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(floor(abs({x}) * 100) AS BIGINT) % 100 AS STRING), 2, '0')"

#: doc_id, page, line_no, raw_line: one document a customer.
KB_LINES = f"""
SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(1 AS INT) AS page, CAST(1 AS BIGINT) AS line_no, CAST(c_nationkey % 20 + 1 AS STRING) || '. ' || c_mktsegment || ' Accounts' AS raw_line FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 2, '  The balance of ' || c_name || '  is ' || {MONEY.format(x='c_acctbal')} FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 3, 'and the rate is ' || CAST(c_custkey % 9 AS STRING) || '.5 % for Tier ' || CAST(c_custkey % 4 AS STRING) || ' within 3-5 Business Days.' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 4, CASE WHEN c_custkey % 3 = 0 THEN 'It’s fine! ' ELSE 'See “terms” – page 2' END FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 5, CASE WHEN c_custkey % 5 = 0 THEN '   ' ELSE 'More text follows here: next' END FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 6, 'Q: What is the limit of ' || c_name || '?' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 7, CASE WHEN c_custkey % 2 = 0 THEN 'Q: Which fee does segment ' || c_mktsegment || ' pay?' ELSE 'A note between the two' END FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 8, 'A: The limit is ' || {MONEY.format(x='c_acctbal')} || ' in 24 hours' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 9, 'A: This answer has no question of its own, tier 2 applies' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 1, 10, CAST(c_nationkey % 20 + 1 AS STRING) || '.' || CAST(c_custkey % 12 + 1 AS STRING) || ' Orders of the year' FROM customer
UNION ALL SELECT CAST(o_custkey AS BIGINT), 1, 100 + CAST(o_orderkey AS BIGINT), CASE WHEN o_orderkey % 7 = 0 THEN '– ' ELSE '- ' END || 'Order ' || CAST(o_orderkey AS STRING) || ' costs ' || {MONEY.format(x='o_totalprice')} || ' and ships in ' || CAST(o_orderkey % 30 AS STRING) || ' days with priority ' || o_orderpriority FROM orders
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, 1, '2.50 per withdrawal from machines of others' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, 2, CAST(c_custkey % 40 AS STRING) || '. Ends with a dot.' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, 3, 'Note: this knowledge base intentionally omits ' || c_name FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, 4, CAST(c_nationkey % 20 + 2 AS STRING) || '. Fees and Limits' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, 5, 'Transfers cost ' || CAST(c_custkey % 7 AS STRING) || '% of the amount. They take 2 days! Is that all? No. Tier  3 pays $5 less' FROM customer
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, 6, '-' FROM customer
"""

#: doc_id, page, table_no, cells: one table a supplier's nation and page, rows from lineitem.
KB_TABLES = f"""
SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(1 AS INT) AS page, CAST(l_linenumber AS BIGINT) * 1000000000000000 + CAST(l_partkey AS BIGINT) % 1000000 * 1000000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000000000 AS table_no,
    array(array(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Order' END, 'Price', CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'Discount' END, 'Delivery'),
          array('Line ' || CAST(l_linenumber AS STRING), {MONEY.format(x='l_extendedprice')}, CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS STRING) || '%', CAST(l_linenumber % 5 AS STRING) || ' business days'),
          array('', 'no subject', 'x', 'y'), array('Short ' || l_returnflag, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'flag  ' || l_returnflag END)) AS cells
FROM lineitem
"""

#: doc_id, page, x0, x1, top, bottom, text: words of a page an order, its lines as one table or two (a wide gap after line 4).
KB_WORDS = f"""
SELECT doc_id, CAST(1 AS INT) AS page, CAST(x AS DOUBLE) AS x0, CAST(x + 6 * length(text) AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS top, CAST(y + 10 AS DOUBLE) AS bottom, text FROM (
SELECT CAST(o_orderkey AS BIGINT) AS doc_id, 50 AS x, 20 AS y, 'Order' AS text FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 84, 20, CAST(o_orderkey AS STRING) FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 50, 48, 'Priority' FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 102, 48, o_orderpriority FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 50, 100, 'Line' FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 150, 100, 'Price' FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 260, 100, 'Discount' FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT), 330, 100, 'Flag' FROM orders
UNION ALL SELECT CAST(l_orderkey AS BIGINT), 50, 100 + 14 * l_linenumber + CASE WHEN l_linenumber > 4 THEN 60 ELSE 0 END, 'Line' FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS BIGINT), 78, 100 + 14 * l_linenumber + CASE WHEN l_linenumber > 4 THEN 60 ELSE 0 END, CAST(l_linenumber AS STRING) FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS BIGINT), 150, 100 + 14 * l_linenumber + CASE WHEN l_linenumber > 4 THEN 60 ELSE 0 END, {MONEY.format(x='l_extendedprice')} FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS BIGINT), 260, 100 + 14 * l_linenumber + CASE WHEN l_linenumber > 4 THEN 60 ELSE 0 END, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS STRING) || '%' END FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS BIGINT), 330, 100 + 14 * l_linenumber + CASE WHEN l_linenumber > 4 THEN 60 ELSE 0 END, l_returnflag FROM lineitem) w
"""

#: id, text, lang: phrases of every kind beside names from the tables.
PHRASES = """
SELECT CAST(c_custkey AS BIGINT) AS id, p.n AS n, replace(p.t, '@', c_name) AS text, p.lang AS lang FROM customer CROSS JOIN (
    SELECT * FROM (VALUES (1, 'Hiii !', 'en'), (2, 'hi there @', 'en'), (3, 'kya haal hai?', 'hinglish'), (4, 'Thanks so much!', 'en'), (5, 'ok bye', 'en'), (6, 'Who are you?', 'xx'), (7, '  namaste  ', 'hinglish'),
        (8, 'and fees of @?', 'en'), (9, 'what is it', 'en'), (10, 'what is the very high cost of it now', 'en'), (11, 'and', 'en'), (12, 'How do I verify my KYC for an ATM?', 'en'), (13, 'A costume for @ abroad', 'en'),
        (14, 'mera paisa kab milega @', 'hinglish'), (15, 'one two three four five six seven hai', 'en'), (16, 'one two three four five six seven eight hai', 'en'), (17, 'मेरा', 'hinglish'), (18, '   ', 'en'),
        (19, 'Pay $1,234.50 by P2P or ACH, 5 % APR', 'en'), (20, '$20 at the ATM with OTP and 2FA', 'en'), (21, 'Customer support call about wallet fees, cards, and transfers.', 'en'), (22, 'customer support call for @', 'en'), (23, 'wallet support about x y', 'en')
    ) AS v(n, t, lang)) p
"""

#: session_id, seq, question, answer, language, ts: the turns of `conversations`, a user's turn with what follows it.
TURNS = """
SELECT CAST(conv_id AS BIGINT) AS session_id, CAST(turn AS BIGINT) AS seq, text AS question, coalesce(answer, '') AS answer FROM (
    SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS answer FROM conversations) t WHERE role = 'user'
"""


def duck(sql: str) -> str:
    """The statement as DuckDB writes it."""
    return re.sub(r"\barray\(", "list_value(", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """Run a statement over the tables of a folder, which its FROM clauses name.

    dealt: (table, column) of tables that are shuffled by that column before the statement multiplies their rows; a small file is
    one task otherwise. The number of partitions is stated, because Spark would join small ones.
    """
    names = sorted(set(re.findall(r"(?:FROM|JOIN) (region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b", sql)))
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n, column in (dealt or {}).items():
        tables[n] = tables[n].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    for n in names:
        sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **tables)
