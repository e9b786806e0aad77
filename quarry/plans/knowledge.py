"""Queries over the derived knowledge base: parsing, chunking, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import text as tx
from quarry.operators import chunk, layout, parse
from quarry.plans import kb
from quarry.plans.registry import derived, est, query, quoted, sentences, strip, table, windows


def _clean(x: str) -> str:
    plain = f"replace(replace(translate({x}, chr(160) || '’‘“”–—', ' ''''\"\"--'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return strip(rf"regexp_replace({plain}, '[ \t]+', ' ', 'g')")


SEC, SUB = r"'^(\d{1,2})\.\s+(.+?)\s*$'", r"'^(\d{1,2}\.\d{1,2})\s+(.+?)\s*$'"
BUL = r"'^\s*[•●○\-]\s*'"
W = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
P = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
NOISE = " AND ".join(f"NOT starts_with(text, {quoted(n)})" for n in lx.NOISE)

LINES = f"lines AS ({kb.duck(kb.KB_LINES)}), tabs AS ({kb.duck(kb.KB_TABLES)})"
CLASSES = rf"""{LINES},
cleaned AS (SELECT *, {_clean('raw_line')} AS line FROM lines),
classed AS (SELECT *, CASE WHEN regexp_matches(line, {SUB}) AND length(regexp_extract(line, {SUB}, 2)) < 80 THEN 'sub' WHEN regexp_matches(line, {SEC}) AND length(regexp_extract(line, {SEC}, 2)) < 80 AND NOT ends_with(line, '.') THEN 'sec'
    WHEN regexp_matches(line, '^Q:\s*(.+)$') THEN 'q' WHEN regexp_matches(line, '^A:\s*(.+)$') THEN 'a' WHEN regexp_matches({strip('raw_line')}, {BUL}) THEN 'bullet' ELSE 'prose' END AS class FROM cleaned WHERE line <> ''),
bodied AS (SELECT *, CASE WHEN class IN ('bullet', 'prose', 'a') THEN {strip(f"regexp_replace(line, {BUL}, '')")} END AS body FROM classed),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS idx FROM bodied WHERE class NOT IN ('bullet', 'prose') OR body <> '')"""
FILLED = rf"""{CLASSES},
filled AS (SELECT *, coalesce(last_value(CASE WHEN class = 'sec' THEN regexp_extract(line, {SEC}, 1) END IGNORE NULLS) {W}, '') AS section_no, coalesce(last_value(CASE WHEN class = 'sec' THEN regexp_extract(line, {SEC}, 2) END IGNORE NULLS) {W}, '') AS section_title,
    CASE WHEN sub_on THEN last_value(CASE WHEN class = 'sub' THEN regexp_extract(line, {SUB}, 1) END IGNORE NULLS) {W} ELSE '' END AS subsection_no, CASE WHEN sub_on THEN last_value(CASE WHEN class = 'sub' THEN regexp_extract(line, {SUB}, 2) END IGNORE NULLS) {W} ELSE '' END AS subsection_title
    FROM (SELECT *, coalesce(max(CASE WHEN class = 'sub' THEN idx END) {W}, 0) > coalesce(max(CASE WHEN class = 'sec' THEN idx END) {W}, 0) AS sub_on FROM placed))"""
PAIRED = rf"""{FILLED},
paired AS (SELECT * EXCLUDE (class, asked, ok), CASE WHEN ok THEN asked END AS question, CASE WHEN ok THEN 'faq' WHEN class = 'a' THEN 'prose' ELSE class END AS class FROM (
    SELECT *, last_value(CASE WHEN class = 'q' THEN regexp_extract(line, '^Q:\s*(.+)$', 1) END IGNORE NULLS) {P} AS asked, class = 'a' AND coalesce(max(CASE WHEN class = 'q' THEN idx END) {P}, 0) > coalesce(max(CASE WHEN class = 'a' THEN idx END) {P}, 0) AS ok FROM filled))"""
MERGED = rf"""{PAIRED},
texts AS (SELECT *, CASE WHEN class = 'faq' THEN 'Question: ' || question || chr(10) || 'Answer: ' || regexp_extract(line, '^A:\s*(.+)$', 1) ELSE body END AS text FROM paired WHERE class IN ('faq', 'bullet', 'prose')),
islands AS (SELECT *, sum(new) {W} AS block FROM (SELECT *, CASE WHEN class = 'prose' AND lag(class) OVER o = 'prose' AND lag(page) OVER o = page AND lag(section_no) OVER o = section_no AND NOT regexp_matches(lag(text) OVER o, '[.:?]$') THEN 0 ELSE 1 END AS new FROM texts WINDOW o AS (PARTITION BY doc_id ORDER BY idx))),
merged AS (SELECT doc_id, block, min(idx) AS idx, arg_min(class, idx) AS class, string_agg(text, ' ' ORDER BY idx) AS text, arg_min(section_no, idx) AS section_no, arg_min(section_title, idx) AS section_title, arg_min(subsection_no, idx) AS subsection_no, arg_min(subsection_title, idx) AS subsection_title, arg_min(page, idx) AS page, arg_min(question, idx) AS question FROM islands GROUP BY doc_id, block)"""
TABLES = f"""
cells AS (SELECT doc_id, page, table_no, list_transform(cells, lambda r: list_transform(r, lambda c: {_clean("coalesce(c, '')")})) AS cells FROM tabs),
rowed AS (SELECT doc_id, page, table_no, cells[1] AS columns, unnest(cells[2:]) AS r, unnest(range(0, len(cells) - 1)) AS row_no FROM cells WHERE len(cells) >= 2 AND len(list_filter(cells[1], lambda c: c <> '')) > 0),
linear AS (SELECT *, list_filter(list_transform(range(2, least(len(columns), len(r)) + 1), lambda i: CASE WHEN r[i] <> '' AND columns[i] <> '' THEN columns[i] || ': ' || r[i] WHEN r[i] <> '' THEN r[i] END), lambda x: x IS NOT NULL) AS pairs FROM rowed WHERE coalesce(r[1], '') <> ''),
sentences AS (SELECT doc_id, page, table_no, row_no, r[1] AS row_subject, columns, 'For ' || CASE WHEN columns[1] <> '' THEN columns[1] ELSE 'Item' END || ' ''' || r[1] || ''' — ' || array_to_string(pairs, '; ') || '.' AS text FROM linear WHERE len(pairs) > 0)"""
BLOCKS = f"""{MERGED}, {TABLES},
heads AS (SELECT doc_id, page, 2 AS source, idx AS a, 0 AS b, NULL AS text, NULL AS row_subject, {{'n': section_no, 't': section_title, 'sn': subsection_no, 'st': subsection_title}} AS head FROM filled),
tabled AS (SELECT * FROM (SELECT * EXCLUDE (head), coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, source, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {{'n': '', 't': '', 'sn': '', 'st': ''}}) AS head FROM (SELECT * FROM heads UNION ALL SELECT doc_id, page, 0, table_no, row_no, text, row_subject, NULL FROM sentences)) WHERE source = 0),
every AS (SELECT doc_id, page, 1 AS source, idx AS a, 0 AS b, class AS kind, text, section_no, section_title, CASE WHEN class = 'faq' THEN '' ELSE subsection_no END AS subsection_no, CASE WHEN class = 'faq' THEN '' ELSE subsection_title END AS subsection_title, question, NULL AS row_subject FROM merged
    UNION ALL SELECT doc_id, page, 0, a, b, 'table_row', text, head.n, head.t, head.sn, head.st, NULL, row_subject FROM tabled),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, source, a, b) AS block_no, kind, text, section_no, section_title, subsection_no, subsection_title, page, question, row_subject FROM every WHERE {NOISE})"""
B = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LAYOUT = f"""
words AS (SELECT * FROM ({kb.duck(kb.KB_WORDS)}) WHERE trim(text) <> ''),
lined AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top, bottom, x0, x1, text RANGE UNBOUNDED PRECEDING) AS line FROM (
    SELECT *, CASE WHEN coalesce(top - max(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, bottom, x0, x1, text {B}) >= -1, true) THEN 1 ELSE 0 END AS fresh FROM words)),
celled AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page, line ORDER BY x0, x1, text RANGE UNBOUNDED PRECEDING) AS cell FROM (
    SELECT *, CASE WHEN coalesce(x0 - max(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0, x1, text {B}) >= 12, true) THEN 1 ELSE 0 END AS apart FROM lined)),
frags AS (SELECT doc_id, page, line, cell, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, string_agg(text, ' ' ORDER BY x0, x1, text) AS text FROM celled GROUP BY ALL),
rowed_up AS (SELECT *, sum(CASE WHEN coalesce(before > 1 AND top - above < 20, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, lag(n) OVER (PARTITION BY doc_id, page ORDER BY line) AS before, lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY line) AS above FROM (
        SELECT doc_id, page, line, count(*) AS n, min(top) AS top, max(bottom) AS bottom FROM frags GROUP BY ALL))),
gridded AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page, run ORDER BY x0, x1, line, text RANGE UNBOUNDED PRECEDING) AS col FROM (
    SELECT f.doc_id, f.page, run, f.line, r.top, r.bottom, x0, x1, text, CASE WHEN coalesce(x0 - max(x1) OVER (PARTITION BY f.doc_id, f.page, run ORDER BY x0, x1, f.line, text {B}) >= 1, true) THEN 1 ELSE 0 END AS apart
    FROM frags f JOIN rowed_up r ON f.doc_id = r.doc_id AND f.page = r.page AND f.line = r.line WHERE n > 1)),
kept_tables AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY run) AS table_no FROM (
    SELECT doc_id, page, run, min(top) AS top, max(bottom) AS bottom, max(col)::BIGINT AS width FROM gridded GROUP BY ALL HAVING count(DISTINCT line) >= 2 AND max(col) > 1)),
slots AS (SELECT doc_id, page, run, line, col, string_agg(text, ' ' ORDER BY x0, x1, text) AS text FROM gridded GROUP BY ALL),
grid AS (SELECT k.doc_id, k.page, k.table_no, k.top, k.bottom, l.line, row_number() OVER (PARTITION BY k.doc_id, k.page, k.run ORDER BY l.line) AS row_no, list_transform(range(1, k.width + 1), lambda c: l.texts[c]) AS cells
    FROM kept_tables k JOIN (SELECT doc_id, page, run, line, map_from_entries(list({{'k': col::BIGINT, 'v': text}})) AS texts FROM slots GROUP BY ALL) l ON k.doc_id = l.doc_id AND k.page = l.page AND k.run = l.run)"""
TARGET = 60  # tokens; small, so that every branch of the packing occurs in the derived texts
GROUPS = f"""{BLOCKS},
grouped AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM (
    SELECT *, coalesce(lag(section_no) OVER o = section_no AND lag(subsection_no) OVER o = subsection_no, false) AS same FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY block_no)))"""
_ALONE, _FULL = f"({est('i.text')} >= {TARGET})", f"(a.tokens + {est('i.text')} > {TARGET} AND len(a.buf) > 0)"
_SHARED = "{'place': NULL::BIGINT, 'text': array_to_string(list_transform(a.buf, lambda t: '- ' || t), chr(10))}"
_FLUSH = f"CASE WHEN len(a.buf) > 0 THEN list_append(a.out, {_SHARED}) ELSE a.out END"
CHUNKS = f"""{GROUPS},
bl AS (SELECT doc_id, group_no, list({{'place': block_no, 'text': text}} ORDER BY block_no) AS items FROM grouped WHERE kind = 'bullet' GROUP BY ALL),
bp AS (SELECT doc_id, group_no, list_transform([list_reduce(items, lambda a, i: {{'out': CASE WHEN {_ALONE} THEN list_append({_FLUSH}, {{'place': i.place::BIGINT, 'text': '- ' || i.text}}) WHEN {_FULL} THEN {_FLUSH} ELSE a.out END,
    'buf': CASE WHEN {_ALONE} THEN []::VARCHAR[] WHEN {_FULL} THEN [i.text] ELSE list_append(a.buf, i.text) END, 'tokens': CASE WHEN {_ALONE} THEN 0::BIGINT WHEN {_FULL} THEN {est('i.text')} ELSE a.tokens + {est('i.text')} END}},
    {{'out': []::STRUCT(place BIGINT, text VARCHAR)[], 'buf': []::VARCHAR[], 'tokens': 0::BIGINT}})], lambda a: {_FLUSH})[1] AS packed FROM bl),
bullets AS (SELECT doc_id, group_no, 1 AS class, p.place AS block_no, seq, 'bullets' AS kind, p.text AS text, NULL AS question, NULL AS row_subject FROM (SELECT doc_id, group_no, unnest(packed) AS p, unnest(range(0, len(packed))) AS seq FROM bp)),
pr AS (SELECT doc_id, group_no, {strip("string_agg(text, ' ' ORDER BY block_no)")} AS t FROM grouped WHERE kind = 'prose' GROUP BY ALL),
pw AS (SELECT doc_id, group_no, {windows("(" + sentences("t") + ")", TARGET)} AS w FROM pr),
prose AS (SELECT doc_id, group_no, 2 AS class, NULL::BIGINT AS block_no, unnest(range(0, len(w))) AS seq, 'prose' AS kind, unnest(w) AS text, NULL AS question, NULL AS row_subject FROM pw),
pieces AS (SELECT doc_id, group_no, 0 AS class, block_no, block_no AS seq, kind, text, question, row_subject FROM grouped WHERE kind IN ('faq', 'table_row') UNION ALL SELECT * FROM bullets UNION ALL SELECT * FROM prose),
headed AS (SELECT p.doc_id, p.group_no, p.class, p.seq, p.kind, {strip('p.text')} AS raw_text, p.question, p.row_subject, coalesce(o.h, a.h) AS h FROM pieces p
    JOIN (SELECT doc_id, group_no, arg_min({{'n': section_no, 't': section_title, 'sn': subsection_no, 'st': subsection_title, 'p': page}}, block_no) AS h FROM grouped GROUP BY ALL) a USING (doc_id, group_no)
    LEFT JOIN (SELECT doc_id, block_no, {{'n': section_no, 't': section_title, 'sn': subsection_no, 'st': subsection_title, 'p': page}} AS h FROM grouped) o ON o.doc_id = p.doc_id AND o.block_no = p.block_no),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_no, class, seq) - 1 AS chunk_id FROM headed WHERE raw_text <> '' AND {est('raw_text')} >= 8),
chunks AS (SELECT doc_id, 'chunk-' || doc_id::VARCHAR || printf('-%04d', chunk_id) AS id, chunk_id, kind, CASE WHEN h.n = '' AND h.sn = '' THEN 'Customer Support Knowledge Base' ELSE concat_ws(' > ', CASE WHEN h.n <> '' THEN 'Section ' || h.n || ': ' || h.t END, CASE WHEN h.sn <> '' THEN h.st END) END AS header, raw_text,
    CASE WHEN h.n = '' THEN '0' ELSE h.n END AS section_no, CASE WHEN h.t = '' THEN 'General' ELSE h.t END AS section_title, h.sn AS subsection_no, h.p AS page, {est('raw_text')} AS n_tokens, coalesce(question, '') AS question, coalesce(row_subject, '') AS row_subject FROM numbered)"""


def _lines(spark, d):
    """Dealt by document, as the windows of the parser need it: the source files are few and would be parsed by as few tasks."""
    return derived(spark, d, kb.KB_LINES).repartition("doc_id")


def _tables(spark, d):
    """Dealt by document before cells are made of the rows, so that numbers are shuffled and not texts."""
    return derived(spark, d, kb.KB_TABLES, {"lineitem": "l_orderkey"})


def _blocks(spark, d):
    return parse.parse_blocks(_lines(spark, d), _tables(spark, d))


def _chunks(spark, d):
    return chunk.build_chunks(_blocks(spark, d), target=TARGET)


@query("kb_lines", f"WITH {LINES} SELECT * FROM lines")
def kb_lines(spark, d):
    return _lines(spark, d)


@query("clean_text", f"WITH {LINES} SELECT doc_id, page, line_no, {_clean('raw_line')} AS line FROM lines")
def clean_text(spark, d):
    return _lines(spark, d).select("doc_id", "page", "line_no", tx.clean_text(F.col("raw_line")).alias("line"))


@query("line_classify", f"WITH {CLASSES} SELECT doc_id, page, line_no, idx, class, body FROM placed")
def line_classify(spark, d):
    return parse.classify_lines(_lines(spark, d)).select("doc_id", "page", "line_no", F.col("idx").cast("long").alias("idx"), "class", "body")


@query("section_ffill", f"WITH {FILLED} SELECT doc_id, idx, section_no, section_title, subsection_no, subsection_title FROM filled")
def section_ffill(spark, d):
    return parse.fill_sections(parse.classify_lines(_lines(spark, d))).select("doc_id", F.col("idx").cast("long").alias("idx"), "section_no", "section_title", "subsection_no", "subsection_title")


@query("faq_pairs", f"WITH {PAIRED} SELECT doc_id, idx, class, question FROM paired WHERE class = 'faq' OR starts_with(line, 'A:')")
def faq_pairs(spark, d):
    paired = parse.pair_questions(parse.fill_sections(parse.classify_lines(_lines(spark, d))))
    return paired.filter((F.col("class") == "faq") | F.col("line").startswith("A:")).select("doc_id", F.col("idx").cast("long").alias("idx"), "class", "question")


@query("para_merge", f"WITH {MERGED} SELECT doc_id, idx, class, text, section_no, subsection_no, page FROM merged")
def para_merge(spark, d):
    merged = parse.merge_paragraphs(parse.pair_questions(parse.fill_sections(parse.classify_lines(_lines(spark, d)))))
    return merged.select("doc_id", F.col("idx").cast("long").alias("idx"), "class", "text", "section_no", "subsection_no", "page")


@query("noise_filter", f"WITH {MERGED} SELECT doc_id, idx, text FROM merged WHERE {NOISE}")
def noise_filter(spark, d):
    merged = parse.merge_paragraphs(parse.pair_questions(parse.fill_sections(parse.classify_lines(_lines(spark, d)))))
    return parse.drop_noise(merged).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


@query("table_linearize", f"WITH {LINES}, {TABLES} SELECT doc_id, page, table_no, row_no, row_subject, text FROM sentences")
def table_linearize(spark, d):
    return parse.linearize_tables(_tables(spark, d)).select("doc_id", "page", "table_no", F.col("row_no").cast("long").alias("row_no"), "row_subject", "text")


@query("kb_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def kb_blocks(spark, d):
    return _blocks(spark, d)


@query("region_anti", "SELECT l_orderkey AS doc_id, l_linenumber AS obj_id FROM lineitem o WHERE NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey = o.l_orderkey AND (l_quantity + l_quantity + 4) / 2 BETWEEN r.o_custkey % 40 AND r.o_custkey % 40 + 12)")
def region_anti(spark, d):
    objects = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("obj_id"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 4).alias("bottom"))
    regions = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("o_custkey") % 40).alias("top"), (F.col("o_custkey") % 40 + 12).alias("bottom"))
    return parse.outside_tables(objects, regions).select("doc_id", "obj_id")


@query("table_discovery", f"WITH {LAYOUT} SELECT doc_id, page, table_no, top, bottom, row_no, array_to_string(list_transform(cells, lambda c: coalesce(c, '-')), ' | ') AS cells FROM grid")
def table_discovery(spark, d):
    """Tables found among the words of a page, a row each of their rows."""
    found = layout.find_tables(derived(spark, d, kb.KB_WORDS))
    rows = found.select("doc_id", "page", "table_no", "top", "bottom", F.posexplode("cells").alias("row_no", "row"))
    return rows.select("doc_id", "page", "table_no", "top", "bottom", (F.col("row_no") + 1).cast("long").alias("row_no"), F.array_join("row", " | ", "-").alias("cells"))


@query("run_groups", f"WITH {GROUPS} SELECT doc_id, block_no, group_no FROM grouped")
def run_groups(spark, d):
    return chunk.run_groups(_blocks(spark, d)).select("doc_id", "block_no", "group_no")


@query("ctx_header", f"WITH {CHUNKS} SELECT DISTINCT header FROM chunks")
def ctx_header(spark, d):
    return _chunks(spark, d).select("header").distinct()


@query("chunk_atomic", f"WITH {CHUNKS} SELECT doc_id, group_no, block_no, kind, text, question, row_subject FROM pieces WHERE class = 0")
def chunk_atomic(spark, d):
    return chunk.atomic_chunks(chunk.run_groups(_blocks(spark, d))).select("doc_id", "group_no", "block_no", "kind", "text", "question", "row_subject")


@query("bullet_pack", f"WITH {CHUNKS} SELECT doc_id, group_no, seq, block_no, text FROM bullets")
def bullet_pack(spark, d):
    return chunk.bullet_chunks(chunk.run_groups(_blocks(spark, d)), TARGET).select("doc_id", "group_no", "seq", "block_no", "text")


@query("prose_windows", f"WITH {CHUNKS} SELECT doc_id, group_no, seq, text FROM prose")
def prose_windows(spark, d):
    return chunk.prose_chunks(chunk.run_groups(_blocks(spark, d)), TARGET).select("doc_id", "group_no", "seq", "text")


@query("chunk_emit", f"WITH {CHUNKS} SELECT doc_id, id, chunk_id, kind, '[' || header || ']' || chr(10) || raw_text AS text, section_no, section_title, subsection_no, page, n_tokens, question, row_subject FROM chunks")
def chunk_emit(spark, d):
    return _chunks(spark, d).select("doc_id", "id", "chunk_id", "kind", "text", "section_no", "section_title", "subsection_no", "page", F.col("n_tokens").cast("long").alias("n_tokens"), "question", "row_subject")


@query("chunk_long_runs", f"WITH {CHUNKS} SELECT doc_id, id, chunk_id, kind, '[' || header || ']' || chr(10) || raw_text AS text, section_no, section_title, subsection_no, page, n_tokens, question, row_subject FROM chunks")
def chunk_long_runs(spark, d):
    """chunk_emit with every run packed on rows, as runs of any length are."""
    chunks = chunk.build_chunks(_blocks(spark, d), target=TARGET, long_run=0)
    return chunks.select("doc_id", "id", "chunk_id", "kind", "text", "section_no", "section_title", "subsection_no", "page", F.col("n_tokens").cast("long").alias("n_tokens"), "question", "row_subject")


@query("chunk_links", f"WITH {CHUNKS} SELECT doc_id, id, lag(id, 1, '') OVER o AS prev_id, lead(id, 1, '') OVER o AS next_id FROM chunks WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_id)")
def chunk_links(spark, d):
    return _chunks(spark, d).select("doc_id", "id", "prev_id", "next_id")


@query("kind_counts", f"WITH {CHUNKS} SELECT kind, count(*) AS n FROM chunks GROUP BY kind")
def kind_counts(spark, d):
    return chunk.count_kinds(_chunks(spark, d))


@query("ingest_stats", f"WITH {CHUNKS} SELECT (SELECT count(*) FROM blocks) AS n_blocks, (SELECT count(*) FROM blocks WHERE kind = 'table_row') AS n_table_rows, (SELECT count(*) FROM blocks WHERE kind = 'faq') AS n_faq, count(*) AS n_chunks, min(n_tokens) AS min_tokens, floor(sum(n_tokens) / count(*))::BIGINT AS avg_tokens, max(n_tokens) AS max_tokens FROM chunks")
def ingest_stats(spark, d):
    blocks = _blocks(spark, d)
    return chunk.ingest_report(blocks, chunk.build_chunks(blocks, target=TARGET)).withColumns({"min_tokens": F.col("min_tokens").cast("long"), "max_tokens": F.col("max_tokens").cast("long")})


@query("ingest_preview", f"WITH {CHUNKS} SELECT doc_id, id, kind, header, substr(raw_text, 1, 240) AS preview FROM chunks ORDER BY doc_id, chunk_id LIMIT 3")
def ingest_preview(spark, d):
    return chunk.ingest_preview(_chunks(spark, d))


MON, PCT, DUR, TIE = r"'\$[\d,]+(?:\.\d{2})?'", r"'\d+(?:\.\d+)?\s*%'", r"'(?i)\b\d+\s*(?:-\s*\d+\s*)?(?:business\s+)?(?:day|days|hour|hours|minute|minutes|month|months|year|years)\b'", r"'(?i)\bTier\s*[123]\b'"
FACETS = {
    "facet_amounts": (f"list_sort(list_distinct(regexp_extract_all(text, {MON})))[1:8]", tx.amounts),
    "facet_pct": (f"list_sort(list_distinct(regexp_extract_all(text, {PCT})))[1:8]", tx.percentages),
    "facet_durations": (f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {DUR}), lambda x: lower(x))))[1:8]", tx.durations),
    "facet_tiers": (f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {TIE}), lambda x: replace('Tier' || substr(x, 5), '  ', ' '))))", tx.tiers),
}


def _facet(name, sql, f):
    @query(name, f"WITH {BLOCKS} SELECT doc_id, block_no, {sql} AS found FROM blocks")
    def run(spark, d):
        return _blocks(spark, d).select("doc_id", "block_no", f(F.col("text")).alias("found"))


for _name, (_sql, _f) in FACETS.items():
    _facet(_name, _sql, _f)


@query("facet_flags", f"WITH {BLOCKS} SELECT doc_id, block_no, regexp_matches(text, {MON}) OR regexp_matches(text, {PCT}) AS has_numbers FROM blocks")
def facet_flags(spark, d):
    return _blocks(spark, d).select("doc_id", "block_no", tx.has_numbers(F.col("text")).alias("has_numbers"))


NUM = r"regexp_extract_all(text, '\$?\d+(?:[.,]\d+)*\s*%?')"


@query("num_normalize", rf"WITH {BLOCKS} SELECT doc_id, block_no, list_transform({NUM}, lambda n: regexp_replace(regexp_replace(regexp_replace(translate(n, '$, ', ''), '\s+', '', 'g'), '%+$', ''), '\.+$', '')) AS numbers FROM blocks")
def num_normalize(spark, d):
    return _blocks(spark, d).select("doc_id", "block_no", F.transform(tx.find_all(F.col("text"), lx.NUMBER), lambda n: tx.normalize_number(n)).alias("numbers"))


@query("ungrounded_nums", rf"WITH {BLOCKS}, n AS (SELECT doc_id, page, list_distinct(flatten(list(list_transform({NUM.replace('(text', '(lower(text)')}, lambda n: regexp_replace(regexp_replace(regexp_replace(translate(n, '$, ', ''), '\s+', '', 'g'), '%+$', ''), '\.+$', ''))))) AS c FROM blocks GROUP BY ALL) SELECT a.doc_id, list_sort(list_filter(a.c, lambda x: x <> '' AND NOT list_contains(['0', '1', '2', '3'], x) AND NOT list_contains(b.c, x))) AS missing FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page = 1 AND b.page = 2")
def ungrounded_nums(spark, d):
    """Numbers of a document's first page that its second page does not hold."""
    from quarry.operators.guard import ungrounded_numbers

    pages = _blocks(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"]), "\n|\n").alias("t"))
    one, two = pages.filter("page = 1").select("doc_id", F.col("t").alias("answer")), pages.filter("page = 2").select("doc_id", F.col("t").alias("context"))
    return one.join(two, "doc_id").select("doc_id", ungrounded_numbers(F.col("answer"), F.col("context")).alias("missing"))
