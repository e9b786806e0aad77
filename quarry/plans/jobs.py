"""The runnable jobs as queries: each runs twice into the same new folder, and its whole output is read back."""

from __future__ import annotations

from jobs.answer_audit import answer_audit
from jobs.refresh_collection import refresh_collection
from quarry.functions import lexicon as lx
from quarry.plans.registry import est, query, sentences, windows
from quarry.plans.texts import GATE, GROUND, HITS, LANGUAGE
from quarry.sources.folders import scratch

_NUMBERS = f"(regexp_matches(text, '{lx.MONEY}') OR regexp_matches(text, '{lx.PERCENT}'))"


@query("job1_refresh_collection", rf"""WITH once AS (SELECT doc_id, text, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text NULLS FIRST, lang NULLS FIRST, source NULLS FIRST) AS rn FROM documents WHERE doc_id IS NOT NULL) WHERE rn = 1),
cut AS (SELECT doc_id, lang, source, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT *, {windows('(' + sentences('text') + ')')} AS w FROM once)),
kept AS (SELECT *, {est('text')}::INT AS n_tokens, regexp_extract_all(lower(text), '[a-zA-Z'']+') AS t FROM cut)
SELECT printf('%d-%04d', doc_id, pos) AS id, doc_id, source, pos::INT AS pos, text, n_tokens, {LANGUAGE.format(x='text', h=HITS)} AS language, {_NUMBERS} AS has_numbers, lang FROM kept WHERE n_tokens >= 8""")
def job1_refresh_collection(spark, d):
    out = scratch(spark, "job1")
    refresh_collection(spark, f"{d}/documents.parquet", out)
    return refresh_collection(spark, f"{d}/documents.parquet", out).drop("batch")


@query("job2_answer_audit", f"""WITH {GROUND}, gate AS ({GATE}),
tops AS (SELECT query_id, count(*) AS n_hits, min_by(id, final_rank) AS top_id FROM hits GROUP BY query_id)
SELECT query_id, item.text AS text, CASE WHEN abstain THEN 'no_source' WHEN len(missing) > 0 OR ratio < 0.4 THEN 'ungrounded' ELSE 'grounded' END AS verdict, top_id, coalesce(n_hits, 0) AS n_hits,
    CASE WHEN abstain THEN reason WHEN len(missing) > 0 THEN 'ungrounded_numbers=[''' || array_to_string(missing, ''', ''') || ''']' WHEN ratio < 0.4 THEN 'low_overlap=' || printf('%.2f', ratio) ELSE '' END AS reason
FROM gate JOIN (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark) item USING (query_id) LEFT JOIN judged USING (query_id) LEFT JOIN tops USING (query_id)""")
def job2_answer_audit(spark, d):
    out = scratch(spark, "job2")
    paths = (f"{d}/documents.parquet", f"{d}/benchmark.parquet", f"{d}/embeddings.parquet", out)
    answer_audit(spark, *paths)
    return answer_audit(spark, *paths).drop("run")
