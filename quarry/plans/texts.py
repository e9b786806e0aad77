"""Queries over documents, benchmark questions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import text as tx
from quarry.operators import cache_order, dense_index, guard, index, memory, nlu, retrieve, stored_index
from quarry.plans.registry import est, in_list, parts, query, sentences, strip, table, windows
from quarry.sources import lines
from quarry.sources.folders import scratch
from quarry.sources.store import CollectionStore

TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9$%.]+')"


@query("scan", "SELECT doc_id AS id, text AS document, lang, source FROM documents")
def scan(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang", "source")


@query("index_write", "SELECT doc_id AS id, text AS document, lang FROM documents")
def index_write(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang")
    store = CollectionStore(scratch(spark, "index"))
    store.overwrite(chunks, "documents")
    return store.read(spark, "documents")


@query("page_scan", "SELECT coalesce(lang, 'none') AS lang, text, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY ALL")
def page_scan(spark, d):
    """The texts written as the pages of files, a folder a language, and read back in parts."""
    path = scratch(spark, "pages")
    texts = table(spark, d, "documents").filter("text <> ''").select("text", F.coalesce("lang", F.lit("none")).alias("lang"))
    texts.write.partitionBy("lang").option("lineSep", "\f").text(path)
    pages = lines.scan_pages(spark, path)
    return pages.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), "text").agg(F.count(F.lit(1)).alias("n"))


@query("est_tokens", f"SELECT doc_id, {est('text')}::INT AS n_tokens FROM documents")
def est_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.est_tokens(F.col("text")).alias("n_tokens"))


def _listed(spark, d, f, name):
    return table(spark, d, "documents").select("doc_id", F.posexplode(f(F.col("text"))).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def _listed_sql(x: str, name: str) -> str:
    return f"SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS {name} FROM (SELECT doc_id, {x} AS l FROM documents)"


@query("sent_split", _listed_sql(sentences("text"), "sentence"))
def sent_split(spark, d):
    return _listed(spark, d, tx.sentences, "sentence")


@query("tts_split", _listed_sql(parts("text", r"([.!?])\s+", r"'\1' || chr(1)"), "sentence"))
def tts_split(spark, d):
    return _listed(spark, d, tx.spoken_sentences, "sentence")


@query("stream_sentences", _listed_sql(parts("text", "([.!?]) ", r"'\1' || chr(1)"), "sentence"))
def stream_sentences(spark, d):
    return _listed(spark, d, tx.streamed_sentences, "sentence")


@query("sent_windows", _listed_sql(windows("(" + sentences("text") + ")"), "window_text"))
def sent_windows(spark, d):
    return _listed(spark, d, tx.sentence_windows, "window_text")


@query("sent_windows_small", _listed_sql(windows("(" + sentences("text") + ")", 60), "window_text"))
def sent_windows_small(spark, d):
    return _listed(spark, d, lambda x: tx.sentence_windows(x, 60), "window_text")


HITS = f"len(list_filter(t, lambda w: list_contains({in_list(lx.HINGLISH_WORDS)}, w)))"
LANGUAGE = "CASE WHEN regexp_matches({x}, '[\\x{{0900}}-\\x{{097F}}]') OR {h} >= 2 OR ({h} >= 1 AND {h} / greatest(len(t), 1)::DOUBLE >= 0.12::DOUBLE) THEN 'hinglish' ELSE 'en' END"


@query("lang_detect", f"SELECT doc_id, {LANGUAGE.format(x='text', h=HITS)} AS language FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zA-Z'']+') AS t FROM documents)")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", nlu.detect_language(F.col("text")).alias("language"))


@query("l2_normalize", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-9::DOUBLE), 6)) AS unit FROM embeddings")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(index.l2_normalize(F.col("embedding")), lambda x: index.rounded(x, 6)).alias("unit"))


@query("bm25_tokens", f"SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format(x='text')}) AS token FROM documents) GROUP BY ALL")
def bm25_tokens(spark, d):
    return index.postings(table(spark, d, "documents"), "doc_id").select("id", "token", "tf")


BM25 = f"""
docs AS (SELECT doc_id AS id, {TOKENS.format(x='text')} AS t FROM documents), stats AS (SELECT count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS avgdl FROM docs),
post AS (SELECT id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM docs) GROUP BY id, token),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
raw AS (SELECT token, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs CROSS JOIN stats),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format(x='text')}) AS token FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, id, sum(qtf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN idf USING (token) JOIN post USING (token) CROSS JOIN stats GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS bm25_rank FROM scores WHERE round(score, 6) > 0) WHERE bm25_rank < 25)"""


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_idf", f"WITH {BM25} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    docs = _docs(spark, d)
    return index.term_stats(index.postings(docs), index.corpus_stats(docs)).select("token", "df", F.round("idf", 6).alias("idf"))


@query("bm25_score", f"WITH {BM25} SELECT query_id, count(*) AS n, round(max(score), 4) AS top, round(avg(score), 4) AS mean FROM scores GROUP BY query_id")
def bm25_score(spark, d):
    return retrieve.bm25_scores(_docs(spark, d), _questions(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("top"), F.round(F.avg("score"), 4).alias("mean"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, id, round(score, 3) AS score, bm25_rank FROM sparse")
def bm25_topk(spark, d):
    return retrieve.bm25_best(_docs(spark, d), _questions(spark, d)).withColumn("score", F.round("score", 3))


@query("bm25_stored", f"WITH {BM25} SELECT query_id, id, round(score, 3) AS score, bm25_rank FROM sparse")
def bm25_stored(spark, d):
    """The same from a stored index, to which the documents of each language were added alone."""
    stored = stored_index.StoredIndex(spark, scratch(spark, "postings"), id_type="bigint")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.coalesce("lang", F.lit("")) == "en").alias("en"))
    for batch, some in enumerate((docs.filter("en"), docs.filter("NOT en"))):
        stored.add(some.drop("en"), batch)
    return stored.best(_questions(spark, d)).withColumn("score", F.round("score", 3))


DENSE = """
vecs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), qvecs AS (SELECT item_id AS query_id, e AS q FROM benchmark JOIN vecs ON item_id = id),
dense AS (SELECT * FROM (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) - 1 AS dense_rank FROM (SELECT query_id, id, round(list_inner_product(e, q), 6) AS sim FROM qvecs CROSS JOIN vecs)) WHERE dense_rank < 25)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _question_vectors(spark, d):
    """A question's vector is the one of its number."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(_vectors(spark, d).withColumnsRenamed({"id": "query_id", "embedding": "qvec"}), "query_id")


@query("dense_topk", f"WITH {DENSE} SELECT query_id, id, sim, dense_rank FROM dense")
def dense_topk(spark, d):
    return retrieve.dense_topk(_vectors(spark, d), _question_vectors(spark, d))


@query("dense_cells", f"WITH {DENSE} SELECT query_id, id, sim, dense_rank FROM dense")
def dense_cells(spark, d):
    """The same from stored cells, of which a question reads those that can hold one of its best."""
    stored = dense_index.DenseIndex(spark, scratch(spark, "cells"))
    stored.begin(_vectors(spark, d))
    stored.add(_vectors(spark, d), 0)
    return stored.search(_question_vectors(spark, d))


HYBRID = f"""{BM25}, {DENSE},
merged AS (SELECT query_id, id, coalesce(dense_rank, 10000) AS dense_rank, coalesce(bm25_rank, 10000) AS bm25_rank FROM (SELECT query_id, id, dense_rank FROM dense) FULL OUTER JOIN (SELECT query_id, id, bm25_rank FROM sparse) USING (query_id, id) WHERE id IN (SELECT doc_id FROM documents)),
fused AS (SELECT *, 1.0::DOUBLE / (60 + dense_rank) + 0.75::DOUBLE / (60 + bm25_rank) AS fused FROM merged),
top20 AS (SELECT * FROM (SELECT query_id, id, dense_rank, bm25_rank, round(fused, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, dense_rank, bm25_rank, id) - 1 AS fused_rank FROM fused) WHERE fused_rank < 20),
reranked AS (SELECT h.*, CASE WHEN len(a) > 0 THEN len(list_intersect(a, list_distinct(b))) / len(a)::DOUBLE ELSE 0 END AS rerank_score FROM top20 h JOIN (SELECT item_id, list_distinct({TOKENS.format(x='text')}) AS a FROM benchmark) q ON q.item_id = h.query_id JOIN (SELECT doc_id, {TOKENS.format(x='text')} AS b FROM documents) t ON t.doc_id = h.id),
final AS (SELECT * FROM (SELECT query_id, id, rerank_score, fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank, id) - 1 AS final_rank FROM reranked) WHERE final_rank < 4),
linked AS (SELECT doc_id AS id, text, lang AS section_no, source AS header, lag(doc_id) OVER (ORDER BY doc_id) AS prev_id, lead(doc_id) OVER (ORDER BY doc_id) AS next_id FROM documents),
anchors AS (SELECT f.*, section_no, prev_id, next_id FROM final f JOIN linked USING (id) WHERE final_rank < 2 AND rerank_score >= 0.5),
reach AS (SELECT query_id, section_no, rerank_score, final_rank, 0 AS side, prev_id AS near_id FROM anchors UNION ALL SELECT query_id, section_no, rerank_score, final_rank, 1, next_id FROM anchors),
fresh AS (SELECT r.* FROM reach r JOIN linked l ON l.id = r.near_id AND l.section_no = r.section_no WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.query_id = r.query_id AND f.id = r.near_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, near_id ORDER BY final_rank, side) AS rn FROM fresh) WHERE rn = 1),
hits AS (SELECT query_id, id, rerank_score, final_rank, false AS neighbor FROM final UNION ALL
    SELECT query_id, near_id, rerank_score - 0.01::DOUBLE, (SELECT count(*) FROM final f WHERE f.query_id = o.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY final_rank, side) - 1, true FROM once o)"""


def _merged(spark, d):
    docs = _docs(spark, d)
    sparse = retrieve.bm25_best(docs, _questions(spark, d))
    return retrieve.merge_hits(retrieve.dense_topk(_vectors(spark, d), _question_vectors(spark, d)), sparse, docs)


@query("hybrid_merge", f"WITH {HYBRID} SELECT query_id, id, dense_rank, bm25_rank FROM merged")
def hybrid_merge(spark, d):
    return _merged(spark, d)


@query("rrf", f"WITH {HYBRID} SELECT query_id, id, dense_rank, bm25_rank, round(fused, 9) AS fused FROM fused")
def rrf(spark, d):
    return retrieve.rrf(_merged(spark, d)).withColumn("fused", F.round("fused", 9))


@query("rrf_topk", f"WITH {HYBRID} SELECT query_id, id, dense_rank, bm25_rank, fused, fused_rank FROM top20")
def rrf_topk(spark, d):
    return retrieve.rrf_topk(retrieve.rrf(_merged(spark, d)))


def _reranked(spark, d):
    return retrieve.rerank(retrieve.rrf_topk(retrieve.rrf(_merged(spark, d))), _docs(spark, d), _questions(spark, d))


@query("rerank", f"WITH {HYBRID} SELECT query_id, id, fused_rank, round(rerank_score, 6) AS rerank_score FROM reranked")
def rerank(spark, d):
    return _reranked(spark, d).select("query_id", "id", "fused_rank", F.round("rerank_score", 6).alias("rerank_score"))


def _final(spark, d):
    return retrieve.final_topk(_reranked(spark, d))


@query("final_topk", f"WITH {HYBRID} SELECT query_id, id, round(rerank_score, 6) AS rerank_score, final_rank FROM final")
def final_topk(spark, d):
    return _final(spark, d).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


def _linked(spark, d):
    """Documents as chunks: neighbours by id, the language as section."""
    ids = retrieve.link_by_order(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("section_no")))
    return ids.select("id", "section_no", "prev_id", "next_id")


def _hits(spark, d):
    return retrieve.expand_neighbors(_final(spark, d), _linked(spark, d))


@query("neighbor_expand", f"WITH {HYBRID} SELECT query_id, id, round(rerank_score, 6) AS rerank_score, final_rank, neighbor FROM hits")
def neighbor_expand(spark, d):
    return _hits(spark, d).withColumn("rerank_score", F.round("rerank_score", 6))


def _texts_of_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("header"), (F.col("doc_id") % 90 + 1).alias("page"))
    hits, near = retrieve.few_hits(_hits(spark, d))
    return docs.join(near(hits), "id").select(*hits.columns, *docs.columns[1:])


CONTEXT = f"""{HYBRID},
context AS (SELECT query_id, string_agg('[Passage ' || (final_rank + 1)::VARCHAR || ' | ' || header || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY final_rank) AS context FROM hits JOIN linked USING (id) GROUP BY query_id)"""


@query("build_context", f"WITH {CONTEXT} SELECT query_id, context FROM context")
def build_context(spark, d):
    return guard.build_context(_texts_of_hits(spark, d))


@query("sources", f"WITH {HYBRID} SELECT query_id, final_rank, id, header AS section, id % 90 + 1 AS page, round_even(rerank_score, 3) AS score, substr(text, 1, 150) AS preview FROM hits JOIN linked USING (id)")
def sources(spark, d):
    return guard.sources(_texts_of_hits(spark, d))


@query("ui_sources", f"WITH {HYBRID} SELECT query_id, string_agg(header, ' · ' ORDER BY r) AS sections FROM (SELECT query_id, header, min(final_rank) AS r FROM hits JOIN linked USING (id) WHERE header <> '' GROUP BY ALL) GROUP BY query_id")
def ui_sources(spark, d):
    return guard.section_line(guard.sources(_texts_of_hits(spark, d)))


GATE = "SELECT item_id AS query_id, coalesce(top < 0.15, true) AS abstain, CASE WHEN top IS NULL THEN 'no_hits' WHEN top < 0.15 THEN 'low_rerank_score=' || printf('%.2f', top) ELSE '' END AS reason FROM benchmark LEFT JOIN (SELECT query_id, max(rerank_score) AS top FROM hits GROUP BY query_id) ON query_id = item_id"


@query("pre_gate", f"WITH {HYBRID} {GATE}")
def pre_gate(spark, d):
    return guard.pre_gate(_questions(spark, d), _hits(spark, d))


WORDS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}')), lambda w: NOT list_contains({stop}, w))"
NUMS = r"list_filter(list_distinct(list_transform(regexp_extract_all({x}, '\$?\d+(?:[.,]\d+)*\s*%?'), lambda n: regexp_replace(regexp_replace(regexp_replace(translate(n, '$, ', ''), '\s+', '', 'g'), '%+$', ''), '\.+$', ''))), lambda n: n <> '')"
GROUND = f"""{CONTEXT},
answers AS (SELECT item_id AS query_id, text AS answer, context, {WORDS.format(x='text', stop=in_list(lx.STOP_WORDS))} AS aw, {WORDS.format(x='context', stop=in_list(lx.STOP_WORDS))} AS cw, {NUMS.format(x='text')} AS an, {NUMS.format(x='lower(context)')} AS cn FROM benchmark JOIN context ON query_id = item_id),
judged AS (SELECT query_id, answer, list_sort(list_filter(an, lambda n: NOT list_contains(['0', '1', '2', '3'], n) AND NOT list_contains(cn, n))) AS missing, CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw)) / len(aw)::DOUBLE END AS ratio FROM answers)"""


def _answers(spark, d):
    """The benchmark passage stands for the generated answer, retrieval for its context."""
    return _questions(spark, d).withColumnRenamed("text", "answer").join(guard.build_context(_texts_of_hits(spark, d)), "query_id")


@query("overlap_ratio", f"WITH {GROUND} SELECT query_id, round(ratio, 6) AS ratio FROM judged")
def overlap_ratio(spark, d):
    return _answers(spark, d).select("query_id", F.round(guard.overlap_ratio(F.col("answer"), F.col("context")), 6).alias("ratio"))


@query("grounding_gate", f"WITH {GROUND} SELECT query_id, len(missing) = 0 AND coalesce(ratio >= 0.4, true) AS passes, CASE WHEN len(missing) > 0 THEN 'ungrounded_numbers=[''' || array_to_string(missing, ''', ''') || ''']' WHEN ratio < 0.4 THEN 'low_overlap=' || printf('%.2f', ratio) ELSE '' END AS why FROM judged")
def grounding_gate(spark, d):
    passes, why = guard.grounding(F.col("answer"), F.col("context"), F.lit("en"))
    return _answers(spark, d).select("query_id", passes.alias("passes"), why.alias("why"))


DECIDED = f"""{GROUND}, gate AS ({GATE}),
decided AS (SELECT query_id, abstain OR NOT passes AS abstained, CASE WHEN abstain THEN reason WHEN NOT passes THEN 'post_gate:' || why ELSE '' END AS reason, CASE WHEN abstain OR NOT passes THEN '{lx.ABSTAIN['en'].replace("'", "''")}' ELSE answer END AS text, NOT (abstain OR NOT passes) AS cacheable
    FROM gate JOIN (SELECT query_id, answer, len(missing) = 0 AND coalesce(ratio >= 0.4, true) AS passes, CASE WHEN len(missing) > 0 THEN 'ungrounded_numbers=[''' || array_to_string(missing, ''', ''') || ''']' WHEN ratio < 0.4 THEN 'low_overlap=' || printf('%.2f', ratio) ELSE '' END AS why FROM judged) USING (query_id))"""


def _decided(spark, d):
    passes, why = guard.grounding(F.col("raw"), F.col("context"), F.col("language"))
    gate = guard.pre_gate(_questions(spark, d), _hits(spark, d)).withColumnRenamed("reason", "pre_reason")
    joined = _answers(spark, d).withColumnRenamed("answer", "raw").withColumn("language", F.lit("en")).join(gate, "query_id")
    return guard.decide(joined.withColumns({"passes": passes, "why": why}))


@query("answer_decision", f"WITH {DECIDED} SELECT query_id, abstained, reason, text FROM decided")
def answer_decision(spark, d):
    return _decided(spark, d).select("query_id", "abstained", "reason", "text")


@query("cache_admit", f"WITH {DECIDED} SELECT query_id, text FROM decided WHERE cacheable")
def cache_admit(spark, d):
    return memory.admit(_decided(spark, d).withColumn("cached", F.lit(False))).select("query_id", "text")


# The label of a vector serves as its language; the vectors of the first label rows are the cache.
CACHE = """cache AS (SELECT 'k' || vec_id::VARCHAR AS key, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, vec_id AS t FROM embeddings JOIN benchmark ON vec_id = item_id)"""


@query("cache_lookup", f"""WITH {CACHE}, sims AS (SELECT q.vec_id AS query_id, key, t, round(list_inner_product(q.e, v) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v, v)) + 1e-9::DOUBLE), 6) AS sim FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) q LEFT JOIN cache USING (label)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, t, key) AS rn FROM sims) SELECT query_id, CASE WHEN sim >= 0.94 THEN key END AS hit_key, CASE WHEN sim >= 0.94 THEN sim END AS sim FROM top WHERE rn = 1""")
def cache_lookup(spark, d):
    vectors = table(spark, d, "embeddings")
    cache = vectors.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vec"), F.col("label").alias("lang"), F.col("vec_id").alias("last_access"))
    return memory.cache_lookup(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.col("label").alias("lang")), cache)


@query("cache_evict", f"SELECT key, last_access FROM (SELECT key, max(doc_id) AS last_access FROM (SELECT doc_id, lower({strip('text')}) AS key FROM documents) GROUP BY key) ORDER BY last_access DESC, key LIMIT 256")
def cache_evict(spark, d):
    docs = table(spark, d, "documents").select(F.col("text").alias("question"), F.col("doc_id").alias("last_access"))
    return memory.cache_put(docs).select("key", "last_access")


# Vectors asked one after the other, from an empty cache of 64 entries; their similarities are lower than those of real questions, and so is the threshold.
@query("cache_order", """WITH RECURSIVE q AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
near AS (SELECT n, list({'id': id, 'sim': sim}) AS c FROM (SELECT b.n, a.vec_id AS id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)) + 1e-9::DOUBLE), 6) AS sim FROM q a JOIN q b ON a.label = b.label AND a.n < b.n) WHERE sim >= 0.3 GROUP BY n),
steps AS (SELECT q.n, vec_id, coalesce(c, []) AS c FROM q LEFT JOIN near USING (n)),
run AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS query_id, []::BIGINT[] AS held, NULL::BIGINT AS hit, NULL::DOUBLE AS sim
    UNION ALL SELECT n, vec_id, CASE WHEN best IS NULL THEN list_append(held, vec_id)[-64:] ELSE list_append(list_filter(held, lambda x: x <> best.id), best.id) END, best.id, best.sim
    FROM (SELECT s.n, s.vec_id, r.held, list_sort(list_transform(list_filter(c, lambda x: list_contains(held, x.id)), lambda x: {'far': -x.sim, 'place': list_position(held, x.id), 'id': x.id, 'sim': x.sim}))[1] AS best FROM run r JOIN steps s ON s.n = r.n + 1))
SELECT query_id, hit AS hit_source, sim, hit IS NULL AS stored FROM run WHERE n > 0""")
def cache_order_query(spark, d):
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("lang"), F.lit(True).alias("cacheable"))
    return cache_order.cache_replay(asked, None, size=64, threshold=0.3).decisions.drop("hit_key")


@query("sparse_dot", "WITH m AS (SELECT l_orderkey, l_partkey % 50 AS k, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT a.l_orderkey AS id, round(coalesce(sum(a.w * b.w), 0), 4) AS score FROM m a LEFT JOIN m b ON b.l_orderkey = a.l_orderkey + 1 AND a.k = b.k GROUP BY a.l_orderkey HAVING a.l_orderkey + 1 IN (SELECT l_orderkey FROM lineitem)")
def sparse_dot(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 50).cast("string").alias("k")).agg(F.sum("l_quantity").alias("w"))
    maps = m.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    other = maps.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("m").alias("m2"))
    return maps.join(other, "l_orderkey").select(F.col("l_orderkey").alias("id"), F.round(retrieve.sparse_dot(F.col("m"), F.col("m2")), 4).alias("score"))
