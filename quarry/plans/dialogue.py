"""Queries over conversations and phrases: understanding, memory, speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import text as tx
from quarry.operators import guard, memory, nlu, speech
from quarry.plans import kb
from quarry.plans.registry import derived, in_list, parts, query, quoted, strip
from quarry.plans.texts import HITS, LANGUAGE

PHR = f"p AS ({kb.PHRASES})"
TURNS = f"t AS ({kb.TURNS})"
ROUTE = "CASE " + " ".join(f"WHEN regexp_matches({strip('text')}, {quoted('(?i)' + pattern)}) THEN '{kind}'" for kind, pattern in lx.ROUTES) + " END"
TOK = "regexp_extract_all(lower({x}), '[a-zA-Z'']+')"
FOLLOW = "(" + " OR ".join(f"starts_with(lower({strip('{x}')}), {quoted(s)})" for s in lx.FOLLOWUP_STARTERS) + f" OR (len({TOK}) BETWEEN 1 AND 6 AND len(list_intersect({TOK}, {in_list(lx.PRONOUNS)})) > 0))"


def _phrases(spark, d):
    return derived(spark, d, kb.PHRASES, {"customer": "c_custkey"})


def _turns(spark, d):
    return derived(spark, d, kb.TURNS)


@query("phrase_language", f"WITH {PHR} SELECT id, n, {LANGUAGE.format(x='text', h=HITS)} AS language FROM (SELECT *, {TOK.format(x='text')} AS t FROM p)")
def phrase_language(spark, d):
    return _phrases(spark, d).select("id", "n", nlu.detect_language(F.col("text")).alias("language"))


@query("route", f"WITH {PHR} SELECT id, n, {ROUTE} AS kind FROM p")
def route(spark, d):
    return _phrases(spark, d).select("id", "n", nlu.route(F.col("text")).alias("kind"))


_REPLY = "CASE " + " ".join(f"WHEN kind = '{k}' AND lang = '{lang}' THEN {quoted(r)}" for k, lang, r in lx.REPLIES) + " " + " ".join(f"WHEN kind = '{k}' THEN {quoted(r)}" for k, lang, r in lx.REPLIES if lang == "en") + " END"


@query("route_reply", f"WITH {PHR} SELECT id, n, {_REPLY} AS reply FROM (SELECT *, {ROUTE} AS kind FROM p)")
def route_reply(spark, d):
    return nlu.route_reply(_phrases(spark, d).withColumn("kind", nlu.route(F.col("text"))), "kind", "lang").select("id", "n", "reply")


@query("needs_rewrite", f"WITH {PHR}, {TURNS} SELECT id, n, {FOLLOW.format(x='text')} AS follow_up FROM p UNION ALL SELECT session_id, 1000 + seq, {FOLLOW.format(x='question')} FROM t")
def needs_rewrite(spark, d):
    turns = _turns(spark, d).select(F.col("session_id").alias("id"), (F.col("seq") + 1000).alias("n"), nlu.needs_rewrite(F.col("question")).alias("follow_up"))
    return _phrases(spark, d).select("id", F.col("n").cast("long").alias("n"), nlu.needs_rewrite(F.col("text")).alias("follow_up")).unionByName(turns)


@query("rewrite_fallback", f"""WITH {PHR} SELECT id, n, CASE WHEN h <> '' AND {FOLLOW.format(x='text')} AND prop <> '' THEN prop ELSE text END AS standalone FROM (
    SELECT *, CASE WHEN n % 2 = 0 THEN 'Customer: hi' ELSE '' END AS h, CASE WHEN n % 3 = 0 THEN '' ELSE 'about ' || lang END AS prop FROM p)""")
def rewrite_fallback(spark, d):
    history = F.when(F.col("n") % 2 == 0, "Customer: hi").otherwise("")
    proposed = F.when(F.col("n") % 3 == 0, ' "" ').otherwise(F.concat(F.lit(' "about '), "lang", F.lit('"')))
    return _phrases(spark, d).select("id", "n", nlu.rewritten(F.col("text"), history, proposed).alias("standalone"))


_EXTRA = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), {quoted(k)}) THEN {quoted(v)} END" for k, v in lx.SYNONYMS) + "], lambda x: x IS NOT NULL)"


@query("synonym_expand", f"WITH {PHR} SELECT id, n, CASE WHEN len(e) > 0 THEN text || ' ' || array_to_string(e, ' ') ELSE text END AS expanded FROM (SELECT *, {_EXTRA} AS e FROM p)")
def synonym_expand(spark, d):
    return _phrases(spark, d).select("id", "n", nlu.expand_query(F.col("text")).alias("expanded"))


def _spoken_sql(x: str) -> str:
    for pattern, spoken in lx.SPOKEN:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(spoken.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


@query("speakable", f"WITH {PHR} SELECT id, n, {_spoken_sql('text')} AS spoken FROM p")
def speakable(spark, d):
    return _phrases(spark, d).select("id", "n", tx.speakable(F.col("text")).alias("spoken"))


@query("tts_route", f"WITH {PHR} SELECT id, n, CASE WHEN lang = 'hinglish' THEN 'hinglish' ELSE 'english' END AS provider, CASE WHEN lang = 'hinglish' THEN substr(s, 1, 2500) ELSE s END AS text FROM (SELECT *, {_spoken_sql('text')} AS s FROM p)")
def tts_route(spark, d):
    return _phrases(spark, d).select("id", "n", speech.voice_request(F.col("text"), F.col("lang")).alias("r")).select("id", "n", "r.provider", "r.text")


@query("tts_degrade", rf"WITH {PHR} SELECT id, n, CASE WHEN {strip('text')} <> '' THEN octet_length(encode(text)) END AS n_bytes, CASE WHEN {strip('text')} = '' THEN 'ValueError: nothing to say' END AS error FROM p")
def tts_degrade(spark, d):
    def provider(text: str, language: str) -> bytes:
        if not text.strip():
            raise ValueError("nothing to say")
        return text.encode()

    return speech.synthesize(_phrases(spark, d), provider, "text", "lang").select("id", "n", F.length("audio.data").alias("n_bytes"), "audio.error")


_HINT = sorted(set(lx.PROMPT_HINT.lower().replace(".", "").split()))


@query("prompt_echo", rf"WITH {PHR} SELECT id, n, len(w) > 0 AND len(list_intersect(w, {in_list(_HINT)})) / greatest(len(w), 1)::DOUBLE > 0.6::DOUBLE AS echo FROM (SELECT *, list_distinct(list_filter(string_split_regex(translate(lower(text), '.,', ''), '\s+'), lambda x: x <> '')) AS w FROM p)")
def prompt_echo(spark, d):
    return _phrases(spark, d).select("id", "n", tx.prompt_echo(F.col("text")).alias("echo"))


_ABSTAIN = f"CASE WHEN lang = 'hinglish' THEN {quoted(lx.ABSTAIN['hinglish'])} ELSE {quoted(lx.ABSTAIN['en'])} END"


@query("abstain_text", f"WITH {PHR} SELECT id, n, {_ABSTAIN} AS refusal FROM p")
def abstain_text(spark, d):
    return _phrases(spark, d).select("id", "n", guard.abstain_text(F.col("lang")).alias("refusal"))


_TEMPLATE = quoted(guard.ANSWER_TEMPLATE)
_INSTRUCTION = f"CASE WHEN lang = 'hinglish' THEN {quoted(guard.LANGUAGE_INSTRUCTIONS['hinglish'])} ELSE {quoted(guard.LANGUAGE_INSTRUCTIONS['en'])} END"


@query("prompt_build", f"WITH {PHR} SELECT id, n, 'user' AS role, replace(replace(replace(replace({_TEMPLATE}, '{{language}}', {_INSTRUCTION}), '{{abstain}}', {_ABSTAIN}), '{{question}}', text), '{{context}}', 'ctx') AS content FROM p")
def prompt_build(spark, d):
    messages = guard.build_prompt(F.lit("ctx"), F.col("text"), F.col("lang"))
    return _phrases(spark, d).select("id", "n", messages[1].alias("m")).select("id", "n", "m.role", "m.content")


@query("memory_last6", f"WITH {TURNS} SELECT session_id, seq, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM t) WHERE rn <= 6")
def memory_last6(spark, d):
    return memory.last_turns(_turns(spark, d))


@query("memory_last2", f"WITH {TURNS} SELECT session_id, seq, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM t) WHERE rn <= 2")
def memory_last2(spark, d):
    return memory.last_turns(_turns(spark, d), 2)


_RECENT = "OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query("memory_recent", f"WITH {TURNS} SELECT session_id, seq, coalesce(list(question) {_RECENT}, []) AS questions FROM t")
def memory_recent(spark, d):
    return memory.recent_turns(_turns(spark, d)).select("session_id", "seq", F.transform("recent", lambda t: t["question"]).alias("questions"))


@query("memory_text", f"WITH {TURNS} SELECT session_id, seq, array_to_string(coalesce(list('Customer: ' || question || chr(10) || 'Assistant: ' || answer) {_RECENT}, []), chr(10)) AS history FROM t")
def memory_text(spark, d):
    return memory.recent_turns(_turns(spark, d)).select("session_id", "seq", memory.history_text(F.col("recent")).alias("history"))


@query("memory_clear", f"WITH {TURNS} SELECT session_id, seq FROM t WHERE session_id NOT IN (SELECT session_id FROM t GROUP BY session_id HAVING count(*) < 2)")
def memory_clear(spark, d):
    turns = _turns(spark, d)
    done = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 2")
    return memory.clear_sessions(turns, done).select("session_id", "seq")


@query("audio_timeline", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, floor(epoch(ts))::BIGINT % 1000 AS arrive, abs(value) AS duration FROM events),
tl AS (SELECT user_id, seq, arrive + 0.05::DOUBLE AS s, arrive + 0.05::DOUBLE + duration AS f FROM e WHERE seq = 1 UNION ALL
    SELECT e.user_id, e.seq, greatest(e.arrive + 0.05::DOUBLE, tl.f), greatest(e.arrive + 0.05::DOUBLE, tl.f) + e.duration FROM tl JOIN e ON e.user_id = tl.user_id AND e.seq = tl.seq + 1)
SELECT user_id, seq, round(s, 3) AS start_at, round(f, 3) AS end_at FROM tl""")
def audio_timeline(spark, d):
    from pyspark.sql import Window

    from quarry.plans.registry import table

    events = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), (F.unix_timestamp(F.col("ts").cast("timestamp")) % 1000).alias("arrive"), F.abs("value").alias("duration"))
    out = speech.audio_timeline(events, session="user_id")
    return out.select("user_id", "seq", F.round("start", 3).alias("start_at"), F.round("end", 3).alias("end_at"))


@query("stream_turns", f"WITH {TURNS} SELECT session_id, seq, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM t) WHERE rn <= 6")
def stream_turns(spark, d):
    """The memory kept by a stream of turns, read when the stream has run dry."""
    from quarry.streaming.memory import replay_turns

    return replay_turns(_turns(spark, d))


@query("stream_cut", """SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents)""")
def stream_cut(spark, d):
    """Sentences cut from streams of tokens, a document a session."""
    from quarry.plans.registry import table
    from quarry.streaming.sentences import replay_tokens

    tokens = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.posexplode(F.split("text", "(?<= )", -1)).alias("seq", "token"))
    out = replay_tokens(tokens.select("session_id", F.col("seq").cast("long").alias("seq"), "token"))
    return out.select(F.col("session_id").cast("long").alias("doc_id"), "pos", "sentence")


def _event(kind: str, text: str, grounded: str = "NULL", reason: str = "NULL") -> str:
    return f"{{'type': '{kind}', 'text': ({text})::VARCHAR, 'grounded': {grounded}::BOOLEAN, 'reason': {reason}::VARCHAR}}"


_TOKENS = "list_transform(string_split(replace(s, ' ', ' ' || chr(1)), chr(1)), lambda t: " + _event("token", "t") + ")"
_SAID = f"flatten(list_transform({parts('raw', '([.!?]) ', r"'\1' || chr(1)")}, lambda s: list_concat({_TOKENS}, [{_event('sentence', 's')}])))"
_EVENTS = f"""CASE WHEN kind IS NOT NULL THEN [{_event('meta', 'NULL')}, {_event('sentence', 'reply')}, {_event('done', 'reply', 'true', "'chitchat'")}]
    WHEN lang = 'xx' THEN [{_event('abstain', quoted(lx.ABSTAIN['en']))}] ELSE list_concat([{_event('meta', 'NULL')}], {_SAID}, [{_event('done', strip('raw'), 'true', "''")}]) END"""


@query("stream_events", f"""WITH {PHR}, asked AS (SELECT id::VARCHAR || '-' || n::VARCHAR AS session_id, lang, kind, {_REPLY} AS reply, text || ' First part. And the rest' AS raw FROM (SELECT *, {ROUTE} AS kind FROM p)),
listed AS (SELECT session_id, lang, {_EVENTS} AS l FROM asked), rows AS (SELECT session_id, lang, unnest(l) AS e, unnest(range(0, len(l))) AS seq FROM listed)
SELECT session_id, seq, e.type AS type, e.text AS text, lang AS language, e.grounded AS grounded, e.reason AS reason FROM rows""")
def stream_events(spark, d):
    from quarry.streaming.events import exchange_events

    phrases = _phrases(spark, d).select(F.concat_ws("-", "id", "n").alias("session_id"), F.col("text").alias("question"), F.col("lang").alias("language"))
    asked = phrases.withColumns({"kind": nlu.route(F.col("question")), "abstain": F.col("language") == "xx", "raw": F.concat(F.col("question"), F.lit(" First part. And the rest")), "passes": F.lit(True), "why": F.lit("")})
    return exchange_events(asked)


# Every user turn is a message of its conversation's connection, sent by a session that every fifth turn names; the turn is answered with itself.
_MESSAGES = """m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 's' || turn::VARCHAR END AS named, text FROM conversations WHERE role = 'user'),
requests AS (SELECT conv_id::VARCHAR AS connection_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) - 1 AS request, coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST ROWS UNBOUNDED PRECEDING), conv_id::VARCHAR) AS session_id, coalesce(text, '') AS text FROM m)"""


@query("stream_connection", f"""WITH {_MESSAGES}, asked AS (SELECT *, 'en' AS lang, {ROUTE} AS kind, {strip('text')} AS raw FROM requests),
replied AS (SELECT *, {_REPLY} AS reply FROM asked), listed AS (SELECT connection_id, request, session_id, lang, {_EVENTS} AS l FROM replied WHERE raw <> ''),
rows AS (SELECT connection_id, request, session_id, lang, unnest(l) AS e, unnest(range(0, len(l))) AS seq FROM listed)
SELECT connection_id, request, seq, session_id, e.type AS type, e.text AS text, lang AS language, e.grounded AS grounded, e.reason AS reason FROM rows
UNION ALL SELECT connection_id, request, 0, session_id, 'error', 'Empty question.', NULL, NULL, NULL FROM asked WHERE raw = ''""")
def stream_connection(spark, d):
    from quarry.plans.registry import table
    from quarry.sources.folders import scratch
    from quarry.streaming import connection

    base, none = scratch(spark, "connection"), F.lit(None)
    turns = table(spark, d, "conversations").filter("role = 'user'")
    messages = turns.select(F.col("conv_id").cast("string").alias("connection_id"), F.col("turn").cast("long").alias("arrived"), F.when(F.col("turn") % 5 == 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("session_id"), F.lit("question").alias("type"), "text", none.cast("string").alias("data"), none.cast("boolean").alias("audio_reply"))
    messages.repartition("connection_id").write.parquet(f"{base}/in")

    def answer(asked):
        return asked.withColumns({"language": F.lit("en"), "kind": nlu.route(F.col("question")), "abstain": F.lit(False), "raw": F.col("question"), "passes": F.lit(True), "why": F.lit("")})

    connection.serve_connections(spark.readStream.schema(connection.MESSAGE).parquet(f"{base}/in"), answer, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return connection.read_events(spark, f"{base}/out").drop("audio")
