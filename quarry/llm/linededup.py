"""Line dedup by a deletion-neighbourhood join, on DataFrame functions alone.

A line goes if an earlier line of the corpus is equal to it or within one word of it (a word put in, left out or
changed). Order is (doc_id, hash of the text, line number). Lines of fewer than `MIN_WORDS` words are compared for equality only.

1. Equal lines are collapsed under a 64-bit hash, the earliest kept (partial aggregation takes hot lines); a second hash
   confirms each copy. Texts do not move in this step.
2. Pigeonhole: two lines within one word share their first or their last half, so each line emits the hashes of its
   halves; only lines with a shared half go on, for the other side. This loses no pair.
3. The texts of those lines are fetched from their documents. They emit every variant within the bound as a hashed key: the line without word i, and the line itself,
   both with the place i. Equal keys mean lines within one word of each other, so the least line of a key stands for
   all others: keys are aggregated to it, and members join it, which needs no pairs within a key.
4. Each pair (line, earlier line) is verified on the words.

Variants hash blocks of `BLOCK` words beside the hashes of what lies before and after, so that long lines cost little
more for each word than short ones.

Edge cases: lines are compared after trimming blanks; blank lines are never duplicates and stay; a null text stays
null, and a text whose lines all go becomes ''; equal rows count as one and stay equal; rows that share a doc_id but
not a text are rows of their own, told apart by a hash of the text; a null doc_id sorts first; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir, table, unused, written

MIN_WORDS = 5
BLOCK = 64
#: Lines up to which a variant hashes all before and all after its place; longer ones go by blocks.
SHORT = 512
#: Candidate lines up to which their numbers are broadcast to the scan (about 30 bytes each); beyond it the texts are shuffled.
BROADCAST_LINES = 400_000


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _words(line: Column) -> Column:
    return F.split(line, " ", -1)


def _joined(words: Column, start, count) -> Column:
    """Words from a 0-based start."""
    return F.array_join(F.slice(words, start + 1, count), " ")


def text_number(text: Column) -> Column:
    """A number of 60 bits that tells texts apart, as SQL can make it too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def document_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_id, _th (text_number), _line (number from 0), _text (trimmed, never blank), _h1, _h2."""
    rows = df.select(F.col(id_column).alias("_id"), text_number(F.col(text_column)).alias("_th"), F.col(text_column).alias("_whole"))  # hashed before lines are taken apart
    lines = rows.select("_id", "_th", F.posexplode(F.split("_whole", "\n", -1)).alias("_line", "_text"))
    return lines.withColumn("_text", F.trim("_text")).filter(F.length("_text") > 0).withColumns({"_h1": _hash(F.col("_text")), "_h2": _hash(F.lit("second"), F.col("_text"))})


def _half_hashes() -> list[Column]:
    """Hashes of the left and right half of `_text`, for the line as the shorter (common length m) and the longer one (m - 1)."""
    n, out = F.col("_n"), []
    for c in (n, n - 1):
        cut = F.floor(c / F.lit(2)).cast("int")
        out.append(_hash(c, F.lit("l"), F.call_function("substring_index", F.col("_text"), F.lit(" "), cut)))
        out.append(_hash(c, F.lit("r"), F.call_function("substring_index", F.col("_text"), F.lit(" "), cut - c)))
    return out


def _variant_keys() -> Column:
    """Hashes of the line without word i, and of the line itself, each with its place i, between `_from` and `_to`."""
    w, n = F.col("_w"), F.size("_w")
    blocks = F.sequence(F.lit(0), F.floor(n / F.lit(BLOCK)).cast("int"))
    before = F.transform(blocks, lambda j: _hash(_joined(w, F.lit(0), j * BLOCK)))
    after = F.transform(blocks, lambda j: _hash(F.lit("a"), _joined(w, F.least((j + 1) * BLOCK, n), n)))
    after_gap = F.transform(blocks, lambda j: _hash(F.lit("a"), _joined(w, F.least((j + 1) * BLOCK + 1, n), n)))
    none = F.expr("array()").cast("array<bigint>")
    with_parts = F.struct(before.alias("before"), after.alias("after"), after_gap.alias("after_gap"))

    def without(p: Column, i: Column) -> Column:
        j = F.floor(i / F.lit(BLOCK)).cast("int")
        rest = F.concat(F.slice(w, j * BLOCK + 1, i - j * BLOCK), F.slice(w, i + 2, (j + 1) * BLOCK - i))
        return _hash(i, n - 1, F.get(p["before"], j), F.array_join(rest, " "), F.get(p["after_gap"], j))

    def whole(p: Column, i: Column) -> Column:
        j = F.floor(i / F.lit(BLOCK)).cast("int")
        return _hash(i, n, F.get(p["before"], j), _joined(w, j * BLOCK, F.lit(BLOCK)), F.get(p["after"], j))

    def places(last: Column, key) -> Column:
        end = F.least(F.col("_to"), last)
        return F.when(F.col("_from") <= end, F.transform(F.sequence(F.col("_from"), end), key)).otherwise(none)

    def cut(count: Column) -> Column:
        return F.call_function("substring_index", F.col("_t"), F.lit(" "), count)

    short = F.concat(places(n - 1, lambda i: _hash(i, n - 1, cut(i), cut(i + 1 - n))), places(n, lambda i: _hash(i, n, cut(i), cut(i - n))))
    blocked = F.flatten(F.transform(F.array(with_parts), lambda p: F.concat(places(n - 1, lambda i: without(p, i)), places(n, lambda i: whole(p, i)))))
    # lines within one word of each other may lie on both sides of the bound: those at it do both
    return F.when(n < SHORT, short).when(n > SHORT, blocked).otherwise(F.concat(short, blocked))


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two arrays of words are one edit apart at most."""
    n, m = F.size(a), F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: ~F.coalesce(same, F.lit(False))))

    def inserted(long: Column, short: Column) -> Column:
        size = F.size(short)
        same = F.coalesce(F.array_position(F.zip_with(F.slice(long, 1, size), short, lambda x, y: x == y), F.lit(False)), F.lit(0)).cast("int")
        at = F.when(same == 0, size).otherwise(same - 1)
        return F.slice(long, at + 2, size) == F.slice(short, at + 1, size)

    return F.when(n == m, differ <= 1).when(n == m + 1, inserted(a, b)).when(m == n + 1, inserted(b, a)).otherwise(F.lit(False))


def near_lines(df: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """_h1 of the lines that have an earlier line within one word."""
    worded = classes.filter(F.col("_f._n") >= min_words)
    sides = F.array(*[F.struct(F.lit(k % 2 == 0).alias("left"), F.col(f"_f._k{k}").alias("key")) for k in range(4)])
    halves = worded.select("_h1", F.explode(sides).alias("_k")).select("_h1", "_k.left", "_k.key")
    shared = halves.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("key")
    found = halves.join(shared, "key", "left_semi").groupBy("_h1").agg(F.max("left").alias("_l"), F.min("left").alias("_r"))
    likely = written(worded.join(found, "_h1").select(F.col("_f._id").alias("_want"), F.col("_f._th").alias("_want_th"), "_f._line", "_l", "_r"), "likely")
    few = likely.count() <= BROADCAST_LINES
    by_doc = likely.groupBy("_want", "_want_th").agg(F.collect_list(F.struct("_line", "_l", "_r")).alias("_lines"))  # at most the lines of a document
    texts = df.select(F.col(id_column).alias("_id"), text_number(F.col(text_column)).alias("_th"), F.col(text_column).alias("_text"))
    texts = texts.join(F.broadcast(by_doc) if few else by_doc, F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_th") == F.col("_want_th")))
    lines = texts.select("_id", "_th", F.split("_text", "\n", -1).alias("_all"), "_lines").select("_id", "_th", F.explode(F.transform("_lines", lambda s: F.struct(s["_line"].alias("_line"), s["_l"].alias("_l"), s["_r"].alias("_r"), F.trim(F.get("_all", s["_line"])).alias("_t")))).alias("_s"))
    lines = written(lines.select("_id", "_th", "_s._line", "_s._l", "_s._r", "_s._t").dropDuplicates(["_id", "_th", "_line"]), "lines").withColumn("_w", _words(F.col("_t")))
    n = F.size("_w")
    lines = lines.withColumns({"_from": F.when(~F.col("_r"), F.lit(0)).otherwise(F.greatest(F.floor((n - 1) / F.lit(2)).cast("int"), F.lit(0))), "_to": F.when(F.col("_l"), n).otherwise(F.floor(n / F.lit(2)).cast("int") + 1)})
    variants = lines.select(F.struct("_id", "_th", "_line").alias("_at"), F.explode(_variant_keys()).alias("_key"))
    leads = variants.groupBy("_key").agg(F.min("_at").alias("_lead"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    pairs = variants.join(leads, "_key").filter(F.col("_lead") < F.col("_at")).select("_at", "_lead").distinct()
    words = lines.select(F.struct("_id", "_th", "_line").alias("_at"), F.col("_t").alias("_w"))
    checked = pairs.join(words, "_at").join(words.select(F.col("_at").alias("_lead"), F.col("_w").alias("_w2")), "_lead")
    return checked.filter(within_one_word(_words(F.col("_w")), _words(F.col("_w2")))).select(_hash(F.col("_w")).alias("_h1")).distinct()


def dropped_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th, _dropped: the numbers of the lines that go, ascending, for documents that lose any."""
    ensure_checkpoint_dir(df.sparkSession)
    lines = document_lines(df, id_column, text_column)
    keyed = lines.withColumn("_n", F.length("_text") - F.length(F.replace("_text", F.lit(" "), F.lit(""))) + 1)
    keyed = keyed.select("_h1", "_h2", "_id", "_th", "_line", "_n", *[k.alias(f"_k{i}") for i, k in enumerate(_half_hashes())])
    classes = keyed.groupBy("_h1").agg(F.min(F.struct("_id", "_th", "_line", "_h2", "_n", "_k0", "_k1", "_k2", "_k3")).alias("_f"))
    near = near_lines(df, classes, id_column, text_column, min_words).withColumn("_near", F.lit(True))
    firsts = lines.groupBy("_h1").agg(F.min(F.struct("_id", "_th", "_line", "_h2")).alias("_f"))  # anew, as halves cost more than the scan
    verdicts = firsts.join(near, "_h1", "left").select("_h1", F.col("_f._h2").alias("_f2"), F.struct("_f._id", "_f._th", "_f._line").alias("_first"), F.coalesce("_near", F.lit(False)).alias("_near"))
    gone = lines.drop("_text").join(verdicts, "_h1").filter((F.col("_h2") == F.col("_f2")) & (F.col("_near") | ~F.struct("_id", "_th", "_line").eqNullSafe(F.col("_first"))))
    return gone.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("_line")).alias("_dropped"))


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """`df` with duplicate lines taken out of its texts; with `counts`, also `n_lines` and `n_dropped`."""
    other, own, th, dropped, split = (unused(df, f"__ld_{n}") for n in ("id", "own", "th", "dropped", "lines"))
    gone = dropped_lines(df, id_column, text_column, min_words).select(F.col("_id").alias(other), F.col("_th").alias(th), F.col("_dropped").alias(dropped))
    joined = df.withColumn(own, text_number(F.col(text_column))).join(gone, F.col(id_column).eqNullSafe(F.col(other)) & (F.col(own) == F.col(th)), "left").drop(other, th, own)
    lines = F.split(F.col(text_column), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
    joined = joined.withColumn(split, F.when(F.col(dropped).isNotNull(), lines))  # split once, not for each line
    text = F.when(F.col(dropped).isNull(), F.col(text_column)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    added = {"n_lines": F.coalesce(F.when(F.col(dropped).isNotNull(), F.size(split)).otherwise(F.size(lines)), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long")} if counts else {}
    return joined.select(*[c for c in df.columns if c not in (text_column, *added)], *[v.alias(k) for k, v in added.items()], text.alias(text_column)).select(*[c for c in df.columns if c not in added], *added)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def dedup_ctes(docs: str, prefix: str = "l_") -> str:
    """CTEs that end in {prefix}texts (doc_id, n_lines, n_dropped, text)."""
    p = prefix
    return f"""{p}rows AS (SELECT row_number() OVER () AS rid, doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS th, text FROM {docs}),
{p}split AS (SELECT rid, doc_id, th, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM {p}rows),
{p}lines AS (SELECT rid, doc_id, th, line, raw, trim(raw, ' ') AS norm FROM {p}split),
{p}classes AS (SELECT norm, min((doc_id, th, line)) AS first FROM {p}lines WHERE norm <> '' GROUP BY norm),
{p}worded AS (SELECT norm, first, string_split(norm, ' ') AS w FROM {p}classes WHERE len(string_split(norm, ' ')) >= {MIN_WORDS}),
{p}variants AS (
    SELECT norm, first, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS v FROM (SELECT *, unnest(range(0, len(w))) AS i FROM {p}worded)
    UNION ALL SELECT norm, first, i, norm AS v FROM (SELECT *, unnest(range(0, len(w) + 1)) AS i FROM {p}worded)),
{p}leads AS (SELECT i, v, min(first) AS lead FROM {p}variants GROUP BY i, v HAVING count(*) > 1),
{p}near AS (SELECT DISTINCT a.norm FROM {p}variants a JOIN {p}leads b USING (i, v) WHERE b.lead < a.first),
{p}marked AS (SELECT l.rid, l.line, l.raw, l.norm <> '' AND ((l.doc_id, l.th, l.line) <> c.first OR n.norm IS NOT NULL) AS gone
    FROM {p}lines l LEFT JOIN {p}classes c ON l.norm = c.norm LEFT JOIN {p}near n ON l.norm = n.norm),
{p}found AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT coalesce(gone, false)), '') AS text FROM {p}marked GROUP BY rid),
{p}texts AS (SELECT r.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, f.text FROM {p}rows r LEFT JOIN {p}found f USING (rid))"""


OP8_SQL = f"WITH {dedup_ctes('documents')}\nSELECT doc_id, n_lines, n_dropped, length(text) AS n_chars_kept, md5(text) AS kept_md5 FROM l_texts"
