"""Blocks become chunks that carry their context: grouping, packing, sentence windows, facets and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import lexicon as lx
from quarry.functions import text as tx
from quarry.functions.frame import once
from quarry.operators.packing import scan_pieces
from quarry.sources.folders import ensure_checkpoint_dir

HEAD = ["section_no", "section_title", "subsection_no", "subsection_title", "page"]
RUN = ["doc_id", "group_no"]


def context_header(section_no: Column, section_title: Column, subsection_no: Column, subsection_title: Column) -> Column:
    """`Section n: title > subtitle`, or the default header."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    section = F.when(~blank(section_no), F.concat(F.lit("Section "), section_no, F.lit(": "), F.coalesce(section_title, F.lit(""))))
    named = F.concat_ws(" > ", section, F.when(~blank(subsection_no), subsection_title))
    return F.when(blank(section_no) & blank(subsection_no), F.lit(lx.DEFAULT_HEADER)).otherwise(named)


def run_groups(blocks: DataFrame) -> DataFrame:
    """Adds `group_no`: runs of blocks with equal section and subsection; a key that comes back begins a new run."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    same = (F.lag("section_no").over(w) == F.col("section_no")) & (F.lag("subsection_no").over(w) == F.col("subsection_no"))
    return blocks.withColumn("group_no", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w).cast("long"))


def atomic_chunks(grouped: DataFrame) -> DataFrame:
    """FAQ pairs and table rows pass as they are."""
    return grouped.filter(F.col("kind").isin("faq", "table_row")).select("doc_id", "group_no", F.lit(0).alias("class"), "block_no", F.col("block_no").alias("seq"), "kind", "text", "question", "row_subject")


def _ordered_texts(grouped: DataFrame, kind: str) -> DataFrame:
    listed = grouped.filter(F.col("kind") == kind).groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(F.struct(F.col("block_no").alias("place"), "text"))).alias("items"))  # a run of one section of one document
    return listed


def bullet_chunks(grouped: DataFrame, target: int = DEFAULTS.chunk_target_tokens) -> DataFrame:
    """Bullets of a run packed into lists (kind `bullets`)."""
    packed = _ordered_texts(grouped, "bullet").select("doc_id", "group_no", F.posexplode(tx.pack_bullets(F.col("items"), target)).alias("seq", "p"))
    return packed.select("doc_id", "group_no", F.lit(1).alias("class"), F.col("p.place").alias("block_no"), F.col("seq").cast("long").alias("seq"), F.lit("bullets").alias("kind"), F.col("p.text").alias("text"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("row_subject"))


def prose_chunks(grouped: DataFrame, target: int = DEFAULTS.chunk_target_tokens, overlap: int = DEFAULTS.chunk_overlap_sentences) -> DataFrame:
    """Prose of a run in overlapping windows of sentences."""
    joined = _ordered_texts(grouped, "prose").withColumn("all", tx.strip(F.array_join(F.transform("items", lambda i: i["text"]), " ")))
    windows = joined.select("doc_id", "group_no", F.posexplode(tx.sentence_windows(F.col("all"), target, overlap)).alias("seq", "text"))
    return windows.select("doc_id", "group_no", F.lit(2).alias("class"), F.lit(None).cast("long").alias("block_no"), F.col("seq").cast("long").alias("seq"), F.lit("prose").alias("kind"), "text", F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("row_subject"))


def build_chunks(blocks: DataFrame, target: int = DEFAULTS.chunk_target_tokens, overlap: int = DEFAULTS.chunk_overlap_sentences, least: int = DEFAULTS.chunk_min_tokens, prefix: str = "chunk", long_run: int = 4096) -> DataFrame:
    """All chunks of the documents: atomic rows, then bullets, then prose of each run; ids name the document and count within it.

    Runs of at most `long_run` blocks are folded each in a row of its own, longer ones are packed on rows, whatever their length; both
    give the same chunks. The grouped blocks are stored once, unless all runs are packed: these are read once, and numbered in the same pass.
    """
    if long_run <= 0:
        return link_chunks(describe_chunks(packed_runs(run_groups(blocks), target, overlap, least), prefix))
    ensure_checkpoint_dir(blocks.sparkSession)
    grouped = run_groups(blocks).checkpoint()
    long = grouped.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_run).select(*RUN).checkpoint()
    if long.isEmpty():
        placed = folded_runs(grouped, target, overlap)
    else:
        placed = folded_runs(grouped.join(long, RUN, "left_anti"), target, overlap).unionByName(packed_runs(grouped.join(long, RUN, "left_semi"), target, overlap).drop("raw_text", "chunk_id"))
    placed = once(placed, {"raw_text": tx.strip(F.col("text"))})
    kept = placed.filter((F.col("raw_text") != "") & (tx.est_tokens(F.col("raw_text")) >= least))
    return link_chunks(describe_chunks(kept.withColumn("chunk_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no", "class", "seq")) - 1).cast("long")), prefix))


def packed_runs(grouped: DataFrame, target: int, overlap: int, least: int = 0) -> DataFrame:
    """The pieces of runs of any length, as `folded_runs` gives them, with `raw_text` and `chunk_id`; no run is held in a row.

    One pass over the blocks in order of document, run, class and place. Pieces without text or of fewer than `least` tokens are
    left out; chunk_id counts the others of a document, where all its runs are given and lie in one partition, as run_groups leaves them.
    """
    first = F.when(F.row_number().over(Window.partitionBy(*RUN).orderBy("block_no")) == 1, F.lit(-1))
    klass = F.when(F.col("kind").isin("faq", "table_row"), 0).when(F.col("kind") == "bullet", 1).when(F.col("kind") == "prose", 2)
    rows = grouped.withColumn("_first", first).withColumn("class", F.explode(F.array_compact(F.array("_first", klass))))
    columns = [*RUN, "class", "kind", "text", "question", "row_subject", *HEAD]
    ordered = rows.sortWithinPartitions(*RUN, "class", "block_no").select(columns)
    kinds = dict(ordered.dtypes)
    made = {c: kinds.get(c, "long") for c in [*RUN, "class", "seq", "kind", "text", "question", "row_subject", *HEAD]} | {"raw_text": "string", "chunk_id": "long"}
    return ordered.mapInArrow(lambda batches: scan_pieces(batches, target, overlap, least), ", ".join(f"{c} {t}" for c, t in made.items()))


def folded_runs(grouped: DataFrame, target: int, overlap: int) -> DataFrame:
    """The pieces of each run, folded in one row: RUN, class, seq, kind, text, question, row_subject and the head."""
    runs = grouped.groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "kind", "text", "question", "row_subject", *HEAD))).alias("items"))  # a run of one section of one document
    items, none = F.col("items"), F.lit(None).cast("string")

    def piece(klass: int, seq: Column, kind: Column, text: Column, question: Column, subject: Column, at: Column) -> Column:
        return F.struct(F.lit(klass).alias("class"), seq.cast("long").alias("seq"), kind.alias("kind"), text.alias("text"), question.alias("question"), subject.alias("row_subject"), *[at[h].alias(h) for h in HEAD])

    of = lambda *kinds: F.filter(items, lambda b: b["kind"].isin(*kinds))
    atomic = F.transform(of("faq", "table_row"), lambda b: piece(0, b["block_no"], b["kind"], b["text"], b["question"], b["row_subject"], b))
    placed_items = F.transform(items, lambda b, i: F.struct(i.alias("place"), b["text"].alias("text"), b["kind"].alias("kind")))
    packed = tx.pack_bullets(F.filter(placed_items, lambda b: b["kind"] == "bullet"), target)
    bullets = F.transform(packed, lambda p, i: piece(1, i, F.lit("bullets"), p["text"], none, none, F.get(items, F.coalesce(p["place"].cast("int"), F.lit(0)))))
    prose_text = tx.strip(F.array_join(F.transform(of("prose"), lambda b: b["text"]), " "))
    prose = F.transform(tx.sentence_windows(prose_text, target, overlap), lambda t, i: piece(2, i, F.lit("prose"), t, none, none, F.get(items, F.lit(0))))
    return runs.select(*RUN, F.explode(F.concat(atomic, bullets, prose)).alias("p")).select(*RUN, "p.*")


def describe_chunks(rows: DataFrame, prefix: str = "chunk") -> DataFrame:
    """Adds id, header, embedded text and facets; fills absent section names."""
    text = F.col("raw_text")
    out = rows.withColumn("header", context_header(F.col("section_no"), F.col("section_title"), F.col("subsection_no"), F.col("subsection_title")))
    facets = {"amounts": tx.amounts(text), "percentages": tx.percentages(text), "durations": tx.durations(text), "tiers": tx.tiers(text)}
    filled = lambda c, default: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default))
    out = out.withColumns({k: F.array_join(v, " | ") for k, v in facets.items()})
    return out.select(
        "doc_id", F.concat(F.lit(f"{prefix}-"), F.col("doc_id").cast("string"), F.format_string("-%04d", "chunk_id")).alias("id"), "chunk_id", "kind",
        F.concat(F.lit("["), "header", F.lit("]\n"), "raw_text").alias("text"), "raw_text", filled("section_no", "0").alias("section_no"), filled("section_title", "General").alias("section_title"),
        filled("subsection_no", "").alias("subsection_no"), filled("subsection_title", "").alias("subsection_title"), "page", "header", tx.est_tokens(text).alias("n_tokens"),
        "amounts", "percentages", "durations", "tiers", ((F.col("amounts") != "") | (F.col("percentages") != "")).alias("has_numbers"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("row_subject", F.lit("")).alias("row_subject"),
    )


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Adds prev_id and next_id; '' at the ends."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    return chunks.withColumns({"prev_id": F.lag("id", 1, "").over(w), "next_id": F.lead("id", 1, "").over(w)})


def count_kinds(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def ingest_report(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of blocks and the least, mean (floored) and most tokens of chunks, in one row."""
    b = blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("kind") == "table_row").alias("n_table_rows"), F.count_if(F.col("kind") == "faq").alias("n_faq"))
    c = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.min("n_tokens").alias("min_tokens"), F.floor(F.sum("n_tokens") / F.count(F.lit(1))).alias("avg_tokens"), F.max("n_tokens").alias("max_tokens"))
    return b.crossJoin(c)  # one row each


def ingest_preview(chunks: DataFrame, n: int = 3, width: int = 240) -> DataFrame:
    """The first chunks with the beginning of their text."""
    return chunks.orderBy("doc_id", "chunk_id").limit(n).select("doc_id", "id", "kind", "header", F.substring("raw_text", 1, width).alias("preview"))
