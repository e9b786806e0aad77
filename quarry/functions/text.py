"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon as lx


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def tidy(x: Column) -> Column:
    """Whether cleaning would leave x as it is: ASCII without runs of blanks, other white space or blanks at its ends. Null is not."""
    bare = (F.length(x) == F.octet_length(x)) & (F.trim(x) == x) & ~F.contains(x, F.lit("  "))
    for c in "\t\n\x0b\f\r":
        bare = bare & ~F.contains(x, F.lit(c))
    return bare


def clean_text(x: Column) -> Column:
    """Typographic variants to plain ones, runs of blanks and tabs to one blank, trimmed."""
    return F.when(tidy(x), x).otherwise(_cleaned(x))


def joined_cells(cells: Column) -> Column:
    """The cells of a row in one text, on which `tidy_cells` tells whether any needs cleaning: a null is a tab, ends stand by bars."""
    return F.concat(F.lit("|"), F.array_join(cells, "|", "\t"), F.lit("|"))


def tidy_cells(joined: Column) -> Column:
    """Whether cleaning would leave all cells of a row as they are."""
    return tidy(joined) & ~F.contains(joined, F.lit("| ")) & ~F.contains(joined, F.lit(" |"))


def _cleaned(x: Column) -> Column:
    plain = F.translate(x, "\u00a0\u2019\u2018\u201c\u201d\u2013\u2014", " ''\"\"--")
    plain = F.replace(F.replace(plain, F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))
    return strip(F.regexp_replace(plain, r"[ \t]+", " "))


def est_tokens(x: Column) -> Column:
    """Cheap estimate of tokens: a token is 3.7 characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / F.expr("3.7D")).cast("int"))


def find_all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def distinct_sorted(values: Column, limit: int | None = None) -> Column:
    out = F.array_sort(F.array_distinct(values))
    return F.slice(out, 1, limit) if limit else out


def amounts(x: Column) -> Column:
    return distinct_sorted(find_all(x, lx.MONEY), 8)


def percentages(x: Column) -> Column:
    return distinct_sorted(find_all(x, lx.PERCENT), 8)


def durations(x: Column) -> Column:
    return distinct_sorted(F.transform(find_all(x, lx.DURATION), F.lower), 8)


def tiers(x: Column) -> Column:
    return distinct_sorted(F.transform(find_all(x, lx.TIER), lambda t: F.replace(F.initcap(t), F.lit("  "), F.lit(" "))))


def has_numbers(x: Column) -> Column:
    return (F.size(amounts(x)) > 0) | (F.size(percentages(x)) > 0)


def parts(x: Column, pattern: str) -> Column:
    """Trimmed, non-empty parts between matches of a pattern."""
    return F.filter(F.transform(F.split(x, pattern, -1), strip), lambda s: s != "")


#: Where sentences are cut: a sentence end followed by white space and a capital letter or digit.
SENTENCE_CUT = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def sentences(x: Column) -> Column:
    return parts(x, SENTENCE_CUT)


def spoken_sentences(x: Column) -> Column:
    """Split after every sentence end followed by white space."""
    return parts(x, r"(?<=[.!?])\s+")


def streamed_sentences(x: Column) -> Column:
    """What incremental segmentation yields for a whole text: cut after a sentence end followed by a blank."""
    return parts(x, r"(?<=[.!?]) ")


def index_tokens(x: Column) -> Column:
    return find_all(F.lower(x), lx.INDEX_TOKEN)


def normalize_number(x: Column, strict: bool = False) -> Column:
    """A number without currency, separators, per cent and final point. strict: only blanks are trimmed, as one would by hand."""
    plain = F.translate(x, "$, ", "")
    if not strict:
        plain = F.regexp_replace(plain, r"\s+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"%+$(?!\n)", ""), r"\.+$(?!\n)", "")


def speakable(x: Column) -> Column:
    """Acronyms, amounts and percentages as they are read aloud."""
    for pattern, spoken in lx.SPOKEN:
        x = F.regexp_replace(x, pattern, spoken)
    return strip(F.regexp_replace(x, r"\s+", " "))


def prompt_echo(x: Column, hint: str = lx.PROMPT_HINT) -> Column:
    """Whether over 0.6 of the distinct words of a transcript are words of the hint (which keeps its commas)."""
    known = strings(sorted(set(hint.lower().replace(".", "").split())))
    words = F.array_distinct(F.filter(F.split(F.translate(F.lower(x), ".,", ""), r"\s+", -1), lambda w: w != ""))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, known)) / F.size(words) > F.lit(0.6)).otherwise(F.lit(False))


def fold_windows(items: Column, target: int, overlap: int) -> Column:
    """Pack strings in order into windows of at most `target` estimated tokens, repeating the last `overlap` strings."""
    empty = F.expr("array()").cast("array<string>")
    start = F.struct(F.expr("array()").cast("array<array<string>>").alias("out"), empty.alias("win"), F.lit(0).alias("tokens"))

    def step(acc: Column, item: Column) -> Column:
        size = est_tokens(item)
        full = (acc["tokens"] + size > target) & (F.size(acc["win"]) > 0)
        tail = F.slice(acc["win"], F.greatest(F.size(acc["win"]) - overlap + 1, F.lit(1)), overlap) if overlap else empty
        kept = F.when(full, tail).otherwise(acc["win"])
        tokens = F.when(full, F.aggregate(tail, F.lit(0), lambda n, s: n + est_tokens(s))).otherwise(acc["tokens"])
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["win"]))).otherwise(acc["out"]).alias("out"), F.concat(kept, F.array(item)).alias("win"), (tokens + size).alias("tokens"))

    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["win"]) > 0, F.concat(acc["out"], F.array(acc["win"]))).otherwise(acc["out"]))


def sentence_windows(x: Column, target: int = 320, overlap: int = 1) -> Column:
    """Sliding windows of sentences, joined by blanks."""
    return F.transform(fold_windows(sentences(x), target, overlap), lambda w: F.array_join(w, " "))


def pack_bullets(items: Column, target: int = 320) -> Column:
    """Bullets in order as structs (place, text): small ones share a list, one of `target` tokens or more stands alone.

    `items` are structs (place, text); `place` of a shared list is null (the group's anchor stands for it).
    """
    kind = "array<struct<place:bigint,text:string>>"
    start = F.struct(F.expr("array()").cast(kind).alias("out"), F.expr("array()").cast("array<string>").alias("buf"), F.lit(0).alias("tokens"))
    shared = lambda buf: F.struct(F.lit(None).cast("bigint").alias("place"), F.array_join(F.transform(buf, lambda t: F.concat(F.lit("- "), t)), "\n").alias("text"))
    flushed = lambda acc: F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(shared(acc["buf"])))).otherwise(acc["out"])
    none = F.expr("array()").cast("array<string>")

    def step(acc: Column, item: Column) -> Column:
        size = est_tokens(item["text"])
        alone = size >= target
        full = (acc["tokens"] + size > target) & (F.size(acc["buf"]) > 0)
        single = F.struct(item["place"].cast("bigint").alias("place"), F.concat(F.lit("- "), item["text"]).alias("text"))
        out = F.when(alone, F.concat(flushed(acc), F.array(single))).when(full, flushed(acc)).otherwise(acc["out"])
        buf = F.when(alone, none).when(full, F.array(item["text"])).otherwise(F.concat(acc["buf"], F.array(item["text"])))
        tokens = F.when(alone, F.lit(0)).when(full, size).otherwise(acc["tokens"] + size)
        return F.struct(out.alias("out"), buf.alias("buf"), tokens.alias("tokens"))

    return F.aggregate(items, start, step, flushed)
