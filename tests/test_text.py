import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx


@pytest.fixture
def value(spark):
    def run(f, x):
        return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("v")).first().v

    return run


def test_clean(value):
    assert value(tx.clean_text, " a  \t b ﬁx ‘q’ “z” –— ") == "a b fix 'q' \"z\" --"


def test_tokens_at_the_edges(value):
    assert [value(tx.est_tokens, "x" * n) for n in (0, 3, 29, 30, 37)] == [1, 1, 7, 8, 10]


def test_facets(value):
    assert value(tx.amounts, "$2.5 and $1,000.50 and $2") == ["$1,000.50", "$2"]
    assert value(tx.percentages, "2 % 2% 2%") == ["2 %", "2%"]
    assert value(tx.durations, "3-5 Business Days, 1 day and 1 DAY") == ["1 day", "3-5 business days"]
    assert value(tx.tiers, "TIER  2, tier2 and Tier 9") == ["Tier 2", "Tier2"]
    assert value(tx.amounts, " ".join(f"${k}" for k in range(10, 30))) == [f"${k}" for k in range(10, 18)]


def test_sentences(value):
    t = "One. two! Three? 4 is.\nFive 2.50 x.  "
    assert value(tx.sentences, t) == ["One. two!", "Three?", "4 is.", "Five 2.50 x."]
    assert value(tx.spoken_sentences, t) == ["One.", "two!", "Three?", "4 is.", "Five 2.50 x."]
    assert value(tx.streamed_sentences, t) == ["One.", "two!", "Three?", "4 is.\nFive 2.50 x."]
    assert value(tx.sentences, "") == []


def est(s):
    return max(1, int(len(s) / 3.7))


def windows(sents, target, overlap):
    out, win, n = [], [], 0
    for s in sents:
        if n + est(s) > target and win:
            out.append(" ".join(win))
            win = win[-overlap:] if overlap else []
            n = sum(map(est, win))
        win, n = win + [s], n + est(s)
    return out + ([" ".join(win)] if win else [])


def test_windows_equal_a_plain_model(spark):
    rnd = random.Random(1)
    texts = [" ".join("W" + "o" * rnd.randint(1, 60) + "." for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    for target, overlap in ((20, 1), (8, 2), (40, 0)):
        got = {r.id: r.w for r in df.select("id", tx.sentence_windows(F.col("x"), target, overlap).alias("w")).collect()}
        assert got == {i: windows(t.split(" ") if t else [], target, overlap) for i, t in enumerate(texts)}


def bullets(items, target):
    out, buf, n = [], [], 0
    flush = lambda: out.append((None, "\n".join(f"- {t}" for t in buf))) if buf else None
    for place, t in items:
        if est(t) >= target:
            flush()
            buf, n = [], 0
            out.append((place, f"- {t}"))
            continue
        if n + est(t) > target and buf:
            flush()
            buf, n = [], 0
        buf, n = buf + [t], n + est(t)
    flush()
    return out


def test_bullets_equal_a_plain_model(spark):
    rnd = random.Random(2)
    rows = [(k, [(i, "b" * rnd.choice([5, 30, 60, 90])) for i in range(rnd.randint(0, 12))]) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, items array<struct<place:bigint,text:string>>")
    got = {r.id: [tuple(p) for p in r.p] for r in df.select("id", tx.pack_bullets(F.col("items"), 20).alias("p")).collect()}
    assert got == {k: bullets(v, 20) for k, v in rows}


def test_numbers(value):
    assert [value(tx.normalize_number, x) for x in ("$1,000", "5%", "2.", "2.50", "5\n", "5 %")] == ["1000", "5", "2", "2.50", "5", "5"]
    assert value(lambda c: tx.normalize_number(c, strict=True), "5\n") == "5\n"


def test_speech(value):
    assert value(tx.speakable, "Pay $1,234.50 by P2P,  $20 or 5 % APR") == "Pay 1,234 dollars and 50 cents by peer to peer, 20 dollars or 5 percent A P R"


def test_prompt_echo(value):
    assert value(tx.prompt_echo, tx.lx.PROMPT_HINT) is True
    assert value(tx.prompt_echo, "customer support call x y") is False  # exactly 0.6
    assert value(tx.prompt_echo, " ") is False
