import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from quarry.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = regex.compile(P.PATTERN).findall


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_chunks_split_like_the_pattern():
    rnd = random.Random(2)
    assert bpe.CHUNKABLE == P.PATTERN
    for _ in range(20_000):
        t = "".join(rnd.choice("ab  \n\t's.1é漢\xa0\x1c\r\0") for _ in range(rnd.randint(0, 12)))
        assert [w for c in bpe.chunks(t, SPLIT) for w in SPLIT(c)] == SPLIT(t), repr(t)


def test_replay_equals_the_library_on_words():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("aaabesstrin") for _ in range(rnd.randint(1, 25))) for _ in range(5000)})
    for w, blob in zip(words, bpe.MergeReplay(RANKS).encode([w.encode() for w in words])):
        assert ids(blob) == ENC.encode_ordinary(w), w


def test_replay_survives_ranks_that_are_out_of_order():
    rnd = random.Random(4)
    short = [t for t in RANKS if len(t) == 1]
    rest = [t for t in RANKS if len(t) > 1][:3000]
    rnd.shuffle(rest)
    ranks = {t: i for i, t in enumerate(short + rest)}
    enc = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = sorted({"".join(rnd.choice("aaabesstrin") for _ in range(rnd.randint(1, 20))) for _ in range(3000)})
    for w, blob in zip(words, bpe.MergeReplay(ranks).encode([w.encode() for w in words])):
        assert ids(blob) == enc.encode_ordinary(w), w


def test_single_words_equal_the_library():
    rnd = random.Random(5)
    replay = bpe.MergeReplay(RANKS)
    words = ["a" * 3000, "ab" * 2000, *("".join(rnd.choice("aaabesstrin") for _ in range(rnd.randint(1, 40))) for _ in range(2000))]
    for w in words:
        assert replay.one(w.encode()) == ENC.encode_ordinary(w), w


def test_what_is_known_stays_bounded():
    known = bpe.Known(100, chars=1_000)
    for k in range(0, 5_000, 10):
        present = {f"w{n}" for n in range(k, k + 10)}
        known.add({c: b"" for c in present if c not in known}, present)
        assert present <= known.keys() and len(known) <= 110 and known.held == sum(map(len, known))
    known.add({"x" * 2_000: b""}, {"x" * 2_000})
    assert set(known) == {"x" * 2_000}


def test_encode_whole_texts_and_round_trip(spark):
    texts = [None, "", "Hello world's  end\n\n x", "a" * 50_000, "漢字 é \t!!", "same text", "same text", "<|endoftext|> 12 345"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = {r.doc_id: r for r in bpe.bpe_encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()}
    for i, t in enumerate(texts):
        want = ENC.encode_ordinary(t or "")
        assert out[i].ids == want and out[i].n_tokens == len(want) and out[i].decoded == (t or "")
        assert out[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.bpe_decode(spark.createDataFrame([(1, ENC.encode_ordinary("xé y")), (2, None)], "doc_id long, ids array<int>"), P.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: bytearray("xé y".encode()), 2: None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_the_library(spark, sf):
    from quarry.llm.queries import op5_byte_bpe

    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in op5_byte_bpe(spark, f"/root/testdata/{sf}").collect()}
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect():
        want = ENC.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
