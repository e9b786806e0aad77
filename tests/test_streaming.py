import random
import time

from quarry.functions.text import streamed_sentences
from quarry.plans.dialogue import stream_turns
from quarry.plans.registry import QUERIES
from quarry.streaming.memory import latest, remember
from quarry.streaming.sentences import END, cut, replay_tokens, segment_unordered


def test_cutting_does_not_depend_on_tokens(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab.!? ") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    rows, want = [], {}
    for i, t in enumerate(texts):
        at = sorted({0, len(t), *(rnd.randint(0, len(t)) for _ in range(5))})
        rows += [(str(i), k, t[a:b]) for k, (a, b) in enumerate(zip(at, at[1:]))]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "session_id string, t string")
    for r in df.select("session_id", streamed_sentences(df.t).alias("s")).collect():
        want[r.session_id] = r.s
    got = {}
    for r in sorted(replay_tokens(spark.createDataFrame(rows, "session_id string, seq long, token string")).collect(), key=lambda r: r.pos):
        got.setdefault(r.session_id, []).append(r.sentence)
    assert got == {k: v for k, v in want.items() if v}
    assert cut("A. b") == (["A."], "b")


def test_streamed_memory_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    cols = ["session_id", "seq", "question", "answer"]
    assert sorted(map(tuple, stream_turns(spark, d).select(cols).collect())) == sorted(map(tuple, QUERIES["memory_last6"](spark, d).select(cols).collect()))


def test_idle_sessions_lose_their_memory(spark, tmp_path):
    def deliver(name, *rows):
        spark.createDataFrame(rows, "session_id long, seq long, question string, answer string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        turns = spark.readStream.schema("session_id long, seq long, question string, answer string").parquet(f"{tmp_path}/in/*")
        remember(turns, 2, idle_ms=1500).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
        rows = latest(spark.read.parquet(f"{tmp_path}/out")).collect()
        return {s: sorted(r.seq for r in rows if r.session_id == s) for s in {r.session_id for r in rows}}

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        deliver("a", (1, 0, "q", "a"), (1, 1, "q", "a"), (1, 2, "q", "a"), (2, 0, "q", "a"))
        assert run() == {1: [1, 2], 2: [0]}
        time.sleep(2)
        deliver("b", (3, 0, "q", "a"))  # a batch in which the timers of the first two fire
        assert run() == {1: [1, 2], 2: [0], 3: [0]}
        deliver("c", (1, 3, "q", "a"))
        assert run() == {1: [3], 2: [0], 3: [0]}
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_event_order(spark):
    by = {}
    for r in QUERIES["stream_events"](spark, "/root/testdata/sf0.001").collect():
        by.setdefault(r.session_id, []).append((r.seq, r.type))
    for events in by.values():
        kinds = [k for _, k in sorted(events)]
        assert kinds == ["abstain"] or kinds[0] == "meta" and kinds[-1] == "done" and kinds.count("done") == 1


def run_unordered(spark, path, wait_ms=60_000):
    """All files that are there, a file each micro-batch; without batches of no data, which timers by the clock would never end."""
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(empty, "false")
    try:
        stream = spark.readStream.schema("session_id string, seq long, token string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
        segment_unordered(stream, wait_ms).writeStream.outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.unset(empty)
    return sorted((r.session_id, r.pos, r.sentence) for r in spark.read.parquet(f"{path}/out").collect())


def deliver_tokens(spark, rows, path, name):
    spark.createDataFrame(rows, "session_id string, seq long, token string").coalesce(1).write.parquet(f"{path}/in/{name}")


def test_tokens_in_any_order_give_the_same_sentences(spark, tmp_path):
    rng = random.Random(4)
    texts = {f"s{k}": "".join(rng.choice(["one ", "two. ", "three", "! ", "2.", "50 ", "? "]) for _ in range(40)) for k in range(6)}
    tokens = {name: [text[i : i + 3] for i in range(0, len(text), 3)] for name, text in texts.items()}
    ordered = [(name, k, t) for name, ts in tokens.items() for k, t in enumerate(ts)]
    want = sorted((r.session_id, r.pos, r.sentence) for r in replay_tokens(spark.createDataFrame(ordered, "session_id string, seq long, token string")).collect())
    rows = ordered + [(name, len(ts), END) for name, ts in tokens.items()]
    rng.shuffle(rows)
    rows += rng.sample(rows, 30)  # delivered twice
    for k in range(4):
        deliver_tokens(spark, rows[k::4], tmp_path, f"f{k}")
    assert run_unordered(spark, tmp_path) == want
    deliver_tokens(spark, rows[:20], tmp_path, "late")  # copies of ended sessions
    assert run_unordered(spark, tmp_path) == want


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    deliver_tokens(spark, [("a", 0, "One. "), ("a", 2, "Three. "), ("a", 3, "Four")], tmp_path, "f0")
    assert run_unordered(spark, tmp_path, 1) == [("a", 0, "One.")]
    time.sleep(0.2)
    deliver_tokens(spark, [("b", 0, "Other. ")], tmp_path, "f1")
    assert run_unordered(spark, tmp_path, 1) == [("a", 0, "One."), ("a", 1, "Three."), ("a", 2, "Four"), ("b", 0, "Other.")]
