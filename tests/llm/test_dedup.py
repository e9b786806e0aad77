import hashlib
import random
from collections import Counter

import numpy as np

from quarry.llm import linededup, neardup, suffixdedup
from quarry.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(sets)
    for k, a in enumerate(items):
        for b in items[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, sets


def near_texts(n=60, seed=1):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randint(3, 90))) for _ in range(12)]
    out = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
        out.append((i, " ".join(words)))
    return out + [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, out[0][1]), (n + 6, " ")]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_texts()
    want, sets = components(rows)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, keys string, n_shingles int")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_candidate_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SETS", 7)
    rows = near_texts(80, 5)
    want, _ = components(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()) == [(3, 3, True), (3, 3, True), (9, 3, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_rows_that_share_an_id_and_ids_of_text(spark):
    one, two, three = "a b c d e f g h", "p q r s t u v w", "k l m n o p q r s"
    rows = [("1", one), ("2", one), ("2", two), ("5", two), ("2", three), (None, three)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), carry=("text",)).collect()
    assert {(r.doc_id, r.text, r.component_id) for r in got} == {("1", one, "1"), ("2", one, "1"), ("2", two, "2"), ("5", two, "2"), ("2", three, "2"), (None, three, "2")}


def test_pipeline_near_dedup_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "x"), (2, "p q r s t u v w", None), (None, "z", "y"), (4, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert {tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {rows[0], rows[2], rows[3], rows[4]}
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_recall_of_the_tensored_tables():
    """The chance of two sets to meet: as computed at 0.75, and measured on the key functions at 0.75 and 0.1."""
    rnd = np.random.default_rng(1)
    u, v = (rnd.random((300_000, neardup.GROUPS)) < 0.75**neardup.ROWS for _ in "uv")
    met = [u[:, i] & v[:, [(i + k) % neardup.GROUPS for k in range(neardup.BAND)]].any(axis=1) for i in range(neardup.GROUPS)]
    assert np.any(met, axis=0).mean() > 0.9999
    functions = neardup.salts(2 * neardup.GROUPS * neardup.ROWS)
    met = {0.75: 0, 0.1: 0}
    with np.errstate(over="ignore"):
        for similarity in met:
            for _ in range(300):
                x = rnd.integers(0, 2**64, 700, "uint64")
                shared = round(700 * similarity)
                rest = (700 - shared) // 2
                a, b = (neardup.minhashes(np.r_[x[:shared], part], functions).reshape(2, neardup.GROUPS, neardup.ROWS) for part in (x[shared : shared + rest], x[shared + rest :]))
                met[similarity] += (a == b).all(axis=2).any(axis=1).all()
    assert met == {0.75: 300, 0.1: 0}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def near_lines(rows, least=linededup.MIN_WORDS):
    """Brute force: the text of each document without lines that an earlier line equals or nearly equals."""

    def close(a, b):
        a, b = a.split(" "), b.split(" ")
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        if abs(len(a) - len(b)) != 1:
            return False
        if len(a) < len(b):
            a, b = b, a
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            norm = line.strip(" ")
            if norm and any(norm == s or min(len(norm.split(" ")), len(s.split(" "))) >= least and close(norm, s) for s in seen):
                gone = True
            else:
                gone = False
            if norm:
                seen.append(norm)
            if not gone:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def line_rows(seed=3, n=25):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randint(1, 11))) for _ in range(14)]

    def line():
        words = rnd.choice(base).split()
        k = rnd.randrange(5)
        if k == 0:
            words[rnd.randrange(len(words))] = "x"
        elif k == 1:
            words.insert(rnd.randrange(len(words) + 1), "y")
        elif k == 2 and len(words) > 1:
            del words[rnd.randrange(len(words))]
        return rnd.choice(["", " "]) + " ".join(words)

    return [(i, "\n".join(rnd.choice([line(), ""]) for _ in range(rnd.randint(1, 9)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "\n\n")]


def test_line_dedup_equals_brute_force(spark):
    for seed in (3, 4):
        rows = line_rows(seed)
        df = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, n_lines int, _line string")
        out = linededup.dedup_lines(df)
        assert out.columns == ["doc_id", "n_lines", "_line", "text"] or set(out.columns) == set(df.columns)
        assert {r.doc_id: r.text for r in out.collect()} == near_lines(rows)


def test_line_dedup_by_blocks_and_by_shuffle(spark, monkeypatch):
    rows = line_rows(8)
    for name, value in (("SHORT", 4), ("BLOCK", 3), ("BROADCAST_LINES", 0)):
        monkeypatch.setattr(linededup, name, value)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == near_lines(rows)


def test_line_dedup_long_lines_null_ids_and_empty(spark):
    words = [f"t{i}" for i in range(2_000)]
    other = words[:1500] + ["new"] + words[1501:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:700] + words[701:])), (None, "a line of five words")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: " ".join(words), 2: "", 3: "", None: "a line of five words"}
    assert linededup.dedup_lines(out.limit(0)).count() == 0


def repeats(rows, length):
    blobs = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + length] for b in blobs.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in blobs.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, "uint8")[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(seed=1):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefg é") for _ in range(n))
    parts = [text(rnd.randint(150, 900)) for _ in range(6)]
    rows = [(i, text(rnd.randint(0, 200)) + rnd.choice(parts) + text(rnd.randint(0, 99)) + rnd.choice(parts)[: rnd.randint(100, 900)]) for i in range(30)]
    return rows + [(30, None), (31, ""), (32, "z" * 1500), (33, parts[0]), (34, "ab" * 500), (35, text(399)), (36, rows[0][1])]


def test_suffix_dedup_equals_brute_force(spark):
    for seed in (1, 2):
        rows = repeat_rows(seed)
        df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, th int, key string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(df).collect()}
        assert got == repeats(rows, suffixdedup.LENGTH)


def test_suffix_dedup_hot_keys_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT_CONTEXTS", 1)
    rows = repeat_rows(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeats(rows, suffixdedup.LENGTH)


def test_segments_of_a_long_text_cover_every_window():
    import pyarrow as pa

    old = suffixdedup.SEGMENT
    suffixdedup.SEGMENT = 1000
    try:
        np.seterr(over="ignore")
        rnd = random.Random(1)
        text = "".join(rnd.choice("abc ") for _ in range(3000)) + "ab" * 1000
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([text])], ["doc_id", "th", "text"])
        found = [r for b in suffixdedup._find_anchors(iter([batch])) for r in b.to_pylist()]
        ends = [r["hi"] if r["hi"] >= 0 else ~r["hi"] for r in found]
        assert sorted(p for r, hi in zip(found, ends) for p in range(r["lo"], hi + 1)) == list(range(5000 - suffixdedup.LENGTH + 1))
        assert sum(r["hi"] < 0 for r in found) >= 1 and len(found) < 200  # the periodic part takes a row a segment, not one a place
    finally:
        suffixdedup.SEGMENT = old


def test_suffix_dedup_repeated_rows_and_empty(spark):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcd") for _ in range(500))
    rows = [(1, text), (1, text), (2, "x")]
    got = sorted((r.doc_id, r.n_removed) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 500), (1, 500), (2, 0)]
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merged_transforms_find_repeats():
    np.seterr(over="ignore")
    rnd = random.Random(5)
    for _ in range(150):
        base = [bytes(rnd.randrange(4) for _ in range(rnd.randint(1, 40))) for _ in range(4)]
        blobs = [b"".join(rnd.choice(base) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 8))]
        count = Counter(b[i : i + 12] for b in blobs for i in range(len(b) - 11))
        want = [[i for i in range(len(b) - 11) if count[b[i : i + 12]] > 1] for b in blobs]
        assert [x.tolist() for x in suffixdedup.repeated_starts(blobs, 12, 3, 3)] == want


def test_line_dedup_keeps_other_rows_of_an_id(spark):
    """Two rows of one id: a line of the one is a copy, the line in its place of the other is not."""
    rows = [(1, "a line that comes back again"), (2, "a line that comes back again\nown line of the first row"), (2, "fresh words that nobody else has here"), (2, "fresh words that nobody else has here"), (None, "nobody has an id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in linededup.dedup_lines(df).collect())
    assert got == [(0, "nobody has an id here"), (1, rows[0][1]), (2, "fresh words that nobody else has here"), (2, "fresh words that nobody else has here"), (2, "own line of the first row")]
