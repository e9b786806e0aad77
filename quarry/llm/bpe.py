"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a batch are laid out in one symbol array. An inverted index goes from the rank of a
pair to the positions of that pair; ranks are replayed in rising order, each on all of its positions at once, and
only the pairs with the two touched neighbours enter the index anew. Encodings of pre-tokens are kept in a bounded
dictionary (bounded by entries and by characters), so that each is replayed about once a task. What a task holds
beside one whole text does not grow with its input.

Edge cases: a null or empty text has no tokens; a text of any length is encoded whole; equal rows give equal results;
an empty table gives an empty table; other columns of the input play no part (only the id and text columns are read).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._arrow import frugal

#: Bytes of text that a task splits at once; its memory follows from this and from the bound on what it remembers.
SLICE_BYTES = 8_000_000
KNOWN_PARTS = 250_000

KINDS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string", "decoded": "string"}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes sets of pre-tokens (bytes) by replaying merges in rank order over all of them.

    The pairs that merge are all splits of a token into two tokens, as sorted codes: their size is the vocabulary's.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], "int32")
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], "int32")
        get = ranks.get
        splits = ((get(token[:k]), get(token[k:]), rank) for token, rank in ranks.items() for k in range(1, len(token)))
        found = sorted((left << 32 | right, rank) for left, right, rank in splits if left is not None and right is not None)
        self.codes, self.merged = (np.array(x, t) for x, t in zip(zip(*found), ("int64", "int32"))) if found else (np.zeros(0, "int64"), np.zeros(0, "int32"))
        self.codes, self.merged = np.r_[self.codes, np.iinfo("int64").max], np.r_[self.merged, np.int32(-1)]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that the pairs merge to, or -1."""
        codes = left.astype("int64") << 32 | right
        at = np.searchsorted(self.codes, codes)
        return np.where(self.codes[at] == codes, self.merged[at], np.int32(-1))

    def one(self, word: bytes) -> list[int]:
        """The plain form for a single word: again and again the leftmost pair of least rank, from a heap."""
        token, get = self.token, self.ranks.get
        n = len(word)
        symbols = [int(self.single[b]) for b in word]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(rank, k) for k in range(n - 1) if (rank := int(self.first[word[k] * 256 + word[k + 1]])) >= 0]
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            follow = after[at]
            if symbols[at] < 0 or follow < 0 or get(token[symbols[at]] + token[symbols[follow]]) != rank:
                continue  # one of the two was merged since
            symbols[at], symbols[follow], after[at] = rank, -1, after[follow]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (new := get(token[symbols[left]] + token[symbols[right]])) is not None:
                    heapq.heappush(queue, (new, left))
        return [s for s in symbols if s >= 0]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        todo = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif word:
                todo.append(k)
            else:
                out[k] = b""
        if not todo:
            return out
        raw = np.frombuffer(b"".join([words[k] for k in todo]), "uint8")
        n = len(raw)
        ends = np.cumsum([len(words[k]) for k in todo])
        symbols = self.single[raw]
        after, before = np.arange(1, n + 1, dtype="int32"), np.arange(-1, n - 1, dtype="int32")
        after[ends - 1], before[np.r_[0, ends[:-1]]] = -1, -1
        ranks = np.full(n, -1, "int32")  # of the pair that begins at a place
        ranks[:-1] = self.first[raw[:-1].astype("int32") * 256 + raw[1:]]
        ranks[ends - 1] = -1  # no pair across words
        places = np.argsort(ranks, kind="stable").astype("int32")
        places = places[np.searchsorted(ranks[places], 0) :]
        cuts = np.flatnonzero(np.diff(ranks[places], prepend=-1))
        index = dict(zip(ranks[places][cuts].tolist(), np.split(places, cuts[1:]))) if len(cuts) else {}
        late: dict[int, list[int]] = {}
        queue = list(index)
        heapq.heapify(queue)
        odd: list[int] = []  # places in words where a later merge would have had to go first
        while queue:
            rank = heapq.heappop(queue)
            at = index.pop(rank, None)
            if rank in late:
                more = np.unique(np.array(late.pop(rank), "int32"))
                at = more if at is None else np.union1d(at, more)
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            follow = after[at]
            if (ranks[follow] == rank).any():  # places may overlap: the leftmost goes first
                taken, free = [], -1
                for x, y in zip(at.tolist(), follow.tolist()):
                    if x != free:
                        taken.append(x)
                        free = y
                at = np.array(taken, "int32")
                follow = after[at]
            behind = after[follow]
            chained = behind[(behind >= 0) & (ranks[behind] == rank)]
            if len(chained):  # merged one after the other: the pair that lies between may come first
                between = self.pairs(np.full(len(chained), rank, "int32"), symbols[chained])
                odd += chained[(between >= 0) & (between <= rank)].tolist()
            symbols[at], symbols[follow] = rank, -1
            ranks[at], ranks[follow] = -1, -1
            after[at] = behind
            ok = behind >= 0
            right_at, behind = at[ok], behind[ok]
            before[behind] = right_at
            front = before[at]
            front = front[front >= 0]
            # the two touched neighbours: (this token, what follows) and (what comes before, this token)
            touched = np.concatenate([right_at, front])
            if not len(touched):
                continue
            found = self.pairs(symbols[touched], symbols[after[touched]])
            ranks[touched] = found
            for place, new in zip(touched.tolist(), found.tolist()):
                if new < 0:
                    continue
                if new <= rank:
                    odd.append(place)
                    ranks[place] = -1
                elif new in late:
                    late[new].append(place)
                else:
                    late[new] = [place]
                    if new not in index:
                        heapq.heappush(queue, new)
        left = symbols >= 0
        blob = symbols[left].astype("<u4").tobytes()
        stops = (np.cumsum(left)[ends - 1] * 4).tolist()
        start = 0
        for k, stop in zip(todo, stops):
            out[k] = blob[start:stop]
            start = stop
        for s in {int(np.searchsorted(ends, at, "right")) for at in odd}:
            out[todo[s]] = array("I", self.one(words[todo[s]])).tobytes()
        return out


#: The pattern for which chunks() is right: a lone white-space character between others never lies inside a match,
#: a blank only at its start, a line feed always alone.
CHUNKABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_DOUBLE = re.compile(r"\s\s").search


def chunks(text: str | None, pieces: Callable[[str], list[str]]) -> list[str]:
    """Parts of a text that can be split into pre-tokens one by one, so that equal parts are split once.

    Where white-space characters stand alone, each blank and each line feed begins a part; the parts of other texts are
    their pre-tokens, which the pattern leaves whole when it meets them alone.
    """
    if not text:
        return []
    if _DOUBLE(text) or "\0" in text:
        return pieces(text)
    parts = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    return parts if parts[0] else parts[1:]


class Known(dict):
    """What is known of parts of texts, for the length of a task: bounded by entries and by the length of the keys.

    When it is full, only the parts of the present texts stay.
    """

    def __init__(self, entries: int, chars: int = 8_000_000):
        super().__init__()
        self.entries, self.chars, self.held = entries, chars, 0

    def add(self, found: dict, present: set[str]) -> None:
        size = sum(map(len, found))
        if len(self) + len(found) > self.entries or self.held + size > self.chars:
            for part in self.keys() - present:
                del self[part]
            kept = dict(self)  # a dictionary does not shrink by itself
            self.clear()
            self.update(kept)
            self.held = sum(map(len, kept))
        self.update(found)
        self.held += size


@lru_cache(maxsize=1)
def _replay(blob: bytes) -> MergeReplay:
    return MergeReplay({base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line.strip())})


def _encoder(ranks_blob, pattern: str, id_column: str, text_column: str, outputs: tuple[str, ...], cache_size: int):
    plain_spaces = pattern == CHUNKABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        from quarry.llm._arrow import slices

        replay = _replay(ranks_blob.value)
        decode = replay.token
        pieces = regex.compile(pattern).findall

        def split(text: str | None) -> list[str]:
            return chunks(text, pieces) if plain_spaces else pieces(text or "")

        known = Known(cache_size)
        for batch in batches:
            for part in slices(batch, text_column, SLICE_BYTES):
                texts = part.column(text_column).to_pylist()
                present: set[str] = set()
                for text in texts:  # split here and again below, so that only the different parts are held
                    present.update(split(text))
                # a blank and letters make one pre-token; all else is left to the pattern
                new = {c: [c] if not plain_spaces or c[0] == " " and c[1:].isalpha() else pieces(c) for c in present if c not in known}
                distinct = list(set().union(*new.values()))
                ids_of = dict(zip(distinct, replay.encode([w.encode() for w in distinct])))
                known.add({c: b"".join([ids_of[w] for w in words]) for c, words in new.items()}, present)
                del present, new, distinct, ids_of
                columns: dict[str, list] = {k: [] for k in outputs}
                for text in texts:
                    blob = b"".join(map(known.__getitem__, split(text)))
                    ids = np.frombuffer(blob, "<u4")
                    if "n_tokens" in columns:
                        columns["n_tokens"].append(len(ids))
                    if "ids" in columns:
                        columns["ids"].append(ids.astype("int32"))
                    if "ids_sha256" in columns:
                        columns["ids_sha256"].append(hashlib.sha256(blob).hexdigest())
                    if "decoded" in columns or "decoded_sha256" in columns:
                        back = b"".join(map(decode.__getitem__, ids.tolist()))
                        if "decoded" in columns:
                            columns["decoded"].append(back.decode("utf-8", "replace"))
                        if "decoded_sha256" in columns:
                            columns["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([part.column(id_column), *(pa.array(v, types.get(k, pa.string())) for k, v in columns.items())], [id_column, *columns])

    return run


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), cache_size: int = KNOWN_PARTS) -> DataFrame:
    """Encode whole texts; `outputs` names the columns to return beside the id (see KINDS).

    The rank file is read on the driver and sent to the executors (a vocabulary of fixed size, about 1 MB), so
    executors need no such file.
    """
    with open(ranks_path, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[id_column]
    schema = ", ".join([f"`{id_column}` {kind}", *(f"{k} {KINDS[k]}" for k in outputs)])
    return df.select(id_column, text_column).mapInArrow(frugal(_encoder(blob, pattern, id_column, text_column, tuple(outputs), cache_size)), schema)


def bpe_decode(df: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The bytes behind arrays of token ids: id, decoded (binary). A null array gives null."""
    with open(ranks_path, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {int(r): base64.b64decode(t) for t, r in (line.split() for line in blob.value.splitlines() if line.strip())}
        for batch in batches:
            back = [None if ids is None else b"".join([token[i] for i in ids]) for ids in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(back, pa.binary())], [id_column, "decoded"])

    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {dict(df.dtypes)[id_column]}, decoded binary")
