"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The score of a segmentation is the sum of its pieces' scores; a pre-token counts the pieces of its best segmentation
(of equal scores, the one of fewest pieces). The best score of a prefix depends on the prefix alone, so the distinct
pre-tokens of a batch are put in a trie and the forward scores are computed once for each node; nodes at which a
pre-token ends store its count.

Edge cases: null and empty texts have no pre-tokens; texts of any length are counted whole; equal rows give equal
results; an empty table gives an empty table; other columns play no part. Every single byte must be a piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._arrow import frugal
from quarry.llm.bpe import CHUNKABLE, KNOWN_PARTS, SLICE_BYTES, Known, chunks, load_ranks


def zipf_scores(ranks: Mapping[bytes, int]) -> dict[bytes, float]:
    """Log probabilities of tokens whose ranks follow Zipf's law."""
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - norm for token, r in ranks.items()}


class Trie:
    """Nodes as parallel lists: children, forward score and piece count of the best segmentation of the prefix."""

    def __init__(self, scores: Mapping[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.children: list[dict[int, int] | None] = [None]
        self.best = [0.0]
        self.pieces = [0]

    def insert(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Add words and return the terminal count of each."""
        scores, longest, get = self.scores, self.longest, self.scores.get
        children, best, pieces = self.children, self.best, self.pieces
        out = {}
        for word in words:
            node, path = 0, [0]
            for depth, byte in enumerate(word, 1):
                below = children[node]
                if below is None:
                    below = children[node] = {}
                following = below.get(byte)
                if following is None:  # a new prefix: its forward score from those of its own prefixes
                    top, count = -math.inf, 0
                    for start in range(depth - 1, max(0, depth - longest) - 1, -1):
                        score = get(word[start:depth])
                        if score is not None:
                            from_ = path[start]
                            total, n = best[from_] + score, pieces[from_] + 1
                            if total > top or total == top and n < count:
                                top, count = total, n
                    if count == 0:
                        raise ValueError(f"no piece ends at byte {depth} of {word!r}")
                    following = below[byte] = len(best)
                    children.append(None)
                    best.append(top)
                    pieces.append(count)
                node = following
                path.append(node)
            out[word] = pieces[node]
        return out


def token_counts(df: DataFrame, vocabulary_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", cache_size: int = KNOWN_PARTS) -> DataFrame:
    """id, n_chars, n_pretokens, n_tokens of every whole text.

    The vocabulary is a .tiktoken rank file, read on the driver and sent to the executors (fixed size, about 1 MB).
    """
    import pyarrow.compute as pc

    with open(vocabulary_path, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())
    apart = pattern == CHUNKABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import regex

        from quarry.llm._arrow import slices

        scores = zipf_scores({base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.value.splitlines() if line.strip())})
        pieces = regex.compile(pattern).findall

        def split(text: str | None) -> list[str]:
            return chunks(text, pieces) if apart else pieces(text or "")

        known = Known(cache_size)  # of a part of a text: pre-tokens * 2 ** 40 + tokens
        for batch in batches:
            for part in slices(batch, text_column, SLICE_BYTES):
                texts = part.column(text_column).to_pylist()
                present: set[str] = set()
                for text in texts:
                    present.update(split(text))
                new = {c: [c] if not apart or c[0] == " " and c[1:].isalpha() else pieces(c) for c in present if c not in known}
                counts = Trie(scores).insert(sorted({w.encode() for words in new.values() for w in words}))
                known.add({c: (len(words) << 40) + sum([counts[w.encode()] for w in words]) for c, words in new.items()}, present)
                del present, new, counts
                sums = [sum(map(known.__getitem__, split(text))) for text in texts]
                yield pa.RecordBatch.from_arrays([part.column(id_column), pc.fill_null(pc.utf8_length(part.column(text_column)), 0).cast(pa.int64()), pa.array([s >> 40 for s in sums], pa.int64()), pa.array([s & (1 << 40) - 1 for s in sums], pa.int64())], [id_column, "n_chars", "n_pretokens", "n_tokens"])

    return df.select(id_column, text_column).mapInArrow(frugal(run), f"`{id_column}` {dict(df.dtypes)[id_column]}, n_chars long, n_pretokens long, n_tokens long")


__all__ = ["Trie", "load_ranks", "token_counts", "zipf_scores"]
