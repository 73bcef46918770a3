"""Token counts under a unigram piece table, by trie-shared dynamic programming.

The file ranks its pieces by merges; no frequencies are given and none are
trained, so a piece's unigram score is the log-probability that Zipf's law
gives its rank. Pre-tokens are a text's words (cut at white space) behind a word mark. The best
segmentation of a pre-token has the highest sum of piece scores, then the
fewest tokens. Its forward score at a position depends on the prefix only, so
the distinct pre-tokens of a batch are inserted in a trie, and each trie node's
(score, tokens) is computed once for all that share the prefix; terminal counts
are stored. The trie is walked depth first in the order of the sorted
pre-tokens, so it needs memory for one path only. A character that no piece
holds counts as its UTF-8 bytes.

Null, empty and blank texts have no words and no tokens. Repeated rows are
counted each on its own. Columns besides id and text play no part.
"""

from __future__ import annotations

from functools import partial
from itertools import chain
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
#: Entries of one worker's cache of terminal counts.
CACHE = 700_000


def zipf(ranks: dict[str, float]) -> dict[str, float]:
    """Unigram log-probabilities of ranked pieces: the frequency of rank r is in proportion to 1 / (r + 1)."""
    order = {piece: k for k, piece in enumerate(sorted(ranks, key=lambda p: (ranks[p], p)))}
    norm = log(sum(1 / (k + 1) for k in range(len(order)))) if order else 0.0
    return {piece: -log(k + 1) - norm for piece, k in order.items()}


class Pieces:
    """Scores of the ordinary pieces of a sentencepiece file."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        #: Below any sum that whole pieces give for one character.
        self.unknown = min(scores.values(), default=0.0) - 10.0

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls(zipf({model.id_to_piece(i): -model.get_score(i) for i in ordinary}))

    def terminal_counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word's best segmentation; prefixes are scored once."""
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        out: dict[str, int] = {}
        path, before = [(0.0, 0)], ""
        for word in sorted(words):
            marked = MARK + word
            shared = 0
            for a, b in zip(before, marked, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                score, tokens = path[end - 1]
                best = (score + unknown, -tokens - len(marked[end - 1].encode("utf-8", "surrogatepass")))
                for start in range(max(0, end - longest), end):
                    value = get(marked[start:end])
                    if value is not None:
                        score, tokens = path[start]
                        found = (score + value, -tokens - 1)
                        if found > best:
                            best = found
                path.append((best[0], -best[1]))
            before = marked
            out[word] = path[-1][1]
        return out


_made: dict = {}


def _counts(batches, path: str):
    if path not in _made:
        _made[path] = (Pieces.load(path), {})
    pieces, known = _made[path]
    for batch in batches:
        split = [(t or "").split() for t in batch.column(1).to_pylist()]
        new = {w for w in chain.from_iterable(split) if w not in known}
        if len(known) + len(new) > CACHE:
            known.clear()
            new = {*chain.from_iterable(split)}
        known.update(pieces.terminal_counts([*new]))
        counts = [sum(map(known.__getitem__, words)) for words in split]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([*map(len, split)], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each document. Narrow: no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_counts, path=path), f"id {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
