"""Token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are inserted in a trie that a worker keeps from batch to batch and
from task to task. Each node holds the forward score of its prefix and the count of
tokens of the best segmentation, so a prefix that pre-tokens share is scored once, in
whichever batch it comes up again. A text is the sum of the counts at its terminals.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import col, small_batches
from ._text import batches, slices

#: Stands for the blank before a word.
MARK = "▁"
#: Nodes that a worker keeps, some 100 MB with their terminals; beyond it, the trie starts anew.
KEPT = 600_000
#: Score of each UTF-8 byte of a letter that no piece spells.
BYTE_SCORE = -20.0


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Unigram scores for a vocabulary in the order of its ranks: the logarithm of Zipf's share."""
    return {p: -math.log(i + 2.0) for i, p in enumerate(pieces)}


class Trie:
    """Nodes by number, the root is 0; each with the forward score and the token count of its prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.steps = 0
        self._empty()

    def _empty(self) -> None:
        #: (node, letter) in one number -> child
        self.children: dict[int, int] = {}
        self.best = array("d", [0.0])
        self.count = array("q", [0])
        #: pre-tokens that end at a node, with the count there
        self.terminals: dict[str, int] = {}

    def insert(self, tokens: Iterable[str]) -> dict[str, int]:
        """Adds pre-tokens and returns their counts; ties between segmentations go to the one of fewer tokens.

        New ones are walked in sorted order, so the path to the last one is left where the next
        one leaves it. The trie is dropped whole once it holds KEPT nodes. A pre-token of more
        letters than that is scored by itself and leaves no nodes.
        """
        words = set(tokens)
        out = {w: n for w in words if (n := self.terminals.get(w)) is not None}
        get, longest = self.scores.get, self.longest
        last, path, best, count = "", [0], [0.0], [0]
        for word in sorted(words - out.keys()):
            keep = len(word) < KEPT
            if keep and len(self.best) + len(word) > KEPT:
                self._empty()
                last, path = "", [0]
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            shared = len(path) - 1
            del best[shared + 1 :], count[shared + 1 :]
            node = path[-1]
            for end in range(shared + 1, len(word) + 1):
                letter = word[end - 1]
                edge = node << 21 | ord(letter)
                if keep and (node := self.children.get(edge, -1)) >= 0:
                    path.append(node)
                    best.append(self.best[node])
                    count.append(self.count[node])
                    continue
                self.steps += 1
                s = get(letter)
                n = 1
                if s is None:
                    n = len(letter.encode("utf-8", "surrogatepass"))
                    s = BYTE_SCORE * n
                top, least = best[end - 1] + s, count[end - 1] + n
                for start in range(max(0, end - longest), end - 1):
                    s = get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and count[start] + 1 < least):
                            top, least = s, count[start] + 1
                best.append(top)
                count.append(least)
                if keep:
                    self.children[edge] = node = len(self.best)
                    self.best.append(top)
                    self.count.append(least)
                    path.append(node)
            out[word] = count[-1]
            if keep:
                self.terminals[word] = count[-1]
            last = word
        return out


def sentencepiece_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file in the order of their ranks, without control and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def pre_tokens(text: str) -> list[str]:
    """Runs of anything but white space, each behind MARK."""
    return [MARK + w for w in text.split()]


_kept: list = []


def _trie(scores: dict[str, float]) -> Trie:
    """One trie for each vocabulary and worker."""
    if not _kept or _kept[0] is not scores:
        _kept[:] = [scores, Trie(scores)]
    return _kept[1]


def count_tokens(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_pre_tokens`` and ``n_tokens`` of the whole text.

    A text is split at white space; a pre-token is its best segmentation under the
    unigram scores; ties go to fewer tokens. A null or empty text has none, and a very
    long one is counted whole. Repeated rows and null ids are counted like any others;
    other columns are not read; an empty table gives no rows. The scores are a vocabulary
    of fixed size and are sent once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(sent.value)
        for b in batches(it):
            texts = b.column(1)
            for at, _, off in slices(texts):
                n = len(off) - 1
                split = [pre_tokens(t or "") for t in texts.slice(at, n).to_pylist()]
                known = trie.insert(w for s in split for w in s)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array([len(s) for s in split], pa.int64()), pa.array([sum([known[w] for w in s]) for s in split], pa.int64())],
                    names=["id", "n_pre_tokens", "n_tokens"],
                )

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_pre_tokens long, n_tokens long")
