"""Token counts by a count-only Viterbi search (operator 3).

A text is cut as unigram tokenizers with a word mark cut it: each space (or literal mark) begins a chunk, spelt
with the mark for the space, and a mark is put before a text that does not begin with one. Of each chunk an
Aho-Corasick automaton over the vocabulary enumerates all pieces by their ends, longest first; dynamic
programming carries the best score and the number of pieces, nothing else. A later candidate must be strictly
better, so ties go to the piece that starts first, and a character without a piece of its own may be unknown
(its UTF-8 bytes are counted). These are the tie rules, and scores are added in the order, of the Unigram model
of the tokenizers library, which the tests compare with.

Chunks repeat, so their counts are memoised in a table of at most MEMO chunks per task process, emptied when
full; the result does not depend on it. A chunk of any length needs memory for the longest piece only.

Defined cases: null and empty texts have 0 tokens. Repeated rows count alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups, texts_of
from .vocabulary import MARK, Vocabulary

MEMO, MEMO_CHARS = 300_000, 48


class TokenCounter(dict):
    """Chunk -> number of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores, strict=True):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.ring = max(map(len, vocabulary.pieces)) + 1
        self.unknown = vocabulary.unknown

    def __missing__(self, chunk: str) -> int:
        n = self.count_chunk(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = n
        return n

    def count_chunk(self, chunk: str) -> int:
        ring, unknown = self.ring, self.unknown
        best, count = [0.0] * ring, [0] * ring  # by the end, modulo the ring's size
        done, score, pieces, single = 0, None, 0, False
        for end, (length, piece_score) in self.automaton.iter(chunk):
            end += 1
            if end != done + 1 or score is None:
                while done + 1 < end:  # ends without any piece
                    done += 1
                    at, before = done % ring, (done - 1) % ring
                    if score is not None and single:
                        best[at], count[at] = score, pieces
                    else:
                        self._unknown(chunk, done, before, at, best, count, score, pieces)
                    score, single = None, False
            start = (end - length) % ring
            candidate = piece_score + best[start]
            if score is None or candidate > score:
                score, pieces = candidate, count[start] + 1
            single = single or length == 1
        while done < len(chunk):
            done += 1
            at, before = done % ring, (done - 1) % ring
            if score is not None and single:
                best[at], count[at] = score, pieces
            else:
                self._unknown(chunk, done, before, at, best, count, score, pieces)
            score, single = None, False
        return count[len(chunk) % ring]

    def _unknown(self, chunk, done, before, at, best, count, score, pieces) -> None:
        """The end's best, when its last character is no piece: unknown is the last candidate."""
        candidate = self.unknown + best[before]
        if score is None or candidate > score:
            score, pieces = candidate, count[before] + len(chunk[done - 1].encode())
        best[at], count[at] = score, pieces

    def count(self, text: str) -> int:
        if not text:
            return 0
        chunks = text.replace(MARK, " ").split(" ")
        if chunks[0] == "" and len(chunks) > 1:
            del chunks[0]
        return sum(map(self.__getitem__, map(MARK.__add__, chunks)))


_counters: dict[Vocabulary, TokenCounter] = {}


def counter_of(vocabulary: Vocabulary) -> TokenCounter:
    """One for each task process, as building the automaton takes a while."""
    if vocabulary not in _counters:
        _counters.clear()
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and n_tokens of every row of docs, in one pass without a shuffle."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for whole in batches:
            for batch in row_groups(whole):
                n = [counter.count(t.decode("utf-8", "replace")) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_tokens long")
