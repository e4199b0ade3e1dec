"""A unigram vocabulary from the pieces of a public tokenizer file; nothing is trained here.

The file's pieces keep their ids. Its scores are merge ranks, not probabilities, so piece r in rank order gets
the log-probability of Zipf's law, -log(r + SHIFT) less the log of the sum; special and byte pieces get the
least score. An unknown character costs the least score less UNKNOWN and becomes its UTF-8 bytes' pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MARK, SHIFT, UNKNOWN = "▁", 10.0, 10.0
DEFAULT = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores by id. byte_ids: the ids of the pieces of bytes 0..255."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    special: frozenset[int]

    @property
    def unknown(self) -> float:
        return min(self.scores) - UNKNOWN


def zipf(pieces: list[str], special: set[int], byte_ids: list[int]) -> Vocabulary:
    apart = special | set(byte_ids)
    ranks = [i for i in range(len(pieces)) if i not in apart]
    raw = -np.log(np.arange(len(ranks)) + SHIFT)
    raw -= np.log(np.exp(raw).sum())
    scores = np.full(len(pieces), raw.min() if len(raw) else 0.0)
    scores[ranks] = raw
    return Vocabulary(tuple(pieces), tuple(scores.tolist()), tuple(byte_ids), frozenset(special))


def load(path: str = DEFAULT) -> Vocabulary:
    """Read on the driver; tasks get the vocabulary, whose size is fixed, with their code."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i)}
    return zipf([m.id_to_piece(i) for i in range(n)], special, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
