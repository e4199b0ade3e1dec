"""Words, shapes and hashed n-grams of many texts at once, in numpy, and logistic models on them.

Bytes are looked at SEGMENT at a time; of a whole text three numbers of 8 bytes are held for every word (the text's
number, hash and shape), and two for every n-gram of a kind while that kind is counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

SEGMENT = 2 << 20
_SPACE = re.compile(rb"[\x09-\x0d ]")
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = np.ones(256, np.int8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
#: Classes of a byte: 0 capital, 1 small, 2 digit, 3 beyond ASCII, 4 stop, 5 exclamation, 6 symbol.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\""]], _CLASS[ord("!")] = 4, 5
_PACKED = np.zeros(256, np.uint64)
for _k in range(4):
    _PACKED[_CLASS == _k] = 1 << (16 * _k)
_power = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["pow"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _power[name] = np.cumprod(x, dtype=np.uint64)
    return _power["pow"][:n], _power["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: each bit of h reaches the upper bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _MULT
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """Of every word in order: the text's number, a 64-bit hash of its bytes, and a code of its shape."""

    n_texts: int
    doc: np.ndarray
    h: np.ndarray
    shape: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_texts)


def _segments(texts: list[bytes]):
    """Joined pieces of texts, cut at white space: (buffer, starts, text numbers)."""
    held, starts, docs, size = [], [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT:
                found = _SPACE.search(text, at + SEGMENT)
                end = found.start() if found else end
            if size and size + end - at > SEGMENT:
                yield b" ".join(held), starts, docs
                held, starts, docs, size = [], [], [], 0
            held.append(text[at:end])
            starts.append(size)
            docs.append(i)
            size += end - at + 1
            at = end + 1 if end < len(text) else end
    if held:
        yield b" ".join(held), starts, docs


def words_of(texts: list[bytes]) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts."""
    doc, hashes, shapes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for buffer, piece_starts, piece_docs in _segments(texts):
        b = np.frombuffer(buffer, np.uint8)
        edge = np.diff(_WORD[b], prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            continue
        pw, inv = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * pw[: len(b)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * inv[start]))
        doc.append(np.asarray(piece_docs)[np.searchsorted(piece_starts, start, "right") - 1])
        np.cumsum(_PACKED[b], out=total[1:])
        packed = total[end] - total[start]
        upper, lower, digit, other = (((packed >> _U(16 * k)) & _U(0xFFFF)).astype(np.int64) for k in range(4))
        n = end - start
        shape = _CLASS[b[start]].astype(np.uint64) * _U(7) + _CLASS[b[end - 1]]
        shape = shape * _U(2) + ((upper > 1) & (lower == 0))
        shape = shape * _U(2) + (digit > 0)
        shape = shape * _U(3) + np.minimum(2, n - upper - lower - digit - other).clip(0).astype(np.uint64)
        shapes.append(shape * _U(4) + np.searchsorted([2, 5, 12], n).astype(np.uint64))
    return Words(len(texts), np.concatenate(doc), np.concatenate(hashes), np.concatenate(shapes))


def word_features(words: Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of hashed n-grams: of words (1, 2), of shapes (1, 2, 3), and of repeats."""
    doc, h, s = words.doc, words.h, mix(words.shape + _U(77))
    down = _U(64 - bits)
    out = [(doc, mix(h) >> down), (doc, mix(s) >> down)]
    if len(doc) > 1:
        same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        d = doc[same]
        out.append((d, mix(h[same] + _MULT * h[same - 1]) >> down))
        out.append((d, mix(s[same] + _MULT * s[same - 1] + _U(1)) >> down))
        three = same[np.flatnonzero(doc[np.maximum(same, 2) - 2] == doc[same])]
        three = three[three >= 2]
        out.append((doc[three], mix(s[three] + _MULT * (s[three - 1] + _MULT * s[three - 2]) + _U(2)) >> down))
        for gap in (1, 2, 3):  # a word n-gram whose ends are the same word, whichever it is
            again = np.flatnonzero((h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])) + gap
            out.append((doc[again], np.full(len(again), mix(np.array([gap], np.uint64) + _U(991))[0] >> down)))
    return [(d, x.astype(np.int64)) for d, x in out]


def char_features(texts: list[bytes], bits: int, n: int = 4):
    """(text number, buckets) of hashed n-grams of bytes, a bounded piece of a text at a time."""
    down = _U(64 - bits)
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - n + 1), SEGMENT // 4):
            b = np.frombuffer(text[at : at + SEGMENT // 4 + n - 1], np.uint8)
            if len(b) >= n:
                gram = np.zeros(len(b) - n + 1, np.uint64)
                for k in range(n):
                    gram = (gram << _U(8)) | b[k : len(b) - n + 1 + k]
                yield i, ((gram + _U(n)) * _MULT >> down).astype(np.int64)


def sparse_rows(texts: list[bytes], bits: int, chars: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every text its buckets and their values: n-grams over the number of words (of characters)."""
    words = words_of(texts)
    n = np.maximum(1, words.counts)
    key = np.concatenate([d.astype(np.int64) << 32 | x for d, x in word_features(words, bits)])
    key, count = np.unique(key, return_counts=True)
    ends = np.searchsorted(key >> 32, np.arange(words.n_texts + 1))
    rows = [(key[a:b] & 0xFFFFFFFF, count[a:b] / n[i]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    if chars:
        size = 1 << bits
        parts: dict[int, list[np.ndarray]] = {}
        for i, x in char_features(texts, bits):
            parts.setdefault(i, []).append(x)
        for i, xs in parts.items():
            x, c = np.unique(np.concatenate(xs), return_counts=True)
            rows[i] = (np.concatenate([rows[i][0], x + size]), np.concatenate([rows[i][1], c / c.sum()]))
    return rows


@dataclass
class Logistic:
    """weights over word buckets, then (chars) over character buckets; logit = a * (bias + w.x) + b."""

    bits: int
    chars: bool
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def scores(self, texts: list[bytes], words: Words | None = None) -> np.ndarray:
        """Probabilities, as sparse dot products of the texts' n-grams with the weights."""
        words = words or words_of(texts)
        total = np.zeros(len(texts))
        for doc, x in word_features(words, self.bits):
            total += np.bincount(doc, weights=self.weights[x], minlength=len(texts))
        total /= np.maximum(1, words.counts)
        if self.chars:
            sums, n, tail = np.zeros(len(texts)), np.zeros(len(texts)), self.weights[1 << self.bits :]
            for i, x in char_features(texts, self.bits):
                sums[i] += tail[x].sum(dtype=np.float64)
                n[i] += len(x)
            total += sums / np.maximum(1, n)
        return sigmoid(self.a * (total + self.bias) + self.b)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by follow-the-regularised-leader updates, a row at a time (McMahan et al., 2013)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    data = [(np.append(x, size), np.append(v, 1.0)) for x, v in rows]
    for _ in range(epochs):
        for (x, v), label in zip(data, y, strict=True):
            w = weights(x)
            g = (sigmoid(w @ v) - label) * v
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - sigma * w
            n[x] += g * g
    every = weights(np.arange(size + 1))
    return every[:size].astype(np.float32), float(every[size])


def platt(logits: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a * logit + b): Platt's targets, Newton steps, a kept positive."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([logits, np.ones_like(logits)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(w @ x)
        hess = (x * (p * (1 - p))) @ x.T + np.eye(2) * 1e-3
        step = np.linalg.solve(hess, x @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])
