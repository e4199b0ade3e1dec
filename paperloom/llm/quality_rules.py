"""Quality rules: base counts, and a calibrated logistic model on hashed n-grams of words and characters (operator 2).

Base counts are exact over the whole text. The model's rows are at most SAMPLE labelled documents, and bytes as for
the quality classifier; it is trained on three quarters of them and calibrated (Platt) on the rest. Texts are scored
in Arrow batches against the fixed threshold KEEP: base_failed rows are dropped, and of the others those whose
calibrated probability of label 1 is below KEEP.

Defined cases: null and empty texts have no words (n_words 0, base_failed). Texts of any length are read whole, some
megabytes at a time; a word takes 24 bytes, and 8 more in the search for repeated windows. 64-bit hashes of the words
stand for them in that search. An empty table gives no rows; repeated rows are judged alike; a probability equal to
KEEP is kept; without labels the model's probability is 0.5, which keeps. Other columns than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups, texts_of
from .ngrams import Logistic, Words, mix, words_of
from .quality_classifier import fit, labelled_rows

BITS, SAMPLE, KEEP, WINDOW = 17, 4000, 0.3, 5
_SPACES, _SYMBOLS, _TAIL = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_p double"


def repeat_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Of every text the words that stand in a window found twice or more in it."""
    n, doc = len(words.h) - window + 1, words.doc
    if n < 1:
        return np.zeros(words.n_texts, np.int64)
    key = mix(doc[:n].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words.h[k : n + k]
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(doc) + 1, np.int64)
    at = order[np.append(equal, False) | np.insert(equal, 0, False)] if len(order) > 1 else order[:0]
    twice[at] += 1
    twice[at + window] -= 1
    return np.bincount(doc[np.cumsum(twice[:-1]) > 0], minlength=words.n_texts)


def dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def judge(texts: list[bytes], model: Logistic) -> dict[str, np.ndarray]:
    words = words_of(texts)
    bare = [t.translate(None, _SPACES) for t in texts]
    out = {
        "n_words": words.counts,
        "word_chars": np.array([len(t.translate(None, _TAIL)) for t in bare], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeat_words(words),
    }
    failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    p = model.scores(texts, words)
    return out | {"base_failed": failed, "kept": ~failed & (p >= KEEP), "quality_p": p}


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Logistic:
    return fit(*labelled_rows(docs, labels, "quality", BITS, True, most), BITS, True)


def quality_rules(docs: DataFrame, model: Logistic) -> DataFrame:
    """The base counts, base_failed, kept and the calibrated probability: a row for every row of docs."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                found = judge(texts_of(batch), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in found.values())], ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, SCHEMA)
