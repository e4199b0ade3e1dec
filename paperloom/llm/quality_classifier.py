"""Quality classifier: hashed word n-grams, logistic regression by FTRL updates (operator 5).

Training takes at most SAMPLE labelled rows (those with the least hash of doc_id, whose crc32 modulo FOLDS is
not 0) and SAMPLE_BYTES bytes of their n-grams, which are hashed where the texts are: only the sparse rows come to
the driver. Scoring reads every whole text once, in Arrow batches, and is a sparse dot product of n-gram counts and
weights. Inputs of a score are the text alone.

Defined cases: null and empty texts have no n-grams, and get the score of the bias. Texts of any length are read
whole, some megabytes at a time; a word takes 24 bytes and the n-grams of a kind 16 each. Without labelled rows of
both classes every score is the share of label 1, or 0.5 without labels. Repeated rows score alike; rows with several
labels, or labels with several rows, train as several rows, within the bounds. Rows of equal hash are ordered by
doc_id, label and n-grams. A score equal to the threshold accepts. An empty table gives no rows. Other columns than
doc_id and text are not read; ``keep_quality`` carries them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_groups, stored, texts_of
from .ngrams import Logistic, ftrl, platt, sparse_rows

BITS, SAMPLE, SAMPLE_BYTES, FOLDS, ACCEPT = 18, 4000, 64 << 20, 5, 0.3


def fold(doc_id: Column | str) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bits: int, chars: bool, most: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list, np.ndarray]:
    """Sparse rows and labels of labelled documents in a fixed order: at most so many rows, and bytes of n-grams."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(most)  # bounded, so it is safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                found = sparse_rows(texts_of(batch), bits, chars)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["doc_id", "y", "x", "v"])

    order = [F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("x", "v")]
    # The join may give a label many rows, so the number is bounded again, and then the bytes, over that number.
    found = stored(rows.mapInArrow(of, "doc_id long, y int, x binary, v binary").orderBy(*order).limit(most), "sample")
    sizes = found.withColumn("size", F.sum(F.octet_length("x") + F.octet_length("v")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    got = sizes.where(F.col("size") <= most_bytes).drop("size").collect()
    got.sort(key=lambda r: ((r.doc_id * 0x9E3779B97F4A7C15) % (1 << 64), r.y, r.x, r.v))
    return [(np.frombuffer(r.x, np.int32).astype(np.int64), np.frombuffer(r.v, np.float32).astype(float)) for r in got], np.array([r.y for r in got], float)


def fit(rows: list, y: np.ndarray, bits: int, chars: bool) -> Logistic:
    """A model by FTRL on three quarters of the rows; the last quarter calibrates its probabilities."""
    size = (1 << bits) * (1 + chars)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Logistic(bits, chars, np.zeros(size, np.float32), float(np.log(p / (1 - p))))
    aside = np.arange(len(y)) % 4 == 3
    weights, bias = ftrl([r for r, out in zip(rows, aside, strict=True) if not out], y[~aside], size)
    logits = np.array([bias + weights[x] @ v for (x, v), out in zip(rows, aside, strict=True) if out])
    return Logistic(bits, chars, weights, bias, *platt(logits, y[aside]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Logistic:
    """The quality model, from labelled rows outside the held-out fold."""
    return fit(*labelled_rows(docs, labels.where(fold("doc_id") != 0), "quality", BITS, False, most), BITS, False)


def scored(docs: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for every row of docs."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(texts_of(batch)), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Logistic, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that score accept or more, with the columns of docs, in one pass without a shuffle."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                yield batch.filter(pa.array(model.scores(texts_of(batch)) >= accept))

    return docs.mapInArrow(of, docs.schema)
