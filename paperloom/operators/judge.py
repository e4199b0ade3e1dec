"""Judgments: the classifier seam, a local classifier in native columns, the answer cache, and the retry of what was too big."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planner import SHRINK

BUCKETS = 4096

RESULT = "doc_id long, name string, value string, confidence double, input_tokens long, error string"
_ANSWERED = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("input_tokens", pa.int64()), ("error", pa.string())])
#: Bytes of text that are made into Python's strings at one time.
PART = 1 << 20


class Classifier(Protocol):
    """The one extension point: answers a batch of requests (doc_id, name, state) with rows of RESULT."""

    def judge_batch(self, requests: pd.DataFrame) -> pd.DataFrame: ...


def judge(requests: DataFrame, classifier: Classifier) -> DataFrame:
    """Requests answered in parts of Arrow batches on the executors. Only doc_id, name and state are sent to Python."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "state"):
                answers = classifier.judge_batch(part.to_pandas())
                yield pa.RecordBatch.from_pandas(answers[_ANSWERED.names], _ANSWERED, preserve_index=False)

    return requests.select("doc_id", "name", "state").mapInArrow(of, RESULT)


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about PART bytes of the column's text, one row at least: what Python makes of a slice is
    bounded, however many long texts a batch has."""
    ends = pc.cumulative_sum(pc.binary_length(batch.column(column)).fill_null(0).cast("int64")).to_numpy()
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + PART, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class SizeLimited:
    """Any answering function behind a limit of characters: states beyond it get the error ``too_big``."""

    def __init__(self, answer: Callable[[str, str], tuple[str, float]], most: int):
        self.answer, self.most = answer, most

    def judge_batch(self, requests: pd.DataFrame) -> pd.DataFrame:
        size = requests.state.str.len()
        fits = size <= self.most
        given = [self.answer(n, s) if ok else (None, None) for n, s, ok in zip(requests.name, requests.state, fits, strict=True)]
        out = requests[["doc_id", "name"]].assign(value=[v for v, _ in given], confidence=[c for _, c in given])
        return out.assign(input_tokens=(size // 3).where(fits), error=fits.map({True: None, False: "too_big"}))


def retry_too_big(requests: DataFrame, results: DataFrame, classifier: Classifier, shrunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results, where each that was too big is replaced by one retry on a smaller state (see planner.SHRINK)."""
    again = requests.join(results.where("error = 'too_big'").select("doc_id", "name"), ["doc_id", "name"], "left_semi")
    return results.where("error is null or error <> 'too_big'").unionByName(judge(shrunk(again), classifier))


def shrunk_chars(sent: Column) -> Column:
    return F.floor(sent * SHRINK).cast("int")


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Places of the keywords in the text, without overlaps."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k) for k in keywords), F.lit(0)).cast("int")


def keyword_choice(text: Column, options: dict[str, list[str]]) -> Column:
    """struct(value, confidence, probabilities) of a choice: hits plus one, over their sum; first of equals."""
    hits = {name: keyword_hits(text, words) + 1 for name, words in options.items()}
    total = sum(hits.values())
    best = F.greatest(*hits.values())
    value = None
    for name, h in hits.items():
        value = F.when(h == best, name) if value is None else value.when(h == best, name)
    shares = F.create_map(*[x for name, h in hits.items() for x in (F.lit(name), h / total)])
    return F.struct(value.alias("value"), (best / total).alias("confidence"), shares.alias("probabilities"))


def keyword_score(text: Column, levels: list[list[str]]) -> Column:
    """struct(value, confidence, probabilities): the expected level, with probabilities by the level's index."""
    hits = [keyword_hits(text, words) + 1 for words in levels]
    total = sum(hits)
    return F.struct((sum(i * h for i, h in enumerate(hits)) / total).alias("value"), (F.greatest(*hits) / total).alias("confidence"), F.create_map(*[x for i, h in enumerate(hits) for x in (F.lit(str(i)), h / total)]).alias("probabilities"))


def keyword_noul(text: Column, yes: list[str], no: list[str]) -> Column:
    """A number from 0 to 1, without probabilities or confidence."""
    y, n = keyword_hits(text, yes) + 1, keyword_hits(text, no) + 1
    return y / (y + n)


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the kept answer, misses): by cache_key."""
    hits = requests.join(cache.select("cache_key", F.col("value").alias("cached_value")), "cache_key")
    return hits, requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Append and compact: of each key the row used last; combined before the shuffle."""
    both = cache.unionByName(new)
    return both.groupBy("cache_key").agg(F.max(F.struct("last_used", "value")).alias("x")).select("cache_key", "x.value", "x.last_used")


def cache_prune(cache: DataFrame, before: Column) -> DataFrame:
    return cache.where(F.col("last_used") >= before)


def outcome(status: Column, code: Column) -> Column:
    """The kind of a classifier's failure by HTTP status and error code."""
    return (
        F.when(status.isin(429, 529), "throttled")
        .when((status == 400) & (code == "max_tokens_exceeded"), "too_big")
        .when(status == 422, "rejected")
        .when(status >= 500, "unavailable")
        .when(status == 0, "transient")
        .when(status < 300, "ok")
        .otherwise("error")
    )


def escalation(answers: DataFrame, share: float = 0.02) -> DataFrame:
    """Answers below their threshold are flagged; the first documents up to a share of all are ``queued``, the rest ``capped``.

    The cap is a feature. Documents are not ranked in one window: counts by range of doc_id (BUCKETS of them) tell in
    which range the cap falls, and only documents of that range are numbered.
    """
    flagged = answers.where(F.col("confidence") < F.col("escalate_below"))
    docs = flagged.select("doc_id").distinct()
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    all_, low, high = answers.agg(F.countDistinct("doc_id")).first()[0], *ends.first()
    queued, capped = F.lit("queued"), F.lit("capped")
    if low is None:
        return flagged.select("doc_id", "name", "confidence", capped.alias("status"))
    most, width = math.ceil(round(all_ * share, 9)), (high - low) // BUCKETS + 1
    before, edge = 0, None
    for bucket, n in sorted(docs.groupBy(F.floor((F.col("doc_id") - low) / width).alias("b")).count().collect()):  # BUCKETS rows at most
        if before + n > most:
            edge = bucket
            break
        before += n
    if edge is None:
        return flagged.select("doc_id", "name", "confidence", queued.alias("status"))
    at = docs.where(F.col("doc_id").between(low + edge * width, low + (edge + 1) * width - 1)).orderBy("doc_id").limit(most - before)
    last = at.agg(F.max("doc_id")).first()[0]
    last = last if last is not None else low + edge * width - 1
    return flagged.select("doc_id", "name", "confidence", F.when(F.col("doc_id") <= last, queued).otherwise(capped).alias("status"))
