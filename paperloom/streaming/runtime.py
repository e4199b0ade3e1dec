"""Runtime state over event logs: rate limits, leases, stalls, crash rates, progress. Batch folds and streaming forms.

Folds depend on order, so each limiter (``key``) is one group; a log holds as many limiters as runners, and a
group streams through the fold in batches, sorted by the shuffle, never held whole.
"""

from __future__ import annotations

import heapq
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CEILING, CUT, RISE, FLOOR, QUIET, IN_FLIGHT = 0.8, 0.7, 0.05, 0.05, 60.0, 64
BACKOFF, BACKOFF_MOST = 0.5, 5.0
STALL_S, CRASH_SHARE, TTL_S = 900, 0.05, 30


def backoff(tries: Column) -> Column:
    return F.least(BACKOFF * F.pow(F.lit(2.0), tries), F.lit(BACKOFF_MOST))


def ceiling(limit: Column) -> Column:
    return limit * CEILING


def document_timeout(pages: Column, per_page: float, base: float = 60, cap: float = 1800) -> Column:
    return F.least(F.lit(cap), base + per_page * pages)


def worker_count(cores: int, ram_mb: int, each_mb: int, quality: bool = False) -> int:
    return max(1, min(cores // 4 if quality else cores - 1, ram_mb // each_mb))


@dataclass(order=True)
class _Sent:
    """A request that is in flight, in the order of its response."""

    done: float
    order: int
    episode: int = field(compare=False)
    call: _Call = field(compare=False)


@dataclass
class _Call:
    """A request with what the log knows of it: how many of its first attempts are throttled, or fail for a moment."""

    seq: int
    joined: float
    tokens: float
    actual: float | None = None
    seconds: float = 0.0
    throttled: int = 0
    transient: int = 0
    retry_after: float | None = None
    priority: bool = False
    attempts: int = 0
    started: float | None = None


class Limiter:
    """Token and request buckets of one second's worth under one adaptive factor, as a simulation of events.

    Requests wait in one line, those with priority first; the first of the line starts once nothing blocks it: the
    wait after a throttled response, the number in flight, either bucket. A response gives back what its request cost
    less than estimated (or all, if it failed). A throttled one cuts the factor, but only if its request began after
    the last cut, so that an episode cuts once; its request joins the line again. Quiet minutes raise the factor.
    """

    def __init__(self, tokens_s: float, requests_s: float, in_flight: int = IN_FLIGHT):
        self.tokens_s, self.requests_s, self.most = tokens_s, requests_s, in_flight
        self.factor, self.eased, self.episode, self.blocked = 1.0, 0.0, 0, 0.0
        self.have_tokens, self.have_requests, self.at = tokens_s, max(1.0, requests_s), 0.0
        self.now, self.order = 0.0, 0
        self.line: list[tuple[bool, int, _Call]] = []
        self.sent: list[_Sent] = []
        self.asleep: list[tuple[float, int, _Call]] = []

    def _state(self, now: float) -> tuple[float, float, float, float]:
        """(factor, eased, tokens, requests) at a time from which nothing has been charged since the last."""
        factor, eased = self.factor, self.eased
        while factor < 1.0 and now - eased >= QUIET:
            factor, eased = min(1.0, factor + RISE), eased + QUIET
        passed = max(0.0, now - self.at)
        tokens = min(self.tokens_s * factor, self.have_tokens + passed * self.tokens_s * factor)
        return factor, eased, tokens, min(max(1.0, self.requests_s * factor), self.have_requests + passed * self.requests_s * factor)

    def _settle_at(self, now: float) -> None:
        self.factor, self.eased, self.have_tokens, self.have_requests = self._state(now)
        self.at = self.now = now

    def _start(self) -> float:
        """When the first of the line may start, if nothing else happens before."""
        if not self.line or len(self.sent) >= self.most:
            return math.inf
        call = self.line[0][2]
        now = max(self.now, call.joined, self.blocked)
        while True:
            factor, _, tokens, requests = self._state(now)
            wait = max((min(call.tokens, self.tokens_s * factor) - tokens) / (self.tokens_s * factor), (1.0 - requests) / (self.requests_s * factor))
            if wait <= 1e-9:
                return now
            now += wait

    def join(self, call: _Call) -> None:
        heapq.heappush(self.line, (not call.priority, self.order, call))
        self.order += 1

    def run(self, until: float = math.inf) -> Iterator[tuple[_Call, float, float]]:
        """Calls that are answered by then, in order, with their time and the factor after it."""
        while True:
            start, done = self._start(), self.sent[0].done if self.sent else math.inf
            wake = self.asleep[0][0] if self.asleep else math.inf
            if min(start, done, wake) > until or start == done == wake == math.inf:
                return
            if wake <= min(start, done):
                self.join(heapq.heappop(self.asleep)[2])
            elif done <= start:
                answered = self._answer(heapq.heappop(self.sent))
                if answered:
                    yield answered
            else:
                self._settle_at(start)
                call = heapq.heappop(self.line)[2]
                self.have_tokens -= call.tokens
                self.have_requests -= 1.0
                call.started = start if call.started is None else call.started
                heapq.heappush(self.sent, _Sent(start + call.seconds, self.order, self.episode, call))
                self.order += 1

    def _answer(self, sent: _Sent) -> tuple[_Call, float, float] | None:
        call, now = sent.call, sent.done
        self._settle_at(now)
        call.attempts += 1
        if call.attempts > call.throttled + call.transient:
            if call.actual is not None:
                self._credit(call.tokens - call.actual)
            return call, now, self.factor
        self._credit(call.tokens)
        call.joined = now
        if call.attempts <= call.throttled:
            if sent.episode == self.episode:
                self.factor, self.eased, self.episode = max(FLOOR, self.factor * CUT), now, self.episode + 1
                self._credit(0.0)
            wait = call.retry_after if call.retry_after is not None else min(BACKOFF * 2.0 ** (call.attempts - 1), BACKOFF_MOST)
            self.blocked = max(self.blocked, now + wait)
            self.join(call)
        else:
            call.joined = now + min(BACKOFF * 2.0 ** (call.attempts - call.throttled - 1), BACKOFF_MOST)
            heapq.heappush(self.asleep, (call.joined, self.order, call))
            self.order += 1
        return None

    def _credit(self, tokens: float) -> None:
        self.have_tokens = min(self.tokens_s * self.factor, self.have_tokens + tokens)

    def answers(self, calls: Iterable[_Call]) -> Iterator[tuple[_Call, float, float]]:
        """All calls, which come in order of joining, as they are answered. Calls in line and in flight are held."""
        for call in calls:
            yield from self.run(call.joined)
            self.join(call)
        yield from self.run()


def schedule(requests: DataFrame, tokens_s: float, requests_s: float, in_flight: int = IN_FLIGHT) -> DataFrame:
    """key, seq, started, done, attempts, factor of requests (key, seq, at, tokens, actual, seconds, throttled,
    transient, retry_after, priority), each key's in order of at and seq. throttled and transient are numbers of
    attempts. A key is one limiter; its log streams through one task, as what it admits depends on all before."""

    sorted_ = requests.select("key", "seq", "at", "tokens", "actual", "seconds", "throttled", "transient", "retry_after", "priority").repartition("key").sortWithinPartitions("key", "at", "seq")
    names = ["key", "seq", "started", "done", "attempts", "factor"]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter, current = None, object()
        out: list[list] = [[] for _ in names]

        def put(answers: Iterable[tuple[_Call, float, float]]) -> None:
            for call, done, factor in answers:
                for column, x in zip(out, (current, call.seq, call.started, done, call.attempts, factor), strict=True):
                    column.append(x)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64()), strict=True)], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for key, *rest in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if key != current:
                    if limiter:
                        put(limiter.run())
                    limiter, current = Limiter(tokens_s, requests_s, in_flight), key
                call = _Call(*rest)
                put(limiter.run(call.joined))
                limiter.join(call)
            yield flush()
        if limiter:
            put(limiter.run())
            yield flush()

    return sorted_.mapInArrow(partition, "key long, seq long, started double, done double, attempts int, factor double")


def leases(events: DataFrame, ttl: float = TTL_S) -> DataFrame:
    """resource, seq, granted, holder after each event (resource, seq, at, actor, action) in order of seq.

    acquire: granted if free, the actor's own, or expired. heartbeat: only the holder's, and only unexpired.
    release: the holder's.
    """

    names = ["resource", "seq", "granted", "holder"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, holder, beat = object(), None, 0.0
        for batch in batches:
            granted_, holders = [], []
            for resource, at, actor, action in zip(*(batch.column(c).to_pylist() for c in ("resource", "at", "actor", "action")), strict=True):
                if resource != current:
                    current, holder, beat = resource, None, 0.0
                live = holder is not None and at - beat <= ttl
                granted = (not live or holder == actor) if action == "acquire" else holder == actor and (live or action == "release")
                if granted:
                    holder, beat = (None, 0.0) if action == "release" else (actor, at)
                granted_.append(bool(granted))
                holders.append(holder)
            yield pa.RecordBatch.from_arrays([batch.column("resource"), batch.column("seq"), pa.array(granted_, pa.bool_()), pa.array(holders, pa.int64())], names)

    rows = events.select("resource", "seq", "at", "actor", "action").repartition("resource").sortWithinPartitions("resource", "seq")
    return rows.mapInArrow(of, "resource long, seq long, granted boolean, holder long")


def stalls(log: DataFrame, gap_s: int = STALL_S) -> DataFrame:
    """key, ts, gap_s of successes that come gap_s seconds or more after the one before.

    With a column active_from (when the work underway at ts began, after an idle time) a gap counts from there, as an
    idle limiter is not stalled.
    """
    w = Window.partitionBy("key").orderBy("ts", "seq")
    at = F.col("ts").cast("timestamp").cast("double")
    since = F.lag(at).over(w)
    if "active_from" in log.columns:
        since = F.greatest(since, F.col("active_from").cast("timestamp").cast("double"))
    return log.withColumn("gap_s", at - since).where(F.col("gap_s") >= gap_s).select("key", "ts", "gap_s")


def crash_rate(log: DataFrame, share: float = CRASH_SHARE) -> DataFrame:
    """key, seq, rate, cancel: crashes over finished so far; a job is cancelled, and stays so, once the rate reaches share."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rated = log.select("key", "seq", (F.sum(F.col("crashed").cast("int")).over(w) / F.count("*").over(w)).alias("rate"))
    return rated.withColumn("cancel", F.max(F.col("rate") >= share).over(w))


def throughput(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, outcome, n, tokens of event-time windows. With ``late`` (a stream) a watermark bounds the state."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "outcome").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "outcome", "n", "tokens")


def activity_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything available through a stream into Parquet, exactly once; the checkpoint resumes it. Returns the query."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share. In local mode, where it is unset, a temporary
    one; on a cluster that is an error, as no other machine could read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replay(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The final rows of a windowed aggregation under a watermark, over all that is available. Append mode writes a
    window once, when the watermark has passed it, and drops its state; windows that are still open at the end are not
    written, so a stream that has come to its end is closed first (drain)."""
    run_available(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drain(stream: DataFrame, column: str, path: str, beyond: str = "365 days") -> None:
    """A bounded stream's rows at path in order of time, one file for an ordered range, then one row of nulls with a
    time beyond all others, with which the watermark of a stream over path passes every window."""
    rows = stream.sparkSession.read.schema(stream.schema)
    run_available(stream, f"{path}-rows", f"{path}-checkpoint")
    held = rows.parquet(f"{path}-rows")
    held.repartitionByRange(8, column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)
    last = held.agg(F.max(column).alias("t")).select((F.col("t") + F.expr(f"interval {beyond}")).alias(column))
    end = last.select(*[F.col(c) if c == column else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns])
    end.where(F.col(column).isNotNull()).coalesce(1).write.mode("append").parquet(path)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str):
    """A stream of record versions; each batch replaces its own folder, so a retried batch is not counted twice."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
