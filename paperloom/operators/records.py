"""Document records and the job store: assembly, upserts, filters, exports, retention, and the control tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SCHEMA_VERSION, TERMINAL


def latest_records(versions: DataFrame) -> DataFrame:
    """Of each doc_id the row with the largest version (an upsert); the rows are combined before the shuffle."""
    rest = [c for c in versions.columns if c not in ("doc_id", "version")]
    return versions.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("doc_id", "r.*")


def answer_values(records: DataFrame) -> DataFrame:
    """doc_id, name, value of every answer that was not skipped."""
    rows = records.select("doc_id", F.explode("answers").alias("name", "a"))
    return rows.where("a.skipped is null").select("doc_id", "name", F.coalesce(F.col("a.value_str"), F.col("a.value_num").cast("string")).alias("value"))


def find_documents(records: DataFrame, *, status: str | None = None, escalation: str | None = None, category: str | None = None, least: float | None = None, most: float | None = None, answer: tuple[str, str] | None = None, answers: DataFrame | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Records that meet all predicates given, bounds included; a null confidence meets no bound. In order of seq.

    after and limit page through the result by seq.
    """
    tests: list[Column] = [F.col("status").isNotNull()]
    tests += [F.col(c) == v for c, v in (("status", status), ("escalation_status", escalation), ("category", category)) if v is not None]
    tests += [F.col("confidence") >= least] if least is not None else []
    tests += [F.col("confidence") <= most] if most is not None else []
    tests += [F.col("seq") > after] if after is not None else []
    out = records.where(reduce(lambda a, b: a & b, tests))
    if answer is not None:
        out = out.join(answers.where((F.col("name") == answer[0]) & (F.col("value") == answer[1])).select("doc_id"), "doc_id", "left_semi")
    out = out.orderBy("seq")
    return out.limit(limit) if limit is not None else out


def failed_record(doc_id: Column, stage: str, code: str, message: Column) -> Column:
    return F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), doc_id.cast("string").alias("record_id"), F.lit("failed").alias("status"), F.array(F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), message.alias("message"), F.lit(None).cast("int").alias("page"))).alias("errors"))


def without_text(records: DataFrame) -> DataFrame:
    return records.drop("text")


def export_json(records: DataFrame, path: str, include_text: bool = True) -> None:
    """A JSON object a line; nulls are left out."""
    (records if include_text else without_text(records)).write.mode("errorifexists").json(path)


def add_documents(known: DataFrame, new: DataFrame) -> DataFrame:
    """New documents that the store does not have yet."""
    return new.dropDuplicates(["doc_id"]).join(known.select("doc_id"), "doc_id", "left_anti")


def retention(jobs: DataFrame, now: Column, days: int, kind: str | None = None) -> DataFrame:
    """Finished jobs that are older than so many days and not pruned yet."""
    due = F.col("state").isin(*TERMINAL) & (F.col("finished_at") <= now - F.make_dt_interval(F.lit(days))) & ~F.col("pruned")
    return jobs.where(due & (F.col("kind") == kind) if kind else due)


def list_jobs(jobs: DataFrame, include_ingest: bool = False) -> DataFrame:
    return (jobs if include_ingest else jobs.where("kind <> 'ingest'")).orderBy("seq")


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job: a top-1, not a sort of all."""
    return jobs.where("state = 'queued'").orderBy("seq").limit(1)


def priority_order(requests: DataFrame) -> DataFrame:
    """position of each request: those with priority first, then by arrival. Positions are by queue, which bounds the sort."""
    return requests.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "seq")))


def sample_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows with the least digests of doc_id and seed: the same ones on any layout."""
    return rows.orderBy(F.md5(F.concat_ws("-", "doc_id", F.lit(seed))), "doc_id").limit(n)


def usage_totals(answers: DataFrame, *by: str) -> DataFrame:
    """Requests, tokens and cache hits. A request is counted once for the group of answers it gave."""
    return answers.groupBy(*by).agg(F.countDistinct("request_id").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.count_if("cached").alias("cache_hits"))


def price(tokens: Column, usd_per_million: float = 0.042, cached: Column | None = None) -> Column:
    cost = tokens * usd_per_million / 1e6
    return cost if cached is None else F.when(cached, 0.0).otherwise(cost)
