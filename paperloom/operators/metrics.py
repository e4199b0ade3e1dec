"""Evaluation and job summaries. Aggregates combine before their shuffles; thresholds come from sorted counts, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy_f1(gold: DataFrame) -> DataFrame:
    """accuracy and macro_f1 over classes, from counts by (truth, predicted)."""
    pairs = gold.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    by_truth = pairs.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = pairs.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("p"))
    f1 = by_truth.join(by_guess, "c", "left").select("t", "hit", (2 * F.col("hit") / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("f1"))
    return f1.agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def brier_ece(gold: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error of confidences against correctness."""
    right = (F.col("truth") == F.col("predicted")).cast("double")
    rows = gold.select(right.alias("right"), "confidence", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin"))
    per = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("right").alias("acc"), F.avg("confidence").alias("conf"), F.sum(F.pow(F.col("confidence") - F.col("right"), 2)).alias("sq"))
    return per.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def accuracy_vs_coverage(gold: DataFrame) -> DataFrame:
    """For each confidence level: the share answered at it or above, and their accuracy. Levels are aggregated first."""
    level = F.floor(F.col("confidence") * 100).cast("int")
    per = gold.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("predicted")).cast("int")).alias("hit"))
    down = Window.orderBy(F.desc("level"))  # at most 101 rows
    whole = Window.partitionBy()
    return per.select("level", (F.sum("n").over(down) / F.sum("n").over(whole)).alias("coverage"), (F.sum("hit").over(down) / F.sum("n").over(down)).alias("accuracy"))


def calibrate(reviews: DataFrame, target: float, least: int = 50) -> DataFrame:
    """threshold: the least confidence level at and above which weighted accuracy reaches target; null below ``least`` reviews.

    weight is the inverse of a review's chance of selection.
    """
    level = F.floor(F.col("confidence") * 100).cast("int")
    per = reviews.groupBy(level.alias("level")).agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("weight")).otherwise(0.0)).alias("hit"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("level"))
    sums = per.select("level", (F.sum("hit").over(down) / F.sum("w").over(down)).alias("acc"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return sums.agg(F.min(F.when((F.col("acc") >= target) & (F.col("all") >= least), F.col("level") / 100)).alias("threshold"))


def overlap_share(a: Column, b: Column) -> Column:
    """Of two spans: the shared length over the longer one."""
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return both / F.greatest(a["end"] - a["start"], b["end"] - b["start"], F.lit(1))


def section_metrics(found: DataFrame, truth: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """key, precision, recall, agreed (share of matches whose ends are within a tenth of the length)."""
    both = truth.alias("t").join(found.alias("f"), ["doc_id", "key"], "full")
    long = F.col("t.end") - F.col("t.start")
    near = (F.abs(F.col("f.start") - F.col("t.start")) <= tolerance * long) & (F.abs(F.col("f.end") - F.col("t.end")) <= tolerance * long)
    hit = F.col("t.start").isNotNull() & F.col("f.start").isNotNull()
    return both.groupBy("key").agg((F.count_if(hit) / F.count("f.start")).alias("precision"), (F.count_if(hit) / F.count("t.start")).alias("recall"), (F.count_if(hit & near) / F.count_if(hit)).alias("agreed"))


def job_summary(log: DataFrame) -> DataFrame:
    """outcome (null: all), n, tokens, seconds at the median and the 95th percentile.

    Percentiles are of counts by value, which are aggregated first: a task holds a group's different
    values in steps of a millisecond, never its rows.
    """
    counts = log.groupBy("outcome", F.round("seconds", 3).alias("seconds")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    at = lambda p: F.percentile("seconds", p, F.col("n"))
    return counts.rollup("outcome").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), at(0.5).alias("p50_s"), at(0.95).alias("p95_s"))


def failures_by_reason(log: DataFrame, examples: int = 3) -> DataFrame:
    """reason, n, and the first documents as examples; no more than those are held for a reason."""
    w = Window.partitionBy("reason").orderBy("doc_id", "seq")
    counts = log.groupBy("reason").agg(F.count("*").alias("n"))
    first = log.withColumn("k", F.row_number().over(w)).where(F.col("k") <= examples).groupBy("reason").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    return counts.join(first, "reason")
