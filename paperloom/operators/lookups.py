"""Join-shaped and rank-shaped lookups around a job: overrides, exhibits, first places, mounts, samples, and counts of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_overrides(inputs: DataFrame, overrides: DataFrame, *settings: str) -> DataFrame:
    """inputs (ref and settings), where an override for the ref replaces each setting it gives."""
    given = overrides.select("ref", *[F.col(s).alias(f"__{s}") for s in settings])
    rest = [c for c in inputs.columns if c not in settings]
    return inputs.join(given, "ref", "left").select(*rest, *[F.coalesce(f"__{s}", s).alias(s) for s in settings])


def stray_overrides(inputs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose ref is no input."""
    return overrides.join(inputs.select("ref"), "ref", "left_anti")


def exhibits(docs: DataFrame) -> DataFrame:
    """doc_id, exhibit_id of documents (doc_id, group, main) that share a main document's group."""
    main = docs.where("main").select("group", "doc_id")
    return main.join(docs.where("not main").select("group", F.col("doc_id").alias("exhibit_id")), "group").select("doc_id", "exhibit_id")


def first_place(places: DataFrame, key: str) -> DataFrame:
    """Of every key the place with the least priority; combined before the shuffle."""
    return places.groupBy(key).agg(F.min_by("place", F.struct("priority", "place")).alias("place"))


def first_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of every key; ranks are limited before the shuffle."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__k") <= n).drop("__k")


def longest_mount(path: Column, mounts: list[tuple[str, str]]) -> Column:
    """The file system of the longest mount point that is the path or above it; the table is a machine's few mounts."""
    out = F.lit(None).cast("string")
    for point, kind in sorted(mounts, key=lambda m: len(m[0])):
        above = point.rstrip("/") + "/"
        out = F.when((path == point) | path.startswith(above), kind).otherwise(out)
    return out


def change_counts(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """change (added, removed, changed, same) and n, comparing columns of the rows with equal keys."""
    digest = F.xxhash64(*columns)
    both = before.select(key, digest.alias("b"), F.lit(1).alias("hb")).join(after.select(key, digest.alias("a"), F.lit(1).alias("ha")), key, "full")
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ha").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def duplicate_names(names: DataFrame) -> DataFrame:
    """Names that stand more than once in one namespace, once each."""
    return names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
