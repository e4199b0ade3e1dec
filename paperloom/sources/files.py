"""Files as documents: scans of bytes, source metadata, content-addressed copies, and changes since they were recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import SECTORS


def scan_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content of files; only the columns in use are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def source_struct(path: Column, content: Column, group: Column | None = None) -> Column:
    """filename, format, sha256, bytes, group of a file."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(ending.isin("htm", "html"), "html").otherwise(F.nullif(ending, F.lit("")))
    return F.struct(name.alias("filename"), kind.alias("format"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"), (F.lit(None).cast("string") if group is None else group).alias("group"))


def title_or_stem(title: Column, path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def content_addressed(files: DataFrame) -> DataFrame:
    """One row of every content: sha256, content. Equal contents are combined in each task, then one of each task is
    shuffled; use content_digests where the contents themselves are not needed."""
    return files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])


def content_digests(files: DataFrame) -> DataFrame:
    """sha256 and bytes of every different content; only digests are shuffled."""
    return files.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")).distinct()


def changes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """ref, and whether the file recorded under it (sha256, bytes) is unchanged, changed or missing."""
    now = current.select("ref", F.col("sha256").alias("now_sha256"), F.col("bytes").alias("now_bytes"))
    state = F.when(F.col("now_sha256").isNull(), "missing").when((F.col("bytes") != F.col("now_bytes")) | (F.col("sha256") != F.col("now_sha256")), "changed").otherwise("unchanged")
    return recorded.join(now, "ref", "left").select("ref", state.alias("state"))


def sector_from_sic(sic: Column) -> Column:
    out = F
    for low, high, name in SECTORS:
        out = out.when(sic.between(low, high), name)
    return out.otherwise("other")


def latest_by(files: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of every key; ranks are limited before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return files.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
