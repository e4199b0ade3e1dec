"""Exact deduplication by keyed streaming state (operator 10). DataFrame and SQL functions only.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. Of equal texts
the row with the largest doc_id stays.

1. One pass writes a log: doc_id, SHA-256, length and a 64-bit hash of the normalised text, and the content locator,
   which is the file that holds the row and the row's number in it.
2. A streaming aggregation reads the log in micro-batches. Its RocksDB state, which never expires, holds for each
   (digest, length) the row that stays so far (the stable identifier, the largest doc_id, with its locator) and the
   number of rows. Rows are combined before the shuffle, so a hot group sends one row a task. Each batch's changes
   are saved under its number, so a query that is started again on the same folder goes on where it was stopped,
   and a batch that is run twice counts once.
3. Full bytes are checked on hits alone, which are digests of two rows or more: a filter of fixed size lets other
   texts pass unread. Hits are grouped by digest and text, combined before the shuffle, and a digest with more than
   one text is a false hit. Such groups are dealt with again by the text itself.

``exact_dedup`` returns the located rows: those whose locator the state holds.

Defined cases: an empty table gives no rows. Null and empty texts are equal. Texts of any length are read whole. Rows
with the same doc_id and text are one document that is stored more than once: group_size counts each, all are kept or
dropped alike in the report, and ``exact_dedup`` returns one of them, that with the largest locator. A null doc_id is
smaller than any other; a group of null ids alone has a null keep_id and is kept (``exact_dedup`` returns one row).
Extra columns are carried by ``exact_dedup``, whatever their names; only a table read from files has locators, so any
other is first written to the shared folder.
"""

from __future__ import annotations

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import fresh, lower_az, quoted, shared_dir, split_by_filter, stored

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB on disk for every partition
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


@contextlib.contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


KEY = ["digest", "n_bytes"]


def located(docs: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """docs with a locator (file, row in it) of every row, in two columns of the names returned."""
    names = fresh(docs.columns, "file", "row")

    def place(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")  # of the scan, also where a column of docs has that name
        return df.select(*quoted(docs.columns), meta["file_path"].alias(names[0]), meta["row_index"].alias(names[1]))

    with contextlib.suppress(AnalysisException):  # not read from files, or no longer
        return place(docs), names
    if not _exists(docs.sparkSession, f"{folder}/rows/_SUCCESS"):
        docs.write.mode("overwrite").parquet(f"{folder}/rows")
    return place(docs.sparkSession.read.schema(docs.schema).parquet(f"{folder}/rows")), names


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _stored_once(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at path, written unless an earlier run has finished it."""
    if not _exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_state(log: str, rows: DataFrame, folder: str, files_per_batch: int = 2000) -> DataFrame:
    """digest, n_bytes, keep (id, file, row), n of all rows in the log: a stateful streaming query, which goes on with
    what is left of the log when it is started again on the same folder."""
    spark = rows.sparkSession

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

    with _conf(spark, STATE):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
        row = F.struct(F.col("doc_id").alias("id"), "file", "row")
        state = stream.groupBy(*KEY).agg(F.max(row).alias("keep"), F.count("*").alias("n"))
        query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    saved = StructType([*state.schema.fields, StructField("batch", IntegerType())])
    if not _exists(spark, f"{folder}/state"):  # an empty log has no batch
        return spark.createDataFrame([], state.schema)
    changes = spark.read.schema(saved).parquet(f"{folder}/state")
    last = changes.agg(F.max("batch")).first()[0]
    if not last:
        return changes.drop("batch")
    return changes.groupBy(*KEY).agg(F.max(F.struct("batch", "keep", "n")).alias("s")).select(*KEY, "s.keep", "s.n")


def groups(docs: DataFrame, folder: str | None = None, files_per_batch: int = 2000) -> tuple[DataFrame, DataFrame, list[str]]:
    """(log, docs with locators, the locators' names). The log has of every row doc_id, digest, n_bytes, its locator
    (file, row), and of its group keep (id, file, row) and n. A folder of an earlier run that was stopped is resumed."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows, names = located(docs, folder)
    text = lower_az(F.col("text"))
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), *[F.col(f"`{n}`").alias(c) for n, c in zip(names, ("file", "row"), strict=True)])
    log = _stored_once(found.select("doc_id", F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("x"), "file", "row"), f"{folder}/log")
    state = _stored_once(stream_state(f"{folder}/log", log, folder, files_per_batch), f"{folder}/groups")
    out = log.join(state, KEY).select("doc_id", *KEY, "file", "row", "keep", "n")
    # Full bytes of the hits: equal rows are combined before the shuffle, so a group sends about one text a task.
    hits = _stored_once(log.join(state.where("n > 1").select(*KEY), KEY, "left_semi").select("x").distinct(), f"{folder}/hits")
    doubtful = split_by_filter(found, F.xxhash64("t"), hits)[1].withColumn("digest", F.sha2("t", 256)).withColumn("n_bytes", F.octet_length("t").cast("long"))
    texts = doubtful.groupBy(*KEY, "t").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.count("*").alias("n_texts"))
    differ = _stored_once(texts.where("n_texts > 1").select(*KEY), f"{folder}/differ")
    if not differ.isEmpty():  # SHA-256 makes this unheard of, but the texts decide
        whole = doubtful.join(differ, KEY, "left_semi")
        sizes = whole.groupBy(*KEY, "t").agg(F.max(F.struct(F.col("doc_id").alias("id"), "file", "row")).alias("keep"), F.count("*").alias("n"))
        again = whole.join(sizes, [*KEY, "t"]).select(*out.columns)
        out = out.join(differ, KEY, "left_anti").select(*again.columns).union(again)
    return out, rows, names


def dedup_report(docs: DataFrame, folder: str | None = None, files_per_batch: int = 2000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for every row of docs."""
    log = groups(docs, folder, files_per_batch)[0]
    return log.select("doc_id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep.id")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: the located row of every group of equal texts. Texts are
    shuffled only where a filter of fixed size can't tell that they stay."""
    log, rows, (file, row) = groups(docs, folder)
    dropped = stored(log.where((F.col("file") != F.col("keep.file")) | (F.col("row") != F.col("keep.row"))).select("file", "row"), "dropped")
    place = lambda f, r: F.xxhash64(f, r)
    rest, perhaps = split_by_filter(rows, place(F.col(f"`{file}`"), F.col(f"`{row}`")), dropped.select(place(F.col("file"), F.col("row")).alias("x")))
    dropped = dropped.select(F.col("file").alias(f"{file}_"), F.col("row").alias(f"{row}_"))
    kept = perhaps.join(dropped, (F.col(f"`{file}`") == F.col(f"`{file}_`")) & (F.col(f"`{row}`") == F.col(f"`{row}_`")), "left_anti")
    return rest.union(kept).select(*quoted(docs.columns))
