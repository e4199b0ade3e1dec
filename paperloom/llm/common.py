"""Helpers shared by the corpus operators: tables, shared storage, text normalisation, components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: space and \x09-\x0D, for str.strip() and str.split().
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where it is unset a temporary folder of this machine is set in its place, but only in local mode: on a cluster
    other machines could not read it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for private columns beside columns: with as many underscores before them as it takes."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


FILTER_BITS = 26


def split_by_filter(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key is surely not among keys, all other rows): df is read twice and not shuffled.

    keys has one column of longs, key is one; nulls are alike. The keys' hashes are set in a filter of
    2**FILTER_BITS bits, kept as rows of 64 words: 2**(FILTER_BITS - 12) rows of some 560 bytes at most (9 MB),
    however many keys there are, so it may be broadcast. A full filter sends all rows to the second part, which any
    exact join then settles.
    """
    [k] = keys.columns
    slot, bits = fresh(df.columns, "slot", "bits")
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(0))), F.lit(1 << FILTER_BITS))
    word_of = lambda at: F.shiftright(at, 6).bitwiseAND(F.lit(63)).cast("int")
    at = place(F.col(k))
    words = keys.select(F.shiftright(at, 12).cast("int").alias(slot), word_of(at).alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.groupBy(slot, "word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    held = words.groupBy(slot).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # 64 at most
    whole = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long")))
    table = stored(held.select(slot, whole.alias(bits)), "filter")
    own = place(key)
    marked = df.withColumn(slot, F.shiftright(own, 12).cast("int")).join(F.broadcast(table), slot, "left")
    word = F.coalesce(F.element_at(F.col(f"`{bits}`"), word_of(own) + 1), F.lit(0).cast("long"))
    hit = F.getbit(word, own.bitwiseAND(F.lit(63)).cast("int")) == 1
    return tuple(marked.where(c).select(*quoted(df.columns)) for c in (~hit, hit))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: cuts the lineage and survives the loss of executors."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are; null counts as empty.

    translate() takes some 300 ns a character. lower() does the same on ASCII text; elsewhere it is given the
    URL-encoded text, which is ASCII: it leaves all but A-Z alone (and the hex digits, which may be either).
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.url_decode(F.lower(F.url_encode(text))))


def fold_int(hashed: Column, mod: int) -> Column:
    return F.pmod(hashed, F.lit(mod))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def row_groups(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20):
    """Slices of the batch that hold about most_bytes of text each: bounds the arrays made from them."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the least node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each an aggregation with
    map-side combine and a join that adaptive execution can split, until the edges are stars around the
    roots. Every step is checkpointed; only a count and a checksum come to the driver. Loops (a = b) give
    a component of one; an empty table gives an empty table.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    single = edges.where("a = b").select(F.col("a").alias("node"))
    stars = edges.where("a <> b")
    before = None
    while True:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Each b keeps its least neighbour; the others, and b itself, are tied to that one.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        stars = cut(small)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = stars.select(F.col("b").alias("node"), F.col("a").alias("root")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("root")))
    return found.union(single.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
