"""SimHash near-duplicates by tiled exact comparison (operator 1).

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles joined by a space with repeats
(fewer words: the whole sequence; none: fingerprint zero). A bit is set if it is set in over half of the
shingles' XXH64 values (seed 42). Two fingerprints link when at most RADIUS = 2 of their 64 bits differ.

Equal fingerprints are one row from the start. The others are compared exactly, xor and bit count in numpy:
fingerprints within 2 bits agree wholly in at least one of three parts of 22, 21 and 21 bits, so each joins
three buckets. A bucket of more than TILE fingerprints is cut once more in the same way: of the 42 or 43 bits
that remain, two of its fingerprints that link agree in one of three parts of 14 or 15. Every bucket is tiled by
population count: a tile holds the fingerprints of one count, and pairs of tiles whose counts differ by more than
RADIUS are never formed. Where a bucket is still larger than TILE, its tiles are also cut by a hash, so that none is
larger, and the pairs of tiles are dealt to different tasks, so no bucket lands in one task. A bucket returns a
spanning forest of its links, never all pairs. The links' connected components are found by distributed star steps.

Defined cases: null and empty texts have no words, and fingerprint zero. Texts of any length are read whole, a block
of words at a time. Repeated rows and ties have equal fingerprints and are one component. An empty table gives no
rows. Rows that share a doc_id each get a row; component_id is the smallest doc_id that can be reached (nulls aside;
null if there is no other). Other columns than doc_id and text are not read, and ``near_dedup`` carries them, whatever
their names; it keeps the rows of a doc_id if any row of it has a component of that doc_id, or a null one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, row_groups, shared_dir, split_by_filter, stored, texts_of

RADIUS, TILE, SEED, WORDS = 2, 2048, 42, 3
PARTS = ((0, 22), (22, 21), (43, 21))
_BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text; memory is bounded by its words."""
    words = text.lower().split()  # of bytes: A-Z and the contract's white space alone
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    counts, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _BLOCK):
        part = words[at : min(n, at + _BLOCK) + WORDS - 1]
        shingles = map(join, zip(part, part[1:], part[2:], strict=False)) if len(part) >= WORDS else (join(part),)
        h = np.array([digest(s, SEED) for s in shingles], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)  # a byte a bit
        for i in range(0, len(bits), 255):  # a byte holds a sum of up to 255
            counts += bits[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                fp = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between positions 0..n-1, as stars around each component's least position."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = np.flatnonzero(label != np.arange(n))
    return inner, label[inner]


def _links(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, in which population counts rise: all rows of side 0 with each other, or side 1
    with side 2. A row meets those after it whose count is at most RADIUS more, and no others."""
    n = len(key)
    pop = np.bitwise_count(fp).astype(np.int64)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n)
    run = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    reach = np.searchsorted(run * 128 + pop, run * 128 + pop + RADIUS, "right")  # counts are 64 at most
    out_l, out_r, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < reach[at]]
        if not len(at):
            break
        near = (np.bitwise_count(fp[at] ^ fp[at + d]) <= RADIUS) & ((side[at] != side[at + d]) | (side[at] == 0))
        hit = at[near]
        if len(hit):
            out_l.append(hit)
            out_r.append(hit + d)
            held += len(hit)
            if held > 4 * n + 100_000:  # many links: keep a forest of them
                a, b = _forest(np.concatenate(out_l), np.concatenate(out_r), n)
                out_l, out_r, held = [a], [b], len(a)
        d += 1
    left, right = np.concatenate(out_l), np.concatenate(out_r)
    return _forest(left, right, n) if len(left) else (left, right)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, side, fp) sorted by key and population count; yields the links (a, b) within every key."""
    parts: list[tuple[np.ndarray, ...]] = []

    def links(rows):
        key, side, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
        a, b = _links(key, side, fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, side, fp = batch.column("key").to_numpy(), batch.column("side").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        done = int(np.searchsorted(key, key[-1]))  # the last run may go on
        if done:
            yield links([*parts, (key[:done], side[:done], fp[:done])])
            parts = []
        elif parts and parts[-1][0][-1] != key[0]:
            yield links(parts)
            parts = []
        parts.append((key[done:], side[done:], fp[done:]))
    if parts:
        yield links(parts)


def _large(keyed: DataFrame, tile: int, name: str) -> DataFrame:
    """bucket, tiles (of every population count the number of tiles) of the buckets of more than tile fingerprints."""
    counts = keyed.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    total = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles"))
    return stored(total.where(F.col("n") > tile).select("bucket", "tiles"), name)


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect all pairs within RADIUS bits."""
    pop, whole = F.bit_count("fp").alias("pop"), F.lit(0).cast("tinyint").alias("side")
    part = lambda bits, at, width: F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))
    # Each part with the bits beside it: the fingerprint turned so that the part is at its low end.
    turned = lambda at: F.shiftrightunsigned("fp", at).bitwiseOR(F.shiftleft("fp", 64 - at)) if at else F.col("fp")
    own = [F.struct((F.lit(i << 22) + part(F.col("fp"), at, width)).alias("bucket"), F.shiftrightunsigned(turned(at), width).alias("rest")) for i, (at, width) in enumerate(PARTS)]
    keyed = distinct.select("fp", pop, F.explode(F.array(*own)).alias("b")).select("fp", "pop", "b.*")
    large = _large(keyed, tile, "large")
    small = keyed.join(large.select("bucket"), "bucket", "left_anti").select(F.xxhash64("bucket").alias("key"), whole, "fp", "pop")
    again = [F.struct(F.lit(k).alias("k"), part(F.col("rest"), 14 * k, 14 if k < 2 else 15).alias("value")) for k in range(3)]
    finer = keyed.join(large.select("bucket"), "bucket", "left_semi").select("fp", "pop", "bucket", F.explode(F.array(*again)).alias("x"))
    finer = finer.select("fp", "pop", (F.col("bucket") * F.lit(1 << 18) + F.col("x.k") * F.lit(1 << 16) + F.col("x.value")).alias("bucket"))
    hot = _large(finer, tile, "hot")
    middle = finer.join(hot.select("bucket"), "bucket", "left_anti").select(F.xxhash64(F.lit(1), "bucket").alias("key"), whole, "fp", "pop")
    # Of a bucket that is still large: tile (pop, salt) meets every tile (pop', salt') with pop' within RADIUS once.
    salt = "cast(pmod(xxhash64(fp), tiles[pop]) as int)"
    pairs = f"""flatten(transform(filter(sequence(pop - {RADIUS}, pop + {RADIUS}), q -> tiles[q] is not null), q ->
        transform(sequence(0, tiles[q] - 1), u -> case
            when q = pop and u = {salt} then struct(pop as p, {salt} as s, pop as q, u as u, 0 as side)
            when q > pop or q = pop and u > {salt} then struct(pop as p, {salt} as s, q as q, u as u, 1 as side)
            else struct(q as p, u as s, pop as q, {salt} as u, 2 as side) end)))"""
    tiled = finer.join(hot, "bucket").select("fp", "pop", "bucket", F.explode(F.expr(pairs)).alias("x"))
    tiled = tiled.select(F.xxhash64("bucket", "x.p", "x.s", "x.q", "x.u").alias("key"), F.col("x.side").cast("tinyint").alias("side"), "fp", "pop")
    rows = small.union(middle).union(tiled).repartition("key").sortWithinPartitions("key", "pop").select("key", "side", "fp")
    return rows.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for every row of docs."""
    shared_dir(docs.sparkSession)
    fps = stored(fingerprints(docs), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct.select("fp"), tile)).withColumnRenamed("node", "fp")
    tied = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = tied.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(known, "fp").select("doc_id", hexed, "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: those of each component's smallest doc_id (all rows, if it is null). docs is
    evaluated three times; texts are shuffled only where a filter of fixed size can't tell that they stay."""
    [own] = fresh(docs.columns, "id")
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
    dropped = near_duplicates(docs).groupBy("doc_id").agg(stays).where(~F.col("stays")).select(F.col("doc_id").alias(own))
    dropped = stored(dropped, "dropped")
    rest, perhaps = split_by_filter(docs, F.col("doc_id").cast("long"), dropped)
    return rest.union(perhaps.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_anti"))
