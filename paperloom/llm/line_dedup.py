"""Line deduplication with per-document keep bitmaps (operator 9).

A text is split at \\n (null or empty: one empty line). A line's key is the line without ``[\\x20\\x09-\\x0D]`` at
its ends, A-Z lower-cased. Keys of MIN_CHARS code points or more that are found in MIN_DOCS documents or more
lose all their lines except in the largest doc_id that holds them.

1. One pass turns texts into rows (128-bit key hash, document, position); short keys send none.
2. The rows are range-partitioned by hash and document, largest document first, with a secondary sort by position,
   so that a hot key spans several ranges and none is held by one task. One stream over each sorted range finds the
   first occurrence of every key, in the largest document, and counts its documents: once MIN_DOCS are reached, all
   rows of later documents are passed on as positions to drop.
3. Only a range's first and last key may go on in a neighbour. For these two the stream returns a summary (documents,
   largest document), and their rows stay open where the range alone doesn't settle them. The summaries, two a range,
   are added up by key and settle the open rows.
4. By document the positions become a compressed keep bitmap. Texts that surely have none pass by a filter of fixed
   size; the others meet their bitmaps and are rewritten in Arrow batches.

Defined cases: rows that share doc_id are one document in the counts, and keep a bitmap for each different text. A
null doc_id is a document smaller than any other. Null and empty texts are one empty line. A line that repeats in the
largest document stays each time. Texts of any length are read whole; memory follows one text and the lines of one
document with one key. An empty table gives no rows. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_groups, split_by_filter, stored, texts_of

MIN_CHARS, MIN_DOCS = 40, 5
_TAIL = bytes(range(0x80, 0xC0))
_LEAST = -(1 << 63)


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines that have a key long enough."""
    for pos, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip().lower()
            if len(key) >= min_chars and len(key.translate(None, _TAIL)) >= min_chars:
                yield pos, key


def _text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (the key's 128-bit hash), doc_id, text_id, pos: a row for every line with a key long enough."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                ids, at, pos, digests = batch.column("doc_id").to_numpy(), [], [], []
                for i, text in enumerate(texts_of(batch)):
                    for p, key in line_keys(text, min_chars):
                        at.append(i)
                        pos.append(p)
                        digests.append(xxhash.xxh3_128_digest(key))
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], ids[at], batch.column("text_id").to_numpy()[at], np.array(pos, np.int32))], ["h1", "h2", "doc_id", "text_id", "pos"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), _text_id().alias("text_id"), "text")
    return rows.mapInArrow(of, "h1 long, h2 long, doc_id long, text_id long, pos int")


RANGE = "kind int, h1 long, h2 long, doc_id long, text_id long, n long, pos array<int>"
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, text: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Occurrences as rows of RANGE: the positions by key, document and text."""
    order = np.lexsort((pos, text, doc, key[:, 1], key[:, 0]))
    key, doc, text, pos = key[order], doc[order], text[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (key[1:] != key[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(pos.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(key[at, 0]), pa.array(key[at, 1]), pa.array(doc[at]), pa.array(text[at]), pa.array(np.zeros(len(at), np.int64)), lists], _NAMES)


_NAMES = [c.split()[0] for c in RANGE.split(", ")]


class _Range:
    """One sorted range: what is known of the key that the stream stands in, and the rows that wait for it."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple[int, int] | None = None
        self.leading = True  # the key may have begun in the range before
        self.docs = self.largest = self.latest = 0
        self.wait: list[tuple[np.ndarray, ...]] = []

    def _summary(self) -> pa.RecordBatch:
        one = [_SUMMARY, *self.key, self.largest, 0, self.docs]
        return pa.RecordBatch.from_arrays([*(pa.array([x], f.type) for x, f in zip(one, _SCHEMA, strict=False)), pa.array([[]], pa.list_(pa.int32()))], _NAMES)

    def _waiting(self, kind: int) -> Iterator[pa.RecordBatch]:
        if self.wait:
            key, doc, text, pos = (np.concatenate(x) for x in zip(*self.wait, strict=True))
            self.wait = []
            keep = np.ones(len(doc), bool) if kind == _OPEN else doc != self.largest
            if keep.any():
                yield _rows(kind, key[keep], doc[keep], text[keep], pos[keep])

    def _close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The current key ends here, with the range or (not last) before another key."""
        if self.key is None:
            return
        if self.leading or last:
            yield from self._waiting(_OPEN)
            yield self._summary()
        self.wait = []

    def feed(self, key: np.ndarray, doc: np.ndarray, text: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The next rows, in order."""
        n = len(doc)
        new_key = np.ones(n, bool)
        new_key[1:] = (key[1:] != key[:-1]).any(axis=1)
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        begins = np.append(np.flatnonzero(new_key), n)
        docs = np.add.reduceat(new_doc.astype(np.int64), begins[:-1])
        # Keys that begin and end within these rows are settled at once; the first and the last are carried.
        goes_on = self.key == (int(key[0, 0]), int(key[0, 1]))
        inner = np.zeros(len(docs), bool)
        inner[1:-1] = docs[1:-1] >= self.min_docs
        if inner.any():
            largest = np.repeat(doc[begins[:-1]], np.diff(begins))
            out = np.repeat(inner, np.diff(begins)) & (doc != largest)
            yield _rows(_DROP, key[out], doc[out], text[out], pos[out])
        for k in sorted({0, len(docs) - 1}):
            a, b = begins[k], begins[k + 1]
            if not (k == 0 and goes_on):
                yield from self._close(False)
                self.leading = self.key is None
                self.key, self.docs, self.largest, self.latest = (int(key[a, 0]), int(key[a, 1])), 0, int(doc[a]), None
            self.docs += int(docs[k]) - (self.latest == int(doc[a]))
            self.latest = int(doc[b - 1])
            self.wait.append((key[a:b], doc[a:b], text[a:b], pos[a:b]))
            if self.leading:
                yield from self._waiting(_OPEN)
            elif self.docs >= self.min_docs:
                yield from self._waiting(_DROP)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._close(True)


_SCHEMA = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("n", pa.int64())])


def to_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed bits, 1 for a line that stays; lines beyond the last bit stay."""
    keep = np.ones(int(dropped.max()) + 1 if len(dropped) else 0, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes() + bytes([len(keep) % 8]))


def from_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        raw = zlib.decompress(bitmap)
        bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8), bitorder="little").astype(bool)
        bits = bits[: len(bits) - (8 - raw[-1]) % 8]
        keep[: len(bits)] = bits[:n_lines]
    return keep


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [to_bitmap(np.concatenate([np.array(x, np.int64) for x in row])) for row in batch.column("pos").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(maps, pa.binary())], ["doc_id", "text_id", "bitmap"])


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id, pos (array): the lines that go, of line_rows."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Range(min_docs)
        for batch in batches:
            if batch.num_rows:
                h1, h2, doc, text, pos = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "text_id", "pos"))
                yield from state.feed(np.stack([h1, h2], axis=1), doc, text, pos)
        yield from state.end()

    order = ["h1", "h2", F.desc("doc_id")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos").select("h1", "h2", "doc_id", "text_id", "pos")
    found, key = stored(ranged.mapInArrow(of, RANGE), "ranges"), ["h1", "h2"]
    totals = found.where(F.col("kind") == _SUMMARY).groupBy(*key).agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("largest"))
    totals = totals.where(F.col("n_docs") >= min_docs).drop("n_docs")
    settled = found.where(F.col("kind") == _OPEN).join(F.broadcast(totals), key).where("doc_id <> largest")  # two rows a range
    return found.where(F.col("kind") == _DROP).select("doc_id", "text_id", "pos").union(settled.select("doc_id", "text_id", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id, bitmap of the documents that lose lines (a null doc_id is the least long here)."""
    drops = dropped_lines(stored(line_rows(docs, min_chars), "lines"), min_docs)
    return drops.groupBy("doc_id", "text_id").agg(F.collect_list("pos").alias("pos")).mapInArrow(_bitmaps, "doc_id long, text_id long, bitmap binary")


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """docs and their bitmaps (null: all lines stay) in a column of the name returned."""
    own, text, bitmap = fresh(docs.columns, "id", "text_id", "bitmap")
    maps = stored(keep_bitmaps(docs, min_chars, min_docs), "bitmaps")
    whole, cut = split_by_filter(docs, _doc_key(), maps.select("doc_id"))
    maps = maps.select(F.col("doc_id").alias(own), F.col("text_id").alias(text), F.col("bitmap").alias(bitmap))
    met = cut.join(maps, (_doc_key() == F.col(own)) & (_text_id() == F.col(text)), "left").drop(own, text)
    return whole.withColumn(bitmap, F.lit(None).cast("binary")).union(met), bitmap


def _kept(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    n = text.count(b"\n") + 1
    if bitmap is None:
        return n, 0, text
    keep = from_bitmap(bitmap, n)
    return n, int(n - keep.sum()), b"\n".join(line for line, k in zip(text.split(b"\n"), keep, strict=True) if k)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: a row for every row of docs."""
    rows, bitmap = _with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                found = [_kept(t, m) for t, m in zip(texts_of(batch), batch.column(bitmap).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(of, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs with the text that stays; all other columns as they are. docs is evaluated three times."""
    rows, bitmap = _with_bitmaps(docs, min_chars, min_docs)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole):
                texts = [_kept(t, m)[2] if m is not None else t for t, m in zip(texts_of(batch), batch.column(bitmap).to_pylist(), strict=True)]
                at = batch.schema.get_field_index("text")
                kept = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                kept = pc.if_else(batch.column(at).is_null(), pa.scalar(None, kept.type), kept)
                yield batch.set_column(at, batch.schema.field(at), kept).drop_columns([bitmap])

    return rows.mapInArrow(of, docs.schema)
