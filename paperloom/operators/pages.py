"""Pages: offsets in the joined text, the OCR rule, image coverage, and how spans and pages meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import bad_char_ratio, let, non_space_chars, strip
from ..schema import PAGE_JOIN

MIN_CHARS, OCR_COVERAGE, OCR_PATHS, OCR_BAD = 80, 0.60, 20, 0.05


def text_layer(raw: Column) -> Column:
    return strip(F.replace(raw, F.lit("\r\n"), F.lit("\n")))


def page_offsets(pages: DataFrame) -> DataFrame:
    """doc_id, number, start, end: pages in order, joined by a blank line (exploded rows)."""
    before = Window.partitionBy("doc_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text")
    start = F.coalesce(F.sum(size + len(PAGE_JOIN)).over(before), F.lit(0)).cast("int")
    return pages.select("doc_id", "number", start.alias("start"), (start + size).cast("int").alias("end"))


def page_array(texts: Column) -> Column:
    """The same from an array of page texts, without a shuffle: array of (number, start, end)."""
    zero = F.expr("struct(0 as at, cast(array() as array<struct<number:int,start:int,end:int>>) as pages)")
    step = lambda s, t: F.struct(
        (s["at"] + F.length(t) + len(PAGE_JOIN)).alias("at"),
        F.concat(s["pages"], F.array(F.struct((F.size(s["pages"]) + 1).alias("number"), s["at"].alias("start"), (s["at"] + F.length(t)).alias("end")))).alias("pages"),
    )
    return F.aggregate(texts, zero, step)["pages"]


def ocr_decision(text: Column, coverage: Column, paths: Column, step3: Column | None = None) -> Column:
    """The first step of the rule that matches, with its reason and signals.

    step3, if given, is struct(ocr, word_ratio), evaluated only where steps 1 and 2 leave the page open.
    """
    chars, ratio = non_space_chars(text), bad_char_ratio(text)
    verdict = lambda ocr, step, reason: F.struct(ocr.alias("ocr") if isinstance(ocr, Column) else F.lit(ocr).alias("ocr"), F.lit(step).alias("step"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), chars.cast("int").alias("chars"), ratio.alias("bad_char_ratio"))
    few = chars < MIN_CHARS
    out = (
        F.when(few & (coverage >= OCR_COVERAGE), verdict(True, 1, fixed.REASON_IMAGES))
        .when(few & (paths >= OCR_PATHS), verdict(True, 1, fixed.REASON_PATHS))
        .when(few, verdict(False, 1, fixed.REASON_EMPTY))
        .when(ratio >= OCR_BAD, verdict(True, 2, fixed.REASON_BAD))
    )
    if step3 is not None:
        out = out.when(step3.isNotNull(), verdict(step3["ocr"], 3, F.when(step3["ocr"], fixed.REASON_NO_WORDS).otherwise(fixed.REASON_WORDS)))
    return out.otherwise(verdict(False, 4, fixed.REASON_GOOD))


def covered_share(boxes: Column, width: Column, height: Column) -> Column:
    """Share of a page that the union of boxes (left, bottom, right, top) covers, clipped to the page.

    Slabs between neighbouring x edges; in each the y intervals merge by a fold. Boxes of a page are few, so
    this stays in the row: no shuffle.
    """
    clip = F.transform(boxes, lambda b: F.struct(F.greatest(F.lit(0.0), b["left"]).alias("l"), F.greatest(F.lit(0.0), b["bottom"]).alias("b"), F.least(width, b["right"]).alias("r"), F.least(height, b["top"]).alias("t")))
    inside = F.filter(clip, lambda b: (b["r"] > b["l"]) & (b["t"] > b["b"]))
    return let(inside, lambda boxes: let(F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(b["l"], b["r"]))))), lambda xs: _covered(boxes, xs, width, height)))


def _covered(inside: Column, xs: Column, width: Column, height: Column) -> Column:
    def slab(x0: Column, i: Column) -> Column:
        x1 = F.get(xs, i + 1)
        over = F.array_sort(F.transform(F.filter(inside, lambda b: (b["l"] <= x0) & (b["r"] >= x1)), lambda b: F.struct(b["b"].alias("b"), b["t"].alias("t"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("edge"))
        tall = F.aggregate(over, start, lambda s, y: F.struct((s["sum"] + F.greatest(F.lit(0.0), y["t"] - F.greatest(y["b"], s["edge"]))).alias("sum"), F.greatest(s["edge"], y["t"]).alias("edge")))["sum"]
        return F.when(x1.isNotNull(), tall * (x1 - x0)).otherwise(0.0)

    area = F.aggregate(F.transform(xs, slab), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(inside) > 0) & (width > 0) & (height > 0), F.least(F.lit(1.0), area / (width * height))).otherwise(0.0)


def pages_of_spans(pages: Column, spans: Column) -> Column:
    """Numbers of the pages that any span touches."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(pages, lambda p: F.exists(spans, lambda s: (p["start"] < s["end"]) & (s["start"] < p["end"]))), lambda p: p["number"])))


def page_ranges(numbers: Column) -> Column:
    """Runs of consecutive numbers as (lo, hi)."""
    return let(numbers, _runs)


def _runs(numbers: Column) -> Column:
    runs = F.filter(F.transform(numbers, lambda n, i: F.struct(n.alias("n"), F.coalesce(F.get(numbers, i - 1) == n - 1, F.lit(False)).alias("goes_on"))), lambda x: ~x["goes_on"])
    last = lambda n: F.array_min(F.filter(numbers, lambda m: (m >= n) & ~F.array_contains(numbers, m + 1)))
    return F.transform(runs, lambda x: F.struct(x["n"].alias("lo"), last(x["n"]).alias("hi")))


def snap_head(pages: Column, start: Column, end: Column) -> Column:
    """The last page end in (start, end], else end."""
    return F.coalesce(F.array_max(F.transform(F.filter(pages, lambda p: (p["end"] > start) & (p["end"] <= end)), lambda p: p["end"])), end)


def snap_tail(pages: Column, start: Column, end: Column) -> Column:
    """The first page start in [start, end), else start."""
    return F.coalesce(F.array_min(F.transform(F.filter(pages, lambda p: (p["start"] >= start) & (p["start"] < end)), lambda p: p["start"])), start)
