"""Planning of judgments: which read what, what text fits a budget, and the keys under which answers are kept.

Everything about one document is an expression over its row (its pages, sections and text), so planning a
corpus is a narrow transformation. Only grouping of exploded judgments shuffles, and it carries no text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import POINTER
from .pages import page_ranges, pages_of_spans, snap_head, snap_tail
from .sections import usable

HEAD_SHARE, SHRINK, ELISION, JOIN = 0.25, 0.85, "\n[…]\n", "\n\n"
STEADY, ROUNDS = 64, 96


@dataclass(frozen=True)
class Ask:
    """One judgment: ``noul`` (yes/no), ``score`` or ``choice``, with options (name, description or None)."""

    name: str
    kind: str
    instructions: str
    options: tuple[tuple[str, str | None], ...] = ()
    reads: tuple[str, ...] | None = None
    fallback: bool = False
    escalate_below: float | None = None

    def definition(self) -> dict:
        out: dict = {"kind": self.kind, "instructions": self.instructions}
        if self.options:
            out["options"] = [{"name": n, "description": d} for n, d in self.options]
        return out

    @property
    def chars(self) -> int:
        return len(self.instructions) + sum(len(n) + len(d or "") for n, d in self.options)

    @property
    def canonical(self) -> str:
        return json.dumps(self.definition(), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class Capabilities:
    classifier_id: str = "local"
    model: str = "keyword-1"
    token_budget: int = 32_000
    chars_per_token: float = 3.0
    overhead: int = 220
    max_options: int = 255


def longest(asks: list[Ask]) -> Ask:
    """The ask with most characters, the first of equals."""
    return max(asks, key=lambda a: a.chars)


def present_keys(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(usable(sections), lambda s: s["keys"])))


def missing_reason(sections: Column, key: Column) -> Column:
    """The key, and what its first pointer section is, if one only points elsewhere."""
    points = F.filter(sections, lambda s: F.array_contains(s["keys"], key) & F.array_contains(s["flags"], POINTER))
    first = F.get(points, F.lit(0))
    return F.when(F.size(points) > 0, F.concat(key, F.lit(" (pointer → "), F.coalesce(first["form_ref"], first["label"]), F.lit(")"))).otherwise(key)


def plan_asks(docs: DataFrame, asks: list[Ask]) -> DataFrame:
    """doc_id, name, reads (sorted; null: the whole document), skipped, note: a row for every document and ask.

    An ask whose sections are missing is skipped before any text is cut or sent, or falls back to all text.
    docs has doc_id and sections.
    """
    rows = [F.struct(F.lit(a.name).alias("name"), (F.array(*[F.lit(r) for r in sorted(set(a.reads))]) if a.reads else F.lit(None).cast("array<string>")).alias("reads"), F.lit(a.fallback).alias("fallback")) for a in asks]
    have = docs.select("doc_id", "sections", present_keys(F.col("sections")).alias("present")).select("doc_id", "sections", "present", F.explode(F.array(*rows)).alias("a"))
    missing = F.when(F.col("a.reads").isNotNull(), F.array_except("a.reads", "present")).otherwise(F.expr("cast(array() as array<string>)"))
    have = have.withColumn("missing", missing)
    reason = F.concat(F.lit("missing section: "), F.array_join(F.transform("missing", lambda k: missing_reason(F.col("sections"), k)), ", "))
    lacking = F.size("missing") > 0
    return have.select(
        "doc_id", F.col("a.name").alias("name"), F.when(~lacking, F.col("a.reads")).alias("reads"),
        F.when(lacking & ~F.col("a.fallback"), reason).alias("skipped"),
        F.when(lacking & F.col("a.fallback"), F.concat(reason, F.lit("; read head+tail instead"))).alias("note"),
    )


def request_groups(planned: DataFrame) -> DataFrame:
    """doc_id, reads, names: judgments of a document that read the same share one request."""
    keep = planned.where("skipped is null")
    return keep.groupBy("doc_id", F.coalesce(F.array_join("reads", "|"), F.lit("*")).alias("reads")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def extents(text: Column, sections: Column, reads: Column | None) -> Column:
    """(key, start, end) of what is read: the usable sections, each under the first key read, or the whole text, where
    reads is null (or None, for all rows)."""
    all_ = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("start"), F.length(text).alias("end")))
    if reads is None:
        return all_
    keyed = F.transform(usable(sections), lambda s: F.struct(F.get(F.array_intersect(reads, s["keys"]), F.lit(0)).alias("key"), s["spans"].alias("spans")))
    read = F.filter(keyed, lambda s: s["key"].isNotNull())
    return F.when(reads.isNull(), all_).otherwise(F.flatten(F.transform(read, lambda s: F.transform(s["spans"], lambda p: F.struct(s["key"].alias("key"), p["start"].alias("start"), p["end"].alias("end"))))))


def cut(ext: Column, pages: Column, max_chars: Column) -> Column:
    """struct(kept: array of (key, spans), truncated): a quarter head and the rest tail of each extent, in proportion."""
    total = lambda e: F.aggregate(e, F.lit(0), lambda n, x: n + (x["end"] - x["start"]))
    return let(ext, lambda e: let(total(e), lambda n: _cut(e, n, pages, max_chars)))


def _cut(ext: Column, total: Column, pages: Column, max_chars: Column) -> Column:
    room = max_chars - len(JOIN) * F.size(ext)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    def part(e: Column) -> Column:
        size = e["end"] - e["start"]
        share = (room * size / F.greatest(total, F.lit(1))).cast("int")  # toward zero
        return let(F.greatest(F.lit(0), share - len(ELISION)), lambda allowed: F.struct(e["key"].alias("key"), F.when(allowed >= size, F.array(span(e["start"], e["end"]))).otherwise(ends(e, allowed)).alias("spans")))

    def ends(e: Column, allowed: Column) -> Column:
        head = F.floor(allowed * HEAD_SHARE).cast("int")
        tail = allowed - head
        head_end = F.when(head > 0, snap_head(pages, e["start"], e["start"] + head)).otherwise(e["start"])
        tail_start = F.when(tail > 0, snap_tail(pages, e["end"] - tail, e["end"])).otherwise(e["end"])
        return F.filter(F.array(span(e["start"], head_end), span(tail_start, e["end"])), lambda s: s["end"] > s["start"])

    whole = F.transform(ext, lambda e: F.struct(e["key"].alias("key"), F.array(span(e["start"], e["end"])).alias("spans")))
    fits = (total == 0) | (total <= room)
    return F.struct(F.when(fits, whole).otherwise(F.transform(ext, part)).alias("kept"), (~fits).alias("truncated"))


def text_of(text: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), ELISION)


def state_json(text: Column, kept: Column, reads: Column | None, metadata: dict[str, Column]) -> Column:
    """The state that is sent, as compact JSON; absent metadata is left out. reads: as for extents."""
    return let(kept, lambda k: _state_json(text, k, reads, metadata))


def _state_json(text: Column, kept: Column, reads: Column | None, metadata: dict[str, Column]) -> Column:
    fields = [c.alias(k) for k, c in metadata.items()]
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: text_of(text, p["spans"])), JOIN)
    if reads is None:
        fields.append(joined(kept).alias("text"))
    else:
        present = F.filter(reads, lambda r: F.exists(kept, lambda p: p["key"] == r))
        keyed = F.map_from_entries(F.transform(present, lambda r: F.struct(r, joined(F.filter(kept, lambda p: p["key"] == r)))))
        fields += [F.when(reads.isNull(), joined(kept)).alias("text"), keyed.alias("sections")]
    return F.to_json(F.struct(F.struct(*fields).alias("document")))


def tokens(state: Column, chars: int | Column, caps: Capabilities) -> Column:
    return (F.length(state) + chars) / caps.chars_per_token + caps.overhead


def fit_chars(text: Column, ext: Column, pages: Column, reads: Column | None, metadata: dict[str, Column], asks: list[Ask] | Column, caps: Capabilities, shrink_from: Column | None = None) -> Column:
    """Characters that may be sent, so that the state and the longest ask are within the budget.

    JSON escapes may make a cut too long; each round takes off what was too much, until nothing is. Rounds after that
    are not evaluated. Where cuts snap to pages a round may change nothing, so from round STEADY on what is taken off
    doubles each time: whatever the text, the last of ROUNDS rounds has reached a cut that fits, or 0.
    asks may also be a column with the longest ask's characters.
    """
    budgeted = longest(asks).chars if isinstance(asks, list) else asks
    nothing = F.transform(ext, lambda e: F.struct(e["key"].alias("key"), F.array(F.struct(e["start"].alias("start"), e["start"].alias("end"))).alias("spans")))
    room = caps.token_budget - tokens(state_json(text, nothing, reads, metadata), budgeted, caps)
    first = F.greatest(F.lit(0), F.floor(room * caps.chars_per_token).cast("int"))
    if shrink_from is not None:
        first = F.least(first, F.floor(shrink_from * SHRINK).cast("int"))
    acc = lambda chars, fits: F.struct(chars.cast("int").alias("chars"), fits.alias("fits"))

    def round_(s: Column, k: Column) -> Column:
        over = tokens(state_json(text, cut(ext, pages, s["chars"])["kept"], reads, metadata), budgeted, caps) - caps.token_budget
        faster = F.pow(F.lit(2.0), F.greatest(F.lit(0), k - STEADY))
        less = lambda o: F.when((o <= 0) | (s["chars"] == 0), acc(s["chars"], F.lit(True))).otherwise(acc(F.greatest(F.lit(0.0), s["chars"] - F.ceil(o * caps.chars_per_token) * faster), F.lit(False)))
        return F.when(s["fits"], s).otherwise(let(over, less))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), acc(first, F.lit(False)), round_, lambda s: s["chars"])


def coverage(cut_: Column, pages: Column, reads: Column | None) -> Column:
    spans = F.flatten(F.transform(cut_["kept"], lambda k: k["spans"]))
    return F.struct((F.expr("cast(array() as array<string>)") if reads is None else reads).alias("sections"), spans.alias("spans"), page_ranges(pages_of_spans(pages, spans)).alias("page_ranges"), cut_["truncated"].alias("truncated"))


def cache_key(state: Column, ask: Ask, caps: Capabilities) -> Column:
    """SHA-256 of canonical JSON (keys in order) of classifier, judgment, model and state."""
    text = lambda s: json.dumps(s, ensure_ascii=False)
    head = f'{{"classifier_id":{text(caps.classifier_id)},"judgment":{ask.canonical},"model":{text(caps.model)},"state":'
    return F.sha2(F.concat(F.lit(head), state, F.lit("}")), 256)
