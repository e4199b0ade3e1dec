"""From documents and asks to answers and records: plan, look up, judge, retry once, assemble.

Planning is a narrow transformation: every set of sections read becomes one request of a document, cut to the
budget in native columns. Texts are not shuffled unless a cache leaves part of a document's requests open; the
lookup itself carries keys alone. Answers of the classifier are written once to the shared folder, so that neither
a lost executor's downstream task nor the retry calls it again for what is answered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import planner
from ..operators.judge import parts
from ..operators.planner import Ask, Capabilities
from ..schema import SCHEMA_VERSION
from ..streaming.runtime import shared_folder

ANSWER = "struct<value_str:string,value_num:double,probabilities:map<string,double>,confidence:double>"
COVERAGE = "struct<sections:array<string>,spans:array<struct<start:int,end:int>>,page_ranges:array<struct<lo:int,hi:int>>,truncated:boolean,shrunk:boolean,est_tokens:long>"
RESULT = "doc_id long, reads string, name string, coverage string, value_str string, value_num double, probabilities map<string,double>, confidence double, error string"
_ANSWERED = pa.schema([(n, pa.float64() if n in ("value_num", "confidence") else pa.int64() if n == "doc_id" else pa.map_(pa.string(), pa.float64()) if n == "probabilities" else pa.string()) for n in (c.split()[0] for c in RESULT.split(", "))])
WHOLE = "*"


class ClassifierError(Exception):
    """A request that failed; code is too_big, throttled, rejected, unavailable or transient."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class Answerer(Protocol):
    """The extension point: answers all asks of one request, which share its state."""

    def answer(self, state: dict, asks: dict[str, Ask]) -> dict[str, dict]: ...


class Keywords:
    """A local answerer. words: by ask its options' keywords (for noul: yes and no); hits plus one decide."""

    def __init__(self, words: dict[str, dict[str, list[str]]], most_chars: int | None = None):
        self.words, self.most_chars = words, most_chars

    def answer(self, state: dict, asks: dict[str, Ask]) -> dict[str, dict]:
        doc = state["document"]
        text = doc["text"] if "text" in doc else planner.JOIN.join(doc["sections"].values())
        if self.most_chars is not None and len(text) > self.most_chars:
            raise ClassifierError("too_big")
        return {name: self._one(text, ask) for name, ask in asks.items() if name in self.words}

    def _one(self, text: str, ask: Ask) -> dict:
        hits = {option: 1 + sum(map(text.count, ws)) for option, ws in self.words[ask.name].items()}
        total = sum(hits.values())
        if ask.kind == "noul":
            return {"value_num": hits["yes"] / total}
        confidence = max(hits.values()) / total
        if ask.kind == "score":
            shares = {str(i): h / total for i, h in enumerate(hits.values())}
            return {"value_num": sum(int(i) * p for i, p in shares.items()), "probabilities": shares, "confidence": confidence}
        return {"value_str": max(hits, key=hits.__getitem__), "probabilities": {o: h / total for o, h in hits.items()}, "confidence": confidence}


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reads(ask: Ask) -> tuple[str, ...] | None:
    return tuple(sorted(set(ask.reads))) if ask.reads else None


def _groups(asks: list[Ask], present: Column) -> Column:
    """By set of sections the asks that a document sends with it; those that lack sections are left out or read all."""
    sets = dict.fromkeys([*map(_reads, asks), *([None] if any(a.fallback for a in asks) else [])])
    text = lambda reads: F.array(*map(F.lit, reads))

    def member(ask: Ask, group: tuple[str, ...] | None) -> Column | None:
        own = _reads(ask)
        if own is None:
            return F.lit(True) if group is None else None
        lacks = F.size(F.array_except(text(own), present)) > 0
        return ~lacks if group == own else lacks if group is None and ask.fallback else None

    out = []
    for group in sets:
        members = [F.when(m, F.struct(F.lit(a.name).alias("name"), F.lit(a.chars).alias("chars"))) for a in asks if (m := member(a, group)) is not None]
        out.append(F.struct((F.lit(None).cast("array<string>") if group is None else text(group)).alias("reads"), F.array_compact(F.array(*members)).alias("asks")))
    return F.filter(F.array(*out), lambda g: F.size(g["asks"]) > 0)


def requests(docs: DataFrame, asks: list[Ask], caps: Capabilities | None = None, metadata: tuple[str, ...] = ("title",), shrink: bool = False) -> DataFrame:
    """doc_id, reads, names, state, coverage (JSON) of every request; docs has doc_id, text, pages, sections and metadata.

    With shrink, what is sent is cut to the planner's share of what would be sent otherwise.
    """
    caps = caps or Capabilities()
    text, pages, reads, ext = F.col("text"), F.col("pages"), F.col("g.reads"), F.col("ext")
    meta = {m: F.col(m) for m in metadata}
    rows = docs.select("doc_id", "text", "pages", "sections", *metadata, F.explode(_groups(asks, planner.present_keys(F.col("sections")))).alias("g"))
    rows = rows.select("doc_id", "text", "pages", *metadata, "g", planner.extents(text, F.col("sections"), reads).alias("ext"))
    budgeted = F.array_max(F.transform("g.asks", lambda a: a["chars"]))
    rows = rows.withColumn("cut", planner.cut(ext, pages, planner.fit_chars(text, ext, pages, reads, meta, budgeted, caps)))
    if shrink:
        sent = F.aggregate(F.flatten(F.transform("cut.kept", lambda k: k["spans"])), F.lit(0), lambda n, s: n + s["end"] - s["start"])
        rows = rows.withColumn("cut", planner.cut(ext, pages, F.floor(sent * planner.SHRINK).cast("int")))
    rows = rows.withColumn("state", planner.state_json(text, F.col("cut.kept"), reads, meta))
    tokens = planner.tokens(F.col("state"), F.aggregate("g.asks", F.lit(0), lambda n, a: n + a["chars"]), caps)
    cover = planner.coverage(F.col("cut"), pages, F.coalesce(reads, F.expr("cast(array() as array<string>)")))
    cover = cover.withField("truncated", F.col("cut.truncated") | F.lit(shrink)).withField("shrunk", F.lit(shrink)).withField("est_tokens", F.round(tokens).cast("long"))
    key = F.coalesce(F.array_join(reads, "|"), F.lit(WHOLE))
    return rows.select("doc_id", key.alias("reads"), F.array_sort(F.transform("g.asks", lambda a: a["name"])).alias("names"), "state", F.to_json(cover).alias("coverage"))


def ask_classifier(todo: DataFrame, classifier: Answerer, asks: list[Ask]) -> DataFrame:
    """RESULT rows: one call a request, in Arrow batches; a failing request leaves the others alone."""
    known, columns = {a.name: a for a in asks}, [c.split()[0] for c in RESULT.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "state")):
            out = []
            for r in batch.to_pandas().itertuples(index=False):
                mine, error = {n: known[n] for n in r.names}, None
                try:
                    got = classifier.answer(json.loads(r.state), mine)
                except ClassifierError as e:
                    got, error = {}, e.code
                for n in mine:
                    x = got.get(n)
                    out.append((r.doc_id, r.reads, n, r.coverage, *((x or {}).get(c) for c in columns[4:8]), error if x is None and error else "missing_result" if x is None else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _ANSWERED.types)] if out else [pa.array([], t) for t in _ANSWERED.types], schema=_ANSWERED)

    return todo.select("doc_id", "reads", "names", "state", "coverage").mapInArrow(of, RESULT)


def cache_keys(req: DataFrame, asks: list[Ask], caps: Capabilities) -> DataFrame:
    """doc_id, reads, name, coverage, cache_key of every judgment, from the state before any shrinking."""
    rows = req.select("doc_id", "reads", "coverage", "state", F.explode("names").alias("name"))
    key = None
    for a in asks:
        own = planner.cache_key(F.col("state"), a, caps)
        key = F.when(F.col("name") == a.name, own) if key is None else key.when(F.col("name") == a.name, own)
    return rows.select("doc_id", "reads", "name", "coverage", key.alias("cache_key"))


def judge_documents(docs: DataFrame, asks: list[Ask], classifier: Answerer, caps: Capabilities | None = None, cache: DataFrame | None = None, metadata: tuple[str, ...] = ("title",)) -> DataFrame:
    """A row for every document and ask: the answer with its coverage, or why it was skipped or failed.

    Columns: doc_id, name, skipped, note, reads, coverage, value_str, value_num, probabilities, confidence, error,
    cached, cache_key (null without a cache). cache has cache_key and answer (JSON of ANSWER).
    """
    caps, spark = caps or Capabilities(), docs.sparkSession
    folder, found = shared_folder(spark), None
    docs = _stored(docs.select("doc_id", "text", "pages", "sections", *metadata), f"{folder}/documents")  # sections are detected once
    todo = requests(docs, asks, caps, metadata)
    if cache is not None:
        keys = cache_keys(todo, asks, caps)
        found = _stored(keys.join(cache.select("cache_key", "answer"), "cache_key", "left"), f"{folder}/lookup")
        missed = found.where("answer is null").groupBy("doc_id", "reads").agg(F.array_sort(F.collect_list("name")).alias("names"))
        todo = todo.drop("names").join(missed, ["doc_id", "reads"])
    judged = _stored(ask_classifier(todo, classifier, asks), f"{folder}/first")
    refused = judged.where("error = 'too_big'").groupBy("doc_id", "reads").agg(F.array_sort(F.collect_list("name")).alias("names"))
    if not refused.isEmpty():
        smaller = requests(docs.join(refused.select("doc_id").distinct(), "doc_id", "left_semi"), asks, caps, metadata, shrink=True)
        second = _stored(ask_classifier(smaller.drop("names").join(refused, ["doc_id", "reads"]), classifier, asks), f"{folder}/second")
        judged = judged.where("error is null or error <> 'too_big'").union(second)
    judged = judged.withColumn("cached", F.lit(False))
    if found is not None:
        judged = judged.join(found.select("doc_id", "reads", "name", "cache_key"), ["doc_id", "reads", "name"], "left")
        hits = found.where("answer is not null").withColumn("a", F.from_json("answer", ANSWER))
        judged = judged.unionByName(hits.select("doc_id", "reads", "name", "coverage", "a.*", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"), "cache_key"))
    else:
        judged = judged.withColumn("cache_key", F.lit(None).cast("string"))
    judged = judged.withColumn("coverage", F.from_json("coverage", COVERAGE))
    return planner.plan_asks(docs, asks).select("doc_id", "name", "skipped", "note").join(judged, ["doc_id", "name"], "left")


def new_cache_rows(answers: DataFrame) -> DataFrame:
    """cache_key and answer of what a classifier answered now, for appending; equal keys have equal answers."""
    answer = F.to_json(F.struct("value_str", "value_num", "probabilities", "confidence"))
    return answers.where("cache_key is not null and not cached and error is null").groupBy("cache_key").agg(F.first(answer).alias("answer"))


def records(answers: DataFrame) -> DataFrame:
    """One record a document: status, errors, answers by name, usage. No answer is dropped; a failed one makes it partial."""
    one = F.struct("value_str", "value_num", "probabilities", "confidence", "coverage", "skipped", "note")
    entry = F.when(F.col("error").isNull(), F.struct("name", one.alias("answer")))
    error = F.when(F.col("error").isNotNull(), F.struct(F.lit("classify").alias("stage"), F.col("error").alias("code"), F.col("name").alias("message")))
    out = answers.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).alias("answers"),
        F.collect_list(error).alias("errors"),
        F.count_distinct(F.when(~F.col("cached"), F.col("reads"))).alias("requests"),
        F.count_if("cached").alias("cache_hits"),
    )
    status = F.when(F.size("errors") > 0, "partial").otherwise("ok")
    return out.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "doc_id", status.alias("status"), "errors", "answers", F.struct("requests", "cache_hits").alias("usage"))
