"""The engine from documents to records: grouping, one call a request, the cache, the retry, and failures."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators.planner import Ask, Capabilities
from paperloom.plans import judging
from paperloom.sources.html import visible_text

ASKS = [Ask("risk", "noul", "Is there risk?", reads=("risk_factors",)), Ask("tone", "score", "How good?", (("low", None), ("high", None)), reads=("risk_factors",)), Ask("topic", "choice", "Which?", (("law", None), ("money", None)))]
WORDS = {"risk": {"yes": ["loss"], "no": ["gain"]}, "tone": {"low": ["loss"], "high": ["gain"]}, "topic": {"law": ["court"], "money": ["cash"]}}
SECTION = "named_struct('keys', array('risk_factors'), 'label', 'Risks', 'form_ref', '10-K 1A', 'spans', array(named_struct('start', 6, 'end', 20)), 'method', 'm', 'confidence', 0.7D, 'flags', cast(array() as array<string>), 'est_tokens', 5)"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, "court loss loss gain " + "cash " * 3, True), (2, "cash " * 10, False), (3, "", False)], "doc_id long, text string, has boolean")
    sections = F.when(F.col("has"), F.expr(f"array({SECTION})")).otherwise(F.expr(f"filter(array({SECTION}), x -> false)"))
    return rows.select("doc_id", "text", F.expr("cast(array() as array<struct<number:int,start:int,end:int>>)").alias("pages"), sections.alias("sections"), F.lit("t").alias("title"))


def test_asks_that_read_the_same_share_a_request(docs):
    got = {(r.doc_id, r.reads): r.names for r in judging.requests(docs, ASKS).collect()}
    assert got == {(1, "risk_factors"): ["risk", "tone"], (1, "*"): ["topic"], (2, "*"): ["topic"], (3, "*"): ["topic"]}


def test_answers_and_skips(docs):
    got = {(r.doc_id, r.name): r for r in judging.judge_documents(docs, ASKS, judging.Keywords(WORDS)).collect()}
    assert len(got) == 9
    assert got[1, "risk"].value_num == pytest.approx(3 / 5) and got[1, "tone"].confidence == pytest.approx(3 / 5)
    assert got[1, "topic"].value_str == "money" and got[3, "topic"].value_str == "law"
    assert got[2, "risk"].skipped == "missing section: risk_factors" and got[2, "risk"].value_num is None
    assert [tuple(s) for s in got[1, "risk"].coverage.spans] == [(6, 20)] and got[1, "topic"].coverage.sections == []


def test_cache_answers_again_without_calls(spark, docs):
    class Never:
        def answer(self, state, asks):
            raise judging.ClassifierError("unavailable")

    none = spark.createDataFrame([], "cache_key string, answer string")
    first = judging.judge_documents(docs, ASKS, judging.Keywords(WORDS), cache=none)
    cache = judging.new_cache_rows(first)
    assert cache.count() == 5
    again = judging.judge_documents(docs, ASKS, Never(), cache=cache)
    columns = ["doc_id", "name", "value_str", "value_num", "confidence", "skipped", "error"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, first.select(columns).collect()))
    partly = judging.judge_documents(docs, ASKS, Never(), cache=cache.where(F.length("answer") % 2 == 0))
    assert {r.error for r in partly.collect()} <= {None, "unavailable"}


def test_too_big_is_shrunk_once(docs):
    got = {(r.doc_id, r.name): r for r in judging.judge_documents(docs, ASKS, judging.Keywords(WORDS, most_chars=44)).collect()}
    assert got[2, "topic"].error is None and got[2, "topic"].coverage.shrunk and got[2, "topic"].coverage.truncated
    assert not got[1, "topic"].coverage.shrunk
    got = judging.judge_documents(docs, ASKS, judging.Keywords(WORDS, most_chars=20))
    assert {(r.doc_id, r.error) for r in got.where("name = 'topic'").collect()} == {(1, "too_big"), (2, "too_big"), (3, None)}


def test_missing_result_makes_a_partial_record(docs):
    words = {k: v for k, v in WORDS.items() if k != "tone"}
    got = {r.doc_id: r for r in judging.records(judging.judge_documents(docs, ASKS, judging.Keywords(words))).collect()}
    assert [(got[i].status, got[i].usage.requests) for i in (1, 2, 3)] == [("partial", 2), ("ok", 1), ("ok", 1)]
    assert [(e.code, e.message) for e in got[1].errors] == [("missing_result", "tone")] and set(got[2].answers) == {"risk", "tone", "topic"}


def test_budget_cuts(spark, docs):
    caps = Capabilities(token_budget=40, overhead=0)
    got = judging.requests(docs, ASKS[2:], caps).where("doc_id = 2").select(F.get_json_object("state", "$.document.text").alias("t"), F.from_json("coverage", judging.COVERAGE).alias("c")).first()
    whole = judging.requests(docs, ASKS[2:]).where("doc_id = 2").select(F.get_json_object("state", "$.document.text").alias("t")).first()
    assert len(whole.t) == 50 and len(got.t) <= 50 and got.c.est_tokens <= 40


def test_hidden_elements_are_not_visible(spark):
    page = "<p>a</p><div style='display:none'>no</div><script>x</script> b <ix:header>h</ix:header>"
    assert spark.range(1).select(visible_text(F.lit(page)).alias("t")).first().t == "a b"
