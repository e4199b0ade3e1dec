import json
import math

from pyspark.sql import functions as F

from paperloom.operators import judge, pages, planner
from paperloom.operators.planner import Ask, Capabilities

PAGES = "array(" + ",".join(f"struct({i + 1} as number, {i * 102} as start, {i * 102 + 100} as end)" for i in range(10)) + ")"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ocr_rule_thresholds(spark):
    rows = [("a" * 79, 0.6, 0), ("a" * 79, 0.59, 20), ("a" * 79, 0.59, 19), ("a" * 80, 1.0, 99), ("a" * 95 + "�" * 5, 0.0, 0), ("a" * 96 + "�" * 4, 0.0, 0), (" \n", 0.0, 0)]
    df = spark.createDataFrame(rows, "t string, c double, p int").select(pages.ocr_decision(F.col("t"), F.col("c"), F.col("p")).alias("d"))
    assert [(r.d.ocr, r.d.step) for r in df.collect()] == [(True, 1), (True, 1), (False, 1), (False, 4), (True, 2), (False, 4), (False, 1)]


def test_third_step_runs_only_when_the_first_two_are_open(spark):
    hook = F.expr("struct(t like '%zz%' as ocr)")
    df = spark.createDataFrame([("zz" * 50,), ("ab" * 50,), ("zz",)], "t string").select(pages.ocr_decision(F.col("t"), F.lit(0.0), F.lit(0), hook).alias("d"))
    assert [(r.d.ocr, r.d.step) for r in df.collect()] == [(True, 3), (False, 3), (False, 1)]


def test_page_offsets(spark):
    got = one(spark, pages.page_array(F.expr("array('ab', '', 'cde')")))
    assert [tuple(p) for p in got] == [(1, 0, 2), (2, 4, 4), (3, 6, 9)]


def test_union_of_boxes(spark):
    box = "struct({}D as left, {}D as bottom, {}D as right, {}D as top)".format
    share = lambda *bs: one(spark, pages.covered_share(F.expr(f"array({', '.join(box(*b) for b in bs)})"), F.lit(10.0), F.lit(10.0)))
    assert math.isclose(share((0, 0, 5, 10), (0, 0, 5, 10)), 0.5)
    assert math.isclose(share((0, 0, 6, 6), (4, 4, 20, 20)), 0.36 + 0.36 - 0.04)
    assert share((11, 0, 12, 5), (3, 3, 3, 9)) == 0.0


def test_ranges_of_consecutive_pages(spark):
    assert [tuple(r) for r in one(spark, pages.page_ranges(F.expr("array(1, 2, 3, 7, 9, 10)")))] == [(1, 3), (7, 7), (9, 10)]


def test_cut_snaps_to_pages(spark):
    ext = F.expr("array(struct(cast(null as string) as key, 0 as start, 1018 as end))")
    c = one(spark, planner.cut(ext, F.expr(PAGES), F.lit(415)))
    # 413 characters, less 5: head 102 (ends with page 1), tail 306 (begins with the first page within it)
    assert c.truncated and [tuple(s) for s in c.kept[0].spans] == [(0, 100), (714, 1018)]
    whole = one(spark, planner.cut(ext, F.expr(PAGES), F.lit(2000)))
    assert not whole.truncated and tuple(whole.kept[0].spans[0]) == (0, 1018)
    none = one(spark, planner.cut(ext, F.expr(PAGES), F.lit(0)))
    assert none.truncated and none.kept[0].spans == []


def test_json_escapes_take_more_rounds(spark):
    caps, asks = Capabilities(token_budget=400, overhead=0), [Ask("a", "noul", "x" * 30)]
    text = F.repeat(F.lit('abcdefgh\n'), 200)
    docs = spark.range(1).select(text.alias("text"), F.expr("cast(array() as array<struct<number:int,start:int,end:int>>)").alias("pages"))
    ext = planner.extents(F.col("text"), F.lit(None), None)
    chars = planner.fit_chars(F.col("text"), ext, F.col("pages"), None, {"title": F.lit("t")}, asks, caps)
    state = docs.select("text", "pages", chars.alias("n")).select(planner.state_json(F.col("text"), planner.cut(ext, F.col("pages"), F.col("n"))["kept"], None, {"title": F.lit("t")}).alias("s")).first().s
    assert 0 < len(json.loads(state)["document"]["text"]) < 1100
    assert (len(state) + 30) / 3.0 <= 400


def test_pages_and_escapes_still_end_within_the_budget(spark):
    """Cuts snap to pages, so many rounds may change nothing; the state that is sent fits all the same."""
    caps, asks = Capabilities(token_budget=2000, overhead=0), [Ask("a", "noul", "x" * 30)]
    page = 'say "so" \\n' * 150
    text = "\n\n".join([page] * 9)
    starts = [i * (len(page) + 2) for i in range(9)]
    pages_ = F.array(*[F.struct(F.lit(i + 1).alias("number"), F.lit(s).alias("start"), F.lit(s + len(page)).alias("end")) for i, s in enumerate(starts)])
    docs = spark.createDataFrame([(text,)], "text string").withColumn("pages", pages_)
    ext = planner.extents(F.col("text"), F.lit(None), None)
    chars = planner.fit_chars(F.col("text"), ext, F.col("pages"), None, {"title": F.lit("t")}, asks, caps)
    got = docs.select("text", "pages", chars.alias("n")).select("n", planner.state_json(F.col("text"), planner.cut(ext, F.col("pages"), F.col("n"))["kept"], None, {"title": F.lit("t")}).alias("s")).first()
    assert (len(got.s) + 30) / 3.0 <= 2000 and got.n > 0


def test_state_leaves_absent_metadata_out_and_keeps_read_order(spark):
    kept = F.expr("array(struct('b' as key, array(struct(0 as start, 1 as end)) as spans), struct('a' as key, array(struct(1 as start, 2 as end), struct(3 as start, 4 as end)) as spans), struct('b' as key, array(struct(2 as start, 3 as end)) as spans))")
    state = one(spark, planner.state_json(F.lit("wxyz"), kept, F.expr("array('a', 'b', 'c')"), {"title": F.lit("t"), "form": F.lit(None).cast("string")}))
    assert state == '{"document":{"title":"t","sections":{"a":"x\\n[…]\\nz","b":"w\\n\\ny"}}}'


def test_cache_key_depends_on_every_part(spark):
    a, b = Ask("a", "noul", "one"), Ask("a", "noul", "two")
    keys = spark.range(1).select(planner.cache_key(F.lit("{}"), a, Capabilities()), planner.cache_key(F.lit("{}"), b, Capabilities()), planner.cache_key(F.lit("{ }"), a, Capabilities()), planner.cache_key(F.lit("{}"), a, Capabilities(model="m2"))).first()
    assert len(set(keys)) == 4


def test_retry_shrinks_once(spark):
    reqs = spark.createDataFrame([(1, "q", "x" * 100), (2, "q", "x" * 110), (3, "q", "x" * 200)], "doc_id long, name string, state string")
    local = judge.SizeLimited(lambda name, state: ("yes", 0.9), 100)
    got = judge.retry_too_big(reqs, judge.judge(reqs, local), local, lambda r: r.withColumn("state", F.substring(F.col("state"), F.lit(1), judge.shrunk_chars(F.length("state")))))
    assert sorted((r.doc_id, r.error) for r in got.collect()) == [(1, None), (2, None), (3, "too_big")]


def test_cache_splits_hits_from_misses_and_compacts(spark):
    cache = judge.cache_put(spark.createDataFrame([("a", "old", 1), ("b", "b", 1)], "cache_key string, value string, last_used long"), spark.createDataFrame([("a", "new", 2)], "cache_key string, value string, last_used long"))
    hits, misses = judge.split_by_cache(spark.createDataFrame([("a",), ("c",)], "cache_key string"), cache)
    assert [r.cached_value for r in hits.collect()] == ["new"] and [r.cache_key for r in misses.collect()] == ["c"]
    assert [r.cache_key for r in judge.cache_prune(cache, F.lit(2)).collect()] == ["a"]
