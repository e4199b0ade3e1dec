import math
import random

import pytest

from paperloom import specs as P
from paperloom.cli import doctor, main, report
from paperloom.operators.locator import place_all
from paperloom.sources.html import parse_text
from paperloom.streaming import runtime as R


def codes(spec, **k):
    return [f.code for f in P.validate(spec, **k)]


def test_findings():
    tax = P.Taxonomy("t", ["a", "b"])
    assert codes(P.JobSpec(["x"])) == ["no_judgments"]
    assert codes(P.JobSpec(["x"], tax)) == []
    assert codes(P.JobSpec(["x"], tax, question_sets=["/no/such.yaml"])) == ["question_set_unreadable"]
    assert codes(P.JobSpec(["x"], tax, question_sets=[P.QuestionSet("s", 1, taxonomy=P.Taxonomy("u", ["c"]))])) == ["multiple_taxonomies"]
    assert codes(P.JobSpec(["x"], tax, [P.Question("t", "noul", "Is the document?")])) == ["duplicate_name"]
    assert codes(P.JobSpec(["x"], P.Taxonomy("t", [f"c{i}" for i in range(255)]))) == ["too_many_options"]
    assert codes(P.JobSpec(["x"], P.Taxonomy("t", ["a"], reads=("mdnaa",)))) == ["unknown_reads_key"]
    assert codes(P.JobSpec(["x"], tax, overrides={"y": {}})) == ["unknown_override"]
    assert codes(P.JobSpec(["x"], tax, ocr_languages=["auto", "xx", "ja"], profile="quality")) == ["unsupported_ocr_language"] * 3
    assert codes(P.JobSpec(["x"], P.Taxonomy("t", [P.Category("a", "d" * 30_000)]))) == ["taxonomy_budget"]
    assert codes(P.JobSpec(["x"], questions=[P.Question("q", "noul", "Is it documented?")])) == ["instructions_ignore_document"]


def test_overrides_are_checked_with_their_own_settings():
    tax = P.Taxonomy("t", ["a"])
    spec = lambda given: P.JobSpec(["x"], tax, overrides={"x": given})
    assert codes(spec({"profile": "quality", "ocr_languages": ["ja"]})) == ["unsupported_ocr_language"]
    assert codes(spec({"ocr_languages": ["no"]})) == codes(spec({"profile": "quality"})) == []
    assert codes(spec({"ocr_languages": ["nb"]})) == ["unsupported_ocr_language"]
    manifest = P.resolve(P.JobSpec(["x"], question_sets=[P.QuestionSet("s", 1, [P.Question("q", "noul", "Is the document?")])]))
    assert manifest["question_sets"][0]["hash"].startswith("sha256:") and manifest["price_table_version"]


def test_close_names_are_suggested():
    found = P.validate(P.JobSpec(["x"], P.Taxonomy("t", ["a"], reads=("risk_factor",))))
    assert "risk_factors" in found[0].message


@pytest.mark.parametrize("bad", [lambda: P.Taxonomy("t", ["a", "a"]), lambda: P.Question("q", "noul", "i", ["a", "b"]), lambda: P.Question("q", "score", "i", ["a"]), lambda: P.Taxonomy("t", ["a"], escalate_below=1.5), lambda: P.JobSpec([]), lambda: P.QuestionSet("s", True), lambda: P.JobSpec(["x"], max_cost_usd=0)])
def test_models_refuse(bad):
    with pytest.raises(ValueError):
        bad()


def test_manifest_adds_other_and_hash_ignores_absent_values(tmp_path):
    (tmp_path / "t.yaml").write_text("name: t\ncategories:\n  - {name: a, description: b}\n  - c\n")
    tax = P.load_taxonomy(tmp_path / "t.yaml")
    manifest = P.resolve(P.JobSpec(["x"], tax))
    assert [c["name"] for c in manifest["taxonomy"]["categories"]] == ["a", "c", "other"]
    assert tax.hash == P.Taxonomy("t", [P.Category("a", "b"), "c"]).hash != P.Taxonomy("t", ["a", "c"]).hash
    with pytest.raises(P.SpecError):
        P.resolve(P.JobSpec(["x"]))


def answered(limiter, *calls):
    return {c.seq: (c.started, done, factor) for c, done, factor in limiter.answers([R._Call(i, *c[:1], **c[1]) for i, c in enumerate(calls)])}


def test_pacing():
    """Five requests of 1,000 tokens at 2,000 a second take a second and a half; so do five at two a second."""
    got = answered(R.Limiter(2000, 1e9), *[(0.0, {"tokens": 1000})] * 5)
    assert [got[i][0] for i in range(5)] == pytest.approx([0, 0, 0.5, 1.0, 1.5])
    got = answered(R.Limiter(1e12, 2), *[(0.0, {"tokens": 1})] * 5)
    assert [got[i][0] for i in range(5)] == pytest.approx([0, 0, 0.5, 1.0, 1.5])


def test_usage_settles_the_estimate():
    cheap = answered(R.Limiter(2000, 1e9), *[(0.0, {"tokens": 1000, "actual": 100})] * 5)
    assert cheap[4][0] < 0.1
    costly = answered(R.Limiter(2000, 1e9), *[(0.0, {"tokens": 1000, "actual": 3000})] * 3)
    assert 2.4 <= costly[2][0] <= 2.6


def test_at_most_so_many_in_flight():
    got = answered(R.Limiter(1e12, 1e9), *[(0.0, {"tokens": 1, "seconds": 10.0})] * 70)
    assert [got[63][0], got[64][0], got[69][0]] == [0.0, 10.0, 10.0]


def test_throttling_waits_and_cuts_once_an_episode():
    limiter = R.Limiter(1000, 100)
    got = answered(limiter, (0.0, {"tokens": 1, "throttled": 1, "retry_after": 5.0}))
    assert got[0][1] == 5.0 and got[0][2] == pytest.approx(0.7)
    assert answered(R.Limiter(1000, 100), (0.0, {"tokens": 1, "throttled": 2}))[0][2] == pytest.approx(0.49)
    many = answered(R.Limiter(1000, 100), *[(0.0, {"tokens": 1, "seconds": 1.0, "throttled": 1, "retry_after": 2.0})] * 20)
    assert [f for _, _, f in many.values()] == pytest.approx([0.7] * 20)  # all were in flight when the first was refused


def test_quiet_minutes_raise_the_factor():
    limiter = R.Limiter(1000, 100)
    calls = [(0.0, {"tokens": 1, "throttled": 1, "retry_after": 0.0}), *[(t, {"tokens": 1}) for t in (59.0, 60.0, 660.0)]]
    got = answered(limiter, *calls)
    assert [got[i][2] for i in range(4)] == pytest.approx([0.7, 0.7, 0.75, 1.0])


def test_failed_requests_get_their_tokens_back_and_try_again():
    got = answered(R.Limiter(100, 1000), (0.0, {"tokens": 100, "transient": 1}), (0.0, {"tokens": 100}))
    assert got[1][:2] == (0.0, 0.0) and got[0][1] == pytest.approx(1.0)  # the first comes back after half a second and waits for the bucket


def test_priority_goes_first():
    got = answered(R.Limiter(1e12, 1), (0.0, {"tokens": 1}), (0.1, {"tokens": 1}), (0.2, {"tokens": 1, "priority": True}))
    assert [got[i][0] for i in range(3)] == pytest.approx([0.0, 2.0, 1.0])


def test_schedule_streams_keys_and_batches(spark):
    rows = [(k, i, float(i // 5), 700.0, 500.0, 0.5, int(i % 17 == 0), 0, None, False) for k in (1, 2, 3) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, seq long, at double, tokens double, actual double, seconds double, throttled int, transient int, retry_after double, priority boolean")
    got = R.schedule(df, 2000.0, 10.0).collect()
    want = {c.seq: (c.started, done, c.attempts, factor) for c, done, factor in R.Limiter(2000.0, 10.0).answers(R._Call(*r[1:]) for r in rows[:200])}
    assert len(got) == 600 and all((r.started, r.done, r.attempts, r.factor) == want[r.seq] for r in got)


def test_lease(spark):
    rows = [(1, 1, 0.0, 7, "acquire"), (1, 2, 10.0, 8, "acquire"), (1, 3, 40.0, 7, "heartbeat"), (1, 4, 41.0, 8, "acquire"), (1, 5, 50.0, 8, "release"), (1, 6, 51.0, 7, "acquire")]
    got = R.leases(spark.createDataFrame(rows, "resource long, seq long, at double, actor long, action string")).orderBy("seq").collect()
    assert [r.granted for r in got] == [True, False, False, True, True, True]


@pytest.mark.parametrize(("crashes", "n", "cancelled"), [([20], 20, True), ([21], 21, False), ([1], 4, True), ([], 5, False)])
def test_crash_rate(spark, crashes, n, cancelled):
    """19 results and a crash cancel, 20 and a crash do not, a crash at once does; a job stays cancelled."""
    log = spark.createDataFrame([(1, i, i in crashes) for i in range(1, n + 1)], "key long, seq long, crashed boolean")
    assert {r.seq: r.cancel for r in R.crash_rate(log).collect()}[n] is cancelled


def test_escalation_caps_the_first_documents(spark):
    from paperloom.operators.judge import escalation

    for n, share in ((1000, 0.02), (10, 0.5), (3, 0.0), (5, 1.0)):
        rows = [(i * 7919 % 10_007, "q", 0.1 if i % 3 else 0.9, 0.5) for i in range(n)]
        got = {r.doc_id: r.status for r in escalation(spark.createDataFrame(rows, "doc_id long, name string, confidence double, escalate_below double"), share).collect()}
        flagged = sorted(r[0] for r in rows if r[2] < 0.5)
        most = math.ceil(round(n * share, 9))
        assert got == {d: "queued" if i < most else "capped" for i, d in enumerate(flagged)}


@pytest.mark.parametrize(("sic", "sector"), [(3021, "consumer-discretionary"), (3140, "consumer-discretionary"), (3711, "consumer-discretionary"), (6798, "real-estate"), (2834, "health-care"), (1311, "energy"), (1400, "materials"), (3630, "consumer-discretionary"), (3674, "technology"), (7372, "technology"), (4911, "utilities"), (6021, "financials"), (5912, "consumer-staples"), (1531, "industrials"), (9995, "other")])
def test_sectors(spark, sic, sector):
    from pyspark.sql import functions as F

    from paperloom.sources.files import sector_from_sic

    assert spark.range(1).select(sector_from_sic(F.lit(sic)).alias("s")).first().s == sector


@pytest.mark.parametrize("seed", range(20))
def test_whole_text_error_rates_equal_brute_force(spark, seed):
    from paperloom.functions.text import edit_distance

    rng = random.Random(seed)
    a, b = ("".join(rng.choices("abé\n", k=rng.randrange(30))) for _ in range(2))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    assert edit_distance(a, b) == row[-1]


def test_entities_equal_the_parser(spark):
    from html import unescape

    from pyspark.sql import functions as F

    from paperloom.sources.html import decoded

    texts = ["a &mdash; b", "&#8217;&#x2019;&#X2019", "&copy2020 &copy; &notin; &notit; &amp;lt;", "x & y && z&", "&#128; &#0; &#1114112; &#55296;", "&nosuch; &#; &#x;", "no reference", "", "&NotEqualTilde; &lt&gt"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(decoded(F.col("t")).alias("t")).collect()]
    assert got == [unescape(t) for t in texts]


def test_sizes():
    assert R.worker_count(8, 16_000, 150) == 7 and R.worker_count(8, 16_000, 2000, True) == 2 and R.worker_count(1, 100, 150) == 1


def test_locator_moves_on():
    text = "Contents intro words here\nreal intro words here and more\nlast part of it"
    assert place_all(text, ["intro words here", "intro words here and more", "nowhere", ""]) == [(9, 25), (31, 56), None, None]


def test_locator_measures_a_body_by_its_words():
    text = "aa  bb   cc dd zz aa bb cc dd"
    assert place_all(text, ["aa" + "\n" * 12 + "bb cc dd"]) == [(0, 14)]
    assert place_all("aa bb cc", ["aa bb dd"]) == [None]
    assert place_all("one two " * 6, ["one two one two"] * 2) == [(0, 15), (16, 31)]
    words = [f"w{i}" for i in range(30)]
    assert place_all(" ".join(words), [" ".join(words[:20]), " ".join(words[20:])]) == [(0, 69), (70, 109)]
    assert place_all(" ".join(words), [" ".join([*words[:12], "other"])]) == [None]


def test_parser_text():
    page = "<html><head><title>T</title></head><body><p>a  <b>b</b>&nbsp;c<br>d</p><script>var x='</p>';</script>tail<!-- no --></body></html>"
    assert parse_text(page) == "a b c\nd\ntail"


def test_command_line(spark, tmp_path, capsys):
    """Files through the engine to records, the cache that answers the second run, and the checks."""
    import json

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<html><head><title>A</title></head><body><p>courts and claims &mdash; claims</p></body></html>")
    (tmp_path / "in/b.html").write_text("<p>money money markets</p>")
    (tmp_path / "t.yaml").write_text("name: t\ncategories:\n  - {name: law, description: courts claims}\n  - {name: finance, description: money markets}\n")
    cache = ["--cache", f"{tmp_path}/cache"]
    for out in ("one", "two"):
        assert main(["run", f"{tmp_path}/in", f"{tmp_path}/{out}", "--taxonomy", f"{tmp_path}/t.yaml", *cache]) == 0
        rows = [json.loads(x) for p in (tmp_path / out).glob("*.json") for x in p.read_text().splitlines()]
        got = {r["source"]["filename"]: r for r in rows}
        assert {f: r["answers"]["taxonomy"]["value_str"] for f, r in got.items()} == {"a.html": "law", "b.html": "finance"}
        assert "—" in got["a.html"]["text"] and all(r["status"] == "ok" for r in rows)
        assert {r["usage"]["cache_hits"] for r in rows} == ({0} if out == "one" else {1})
    assert main(["clear-cache", f"{tmp_path}/cache"]) == 0 and spark.read.parquet(f"{tmp_path}/cache").count() == 0
    assert main(["validate", "x.pdf"]) == 2 and "no_judgments" in capsys.readouterr().err
    assert main(["validate", "x.pdf", "--taxonomy", f"{tmp_path}/t.yaml"]) == 0


def test_doctor(capsys):
    assert main(["doctor"]) == 0
    assert "pyspark" in capsys.readouterr().out and report(doctor())
