"""Queries of whole jobs and of the lookups around them, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookups, records
from ..operators.planner import Capabilities
from ..sources import html
from ..streaming import runtime
from . import catalogue as C
from . import fixtures as X
from . import judging
from .catalogue import query

WORDS = {"risk": {"yes": ["er", "on"], "no": ["en"]}, "outlook": {"poor": ["er"], "fair": ["on"], "good": ["en"]}, "topic": X.CHOICE}
_CAPS = Capabilities(token_budget=10_000_000)


def _documents(spark, sf_dir):
    none = F.expr("cast(array() as array<struct<number:int,start:int,end:int>>)")
    return C._detected(spark, sf_dir).select("doc_id", "text", none.alias("pages"), "sections", F.concat(F.lit("filing "), F.col("doc_id")).alias("title"))


def _hits(words: list[str]) -> str:
    return " + ".join(["1", *(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)])


_ANSWERS_SQL = f"""{C._PLAN_SQL},
    parts as (select doc_id, {C._KEY_SQL} as key, substring(text, start + 1, "end" - start) as body from pointers where not points),
    r as (select * from parts where key = 'risk_factors'), m as (select * from parts where key = 'mdna'),
    asked as (select doc_id, 'risk' as name, body as text, null as skipped, null as note from r
        union all select doc_id, 'risk', null, 'missing section: ' || risk_name, null from named where not risk
        union all select doc_id, 'topic', text, null, null from filings
        union all select n.doc_id, 'outlook', case when mdna and risk then m.body || chr(10) || chr(10) || r.body else f.text end, null,
            case when not (mdna and risk) then 'missing section: ' || concat_ws(', ', case when not mdna then mdna_name end, case when not risk then risk_name end) || '; read head+tail instead' end
            from named n join filings f using (doc_id) left join r using (doc_id) left join m using (doc_id)),
    h as (select *, {_hits(["er", "on"])} as y, {_hits(["er"])} as er, {_hits(["on"])} as o, {_hits(["en"])} as en, {_hits(["in", "de"])} as legal, {_hits(["on", "que"])} as finance from asked),
    answered as (select doc_id, name, skipped, note, case when name = 'topic' then case when legal >= greatest(finance, 1) then 'legal' else 'finance' end end as value_str,
        round(case name when 'risk' then y / (y + en) when 'outlook' then (o + 2 * en) / (er + o + en) end, 6) as value_num,
        round(case name when 'outlook' then greatest(er, o, en) / (er + o + en) when 'topic' then greatest(legal, finance, 1) / (legal + finance + 1) end, 6) as confidence from h)"""


@query(f"with {_ANSWERS_SQL} select * from answered")
def judged_answers(spark, sf_dir):
    """The whole engine: filings to sections, requests by what is read, one call each, and an answer for every ask."""
    got = judging.judge_documents(_documents(spark, sf_dir), X.ASKS, judging.Keywords(WORDS), _CAPS)
    return got.select("doc_id", "name", "skipped", "note", "value_str", F.round("value_num", 6).alias("value_num"), F.round("confidence", 6).alias("confidence"))


@query(f"with {_ANSWERS_SQL} select doc_id, 'ok' as status, count(*) as n_answers, count(skipped) as n_skipped, count(distinct case when skipped is null then case when note is not null or name = 'topic' then '*' else name end end) as requests from answered group by doc_id")
def judged_records(spark, sf_dir):
    """The engine's records, with the number of requests that each document took."""
    r = judging.records(judging.judge_documents(_documents(spark, sf_dir), X.ASKS, judging.Keywords(WORDS), _CAPS))
    skipped = F.filter(F.map_values("answers"), lambda a: a["skipped"].isNotNull())
    return r.select("doc_id", "status", F.size("answers").cast("long").alias("n_answers"), F.size(skipped).cast("long").alias("n_skipped"), F.col("usage.requests").alias("requests"))


_HIDDEN = r"(?is)<(?:ix:header|script|style)\b.*?</(?:ix:header|script|style)\s*>"


_SHOWN = rf"regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _name, _code in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("nbsp", 32), ("copy", 169), ("middot", 183), ("mdash", 8212), ("#8217", 8217), ("amp", 38)):
    _SHOWN = f"replace({_SHOWN}, '&{_name};', chr({_code}))"


@query(rf"select page_id, md5(trim(regexp_replace({_SHOWN}, '[\s\x{{00a0}}]+', ' ', 'g'))) as digest from pages")
def visible_text(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", F.md5(html.visible_text(F.col("html"))).alias("digest"))


_DICTIONARY = ["the", "and", "of", "de", "la", "le", "und", "der", "que"]


@query(f"with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') as ws from documents) select doc_id, round(case when len(ws) > 0 then len(list_filter(ws, lambda x: list_contains({_DICTIONARY}, x))) / len(ws) else 0.0 end, 6) as ratio from w")
def word_ratios(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.round(T.word_ratio(F.col("text"), _DICTIONARY), 6).alias("ratio"))


@query("""select iso, any_value(case iso when 'EN' then 'eng' when 'no' then 'nor' when 'he' then 'heb' when 'hi' then 'hin' when 'zh' then 'chi_sim' when 'fr' then 'fra' when 'de' then 'deu' when 'es' then 'spa' when 'en' then 'eng' end) as code, count(*) as n
    from (select case when doc_id % 8 < 7 then ['EN', 'no', 'he', 'hi', 'zh', 'nb', 'hu'][doc_id % 8 + 1] else lang end as iso from documents) group by iso""")
def language_codes(spark, sf_dir):
    iso = F.coalesce(F.get(F.array(*map(F.lit, ("EN", "no", "he", "hi", "zh", "nb", "hu"))), (F.col("doc_id") % 8).cast("int")), F.col("lang"))
    d = X.documents(spark, sf_dir).select(iso.alias("iso"), T.language_code(iso).alias("code"))
    return d.groupBy("iso").agg(F.first("code").alias("code"), F.count("*").alias("n"))


@query("select event_id, least(0.5 * pow(2, event_id % 6), 5.0) as backoff_s, least(1800, 60 + 20.0 * (event_id % 200))::double as timeout_s, (event_id % 100) * 0.8::double as ceiling from events")
def worker_limits(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select("event_id", runtime.backoff(n % 6).alias("backoff_s"), runtime.document_timeout(n % 200, 20.0).alias("timeout_s"), runtime.ceiling(n % 100).alias("ceiling"))


@query("select doc_id, case when doc_id % 3 = 0 then 'nfs4' when doc_id % 3 = 1 then 'xfs' else 'ext4' end as kind from documents")
def mount_prefix(spark, sf_dir):
    path = F.concat(F.element_at(F.array(F.lit("/data/in/"), F.lit("/database/"), F.lit("/home/")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("doc_id").cast("string"))
    return X.documents(spark, sf_dir).select("doc_id", lookups.longest_mount(path, [("/", "ext4"), ("/data", "btrfs"), ("/data/in", "nfs4"), ("/database", "xfs")]).alias("kind"))


def _inputs(spark, sf_dir):
    return X.documents(spark, sf_dir).select(F.col("doc_id").alias("ref"), F.lit("fast").alias("profile"), F.col("lang").alias("language"))


def _overrides(spark, sf_dir):
    return X.documents(spark, sf_dir).where("doc_id % 5 = 0").select((F.col("doc_id") * 2).alias("ref"), F.lit("quality").alias("profile"), F.lit(None).cast("string").alias("language"))


@query("select doc_id as ref, case when doc_id % 10 = 0 then 'quality' else 'fast' end as profile, lang as language from documents")
def override_lookup(spark, sf_dir):
    return lookups.with_overrides(_inputs(spark, sf_dir), _overrides(spark, sf_dir), "profile", "language")


@query("select 2 * doc_id as ref from documents where doc_id % 5 = 0 and 2 * doc_id not in (select doc_id from documents)")
def stray_overrides(spark, sf_dir):
    return lookups.stray_overrides(_inputs(spark, sf_dir), _overrides(spark, sf_dir)).select("ref")


@query("select (doc_id // 4) * 4 as doc_id, doc_id as exhibit_id from documents where doc_id % 4 <> 0 and (doc_id // 4) * 4 in (select doc_id from documents)")
def exhibit_groups(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 4).alias("group"), (F.col("doc_id") % 4 == 0).alias("main"))
    return lookups.exhibits(d)


@query("select lang, min('/packs/' || lpad((doc_id % 5)::varchar, 2, '0')) as place from documents group by lang")
def pack_directory(spark, sf_dir):
    places = X.documents(spark, sf_dir).select("lang", (F.col("doc_id") % 5).alias("priority"), F.concat(F.lit("/packs/"), F.lpad((F.col("doc_id") % 5).cast("string"), 2, "0")).alias("place"))
    return lookups.first_place(places, "lang")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents) where k <= 3")
def first_picks(spark, sf_dir):
    return lookups.first_n(X.documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 3)


@query("select doc_id, lang from documents order by md5(doc_id || '-7'), doc_id limit 20")
def sampled_documents(spark, sf_dir):
    """A spot check: 20 documents by hash, the same on any layout. The limit is the feature."""
    return records.sample_rows(X.documents(spark, sf_dir).select("doc_id", "lang"), 20, 7)


@query("select case when doc_id % 10 = 0 then 'removed' when doc_id % 10 = 1 then 'changed' else 'same' end as change, count(*) as n from documents group by 1")
def change_counts(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("doc_id", "lang", "source")
    now = d.where("doc_id % 10 <> 0").withColumn("lang", F.when(F.col("doc_id") % 10 == 1, "zz").otherwise(F.col("lang")))
    return lookups.change_counts(d, now, "doc_id", "lang", "source")


@query("select source as name, count(*) as n from documents group by source having count(*) > 1")
def duplicate_names(spark, sf_dir):
    return lookups.duplicate_names(X.documents(spark, sf_dir).select(F.col("source").alias("name")))


@query("select event_id as doc_id, case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'done' else 'classifying' end as state from events")
def records_streamed(spark, sf_dir):
    """Record versions from a stream, upserted batch by batch under a checkpoint that resumes it; the latest wins."""
    schema = X.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may also be one file
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("classifying")
    versions = stream.select(F.col("event_id").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), state.alias("state"))
    versions = versions.withColumn("state", F.when(F.col("version") == 1, "queued").otherwise(F.col("state")))
    folder = runtime.shared_folder(spark)
    runtime.upsert_stream(versions, f"{folder}/out", f"{folder}/checkpoint")
    return records.latest_records(spark.read.schema(versions.schema).parquet(f"{folder}/out").drop("batch"))
