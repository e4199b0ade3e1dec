"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import specs
from ..functions import text as T
from ..operators import judge, locator, metrics, pages, planner, records, sections
from ..sources import files, html
from ..streaming import runtime
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL for the same rows if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- sources ----------------------------------------------------------------------------------------------

_TAXONOMY = {"spam": ["%%%", "***", "###", "!!"], "english": [" the ", " and "], "french": [" les ", " une "], "other": []}
def _sql_html() -> str:
    """Text of a page in SQL, written without the engine's tables: the elements and references that pages can have."""
    out = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    out = rf"regexp_replace({out}, '(?is)<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript|head\b.*?</head|template\b.*?</template)\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("nbsp", 32), ("copy", 169), ("middot", 183), ("mdash", 8212), ("#8217", 8217), ("amp", 38)):
        out = f"replace({out}, '&{name};', chr({code}))"
    return rf"list_aggregate(list_filter(list_transform(string_split({out}, chr(10)), lambda line: trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'))), lambda line: line <> ''), 'string_agg', chr(10))"


_HTML = f"texts as (select page_id, coalesce({_sql_html()}, '') as text from pages)"


def _hits_sql(words: list[str]) -> str:
    return " + ".join(["1", *(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)])


def _choice_sql(options: dict[str, list[str]], source: str) -> str:
    hits = ", ".join(f"{_hits_sql(w)} as h_{n}" for n, w in options.items())
    names = [f"h_{n}" for n in options]
    best = " ".join(f"when h_{n} = greatest({', '.join(names)}) then '{n}'" for n in options)
    return f"hits as (select *, {hits} from {source}), chosen as (select *, case {best} end as value, greatest({', '.join(names)}) / ({' + '.join(names)}) as confidence from hits)"


@query(f"with {_HTML}, {_choice_sql(_TAXONOMY, 'texts')} select value as category, count(*) as n, round(avg(confidence), 6) as mean_confidence from chosen group by value")
def classify_pages_by_taxonomy(spark, sf_dir):
    """Pages to text, to a choice among a taxonomy's categories, to counts."""
    text = X.table(spark, sf_dir, "pages").select(html.html_text(F.col("html")).alias("text"))
    answer = text.select(judge.keyword_choice(F.col("text"), _TAXONOMY).alias("a"))
    return answer.groupBy(F.col("a.value").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("a.confidence"), 6).alias("mean_confidence"))


@query(f"with {_HTML} select page_id, text, length(text)::bigint as n_chars from texts")
def html_text_extract(spark, sf_dir):
    out = X.table(spark, sf_dir, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query(f"with {_HTML} select page_id, md5(text) as digest from texts")
def html_text_parsed(spark, sf_dir):
    """The parser's text, which equals the native one on well-formed pages."""
    return X.table(spark, sf_dir, "pages").select("page_id", F.md5(html.parsed_text("html")).alias("digest"))


@query(r"select page_id, nullif(trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')), '') as title from pages".replace('\\"', '"'))
def html_title(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", html.html_title(F.col("html")).alias("title"))


@query("select doc_id, 'doc' || doc_id || '.txt' as filename, 'txt' as format, sha256(text) as sha256, strlen(text)::bigint as bytes from documents")
def source_metadata(spark, sf_dir):
    s = files.source_struct(F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit(".txt")), F.encode("text", "UTF-8"))
    return X.documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", "s.filename", "s.format", "s.sha256", "s.bytes")


@query("select distinct sha256(text) as sha256, strlen(text)::bigint as bytes from documents")
def content_dedup(spark, sf_dir):
    return files.content_digests(X.documents(spark, sf_dir).select(F.encode("text", "UTF-8").alias("content")))


@query("select doc_id as ref, case when doc_id % 10 = 0 then 'missing' when doc_id % 10 = 1 then 'changed' else 'unchanged' end as state from documents")
def changed_inputs(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select(F.col("doc_id").alias("ref"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    now = docs.where("ref % 10 <> 0").withColumn("sha256", F.when(F.col("ref") % 10 == 1, F.lit("changed")).otherwise(F.col("sha256")))
    return files.changes(docs, now)


_SIC_SQL = """case when sic between 100 and 999 then 'consumer-staples' when sic between 1311 and 1389 then 'energy' when sic between 1000 and 1499 then 'materials'
    when sic between 1500 and 1799 then 'industrials' when sic between 2000 and 2199 then 'consumer-staples' when sic between 2200 and 2399 then 'consumer-discretionary'
    when sic between 2400 and 2509 then 'materials' when sic between 2510 and 2599 then 'consumer-discretionary' when sic between 2600 and 2699 then 'materials'
    when sic between 2700 and 2799 then 'communication' when sic between 2800 and 2829 or sic between 2850 and 2899 then 'materials' when sic between 2830 and 2836 then 'health-care'
    when sic between 2840 and 2844 then 'consumer-staples' when sic between 2900 and 2999 then 'energy' when sic in (3021, 3140, 3630, 3711, 3713, 3714, 3716, 3751) then 'consumer-discretionary'
    when sic between 3000 and 3399 then 'materials' when sic between 3570 and 3579 or sic between 3600 and 3699 then 'technology' when sic between 3840 and 3851 then 'health-care'
    when sic between 3400 and 3799 then 'industrials' when sic between 3800 and 3899 then 'technology' when sic between 3900 and 3999 then 'consumer-discretionary'
    when sic between 4000 and 4799 then 'industrials' when sic between 4800 and 4899 then 'communication' when sic between 4900 and 4999 then 'utilities'
    when sic between 5000 and 5199 then 'industrials' when sic between 5400 and 5499 or sic = 5912 then 'consumer-staples' when sic between 5200 and 5999 then 'consumer-discretionary'
    when sic between 6500 and 6553 or sic = 6798 then 'real-estate' when sic between 6000 and 6799 then 'financials' when sic between 7000 and 7099 then 'consumer-discretionary'
    when sic between 7370 and 7379 then 'technology' when sic between 7800 and 7899 then 'communication' when sic between 8000 and 8099 then 'health-care'
    when sic between 7200 and 8999 then 'industrials' else 'other' end"""


@query(f"select sector, count(*) as n from (select {_SIC_SQL} as sector from (select (doc_id * 37) % 9500 as sic from documents)) group by sector")
def sectors_from_sic(spark, sf_dir):
    sic = (F.col("doc_id") * 37) % 9500
    return X.documents(spark, sf_dir).groupBy(files.sector_from_sic(sic).alias("sector")).agg(F.count("*").alias("n"))


@query("select source, max(doc_id) as doc_id from documents group by source")
def latest_by_source(spark, sf_dir):
    return files.latest_by(X.documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id").select("source", "doc_id")


# ---- pages ------------------------------------------------------------------------------------------------


@query(f"with {X.SQL_SIGNALS} select doc_id, number::bigint as number, ocr, step::bigint as step, reason, chars::bigint as chars, round(ratio, 6) as bad_char_ratio from decided")
def ocr_decisions(spark, sf_dir):
    d = X.page_signals(spark, sf_dir).select("doc_id", "number", pages.ocr_decision(F.col("text"), F.col("image_coverage"), F.col("path_count")).alias("d"))
    return d.select("doc_id", F.col("number").cast("long").alias("number"), "d.ocr", F.col("d.step").cast("long").alias("step"), "d.reason", F.col("d.chars").cast("long").alias("chars"), F.round("d.bad_char_ratio", 6).alias("bad_char_ratio"))


@query(f"with {X.SQL_SIGNALS} select step::bigint as step, ocr, count(*) as n, count(*) filter (where ocr) as flagged from decided group by step, ocr")
def ocr_decision_summary(spark, sf_dir):
    d = X.page_signals(spark, sf_dir).select(pages.ocr_decision(F.col("text"), F.col("image_coverage"), F.col("path_count")).alias("d"))
    return d.groupBy(F.col("d.step").cast("long").alias("step"), F.col("d.ocr").alias("ocr")).agg(F.count("*").alias("n"), F.count_if("d.ocr").alias("flagged"))


_OFFSETS = f'with {X.SQL_PAGES} select doc_id, number::bigint as number, start::bigint as start, (start + n)::bigint as "end" from offsets'


@query(_OFFSETS)
def page_offsets(spark, sf_dir):
    return pages.page_offsets(X.doc_pages(spark, sf_dir)).select("doc_id", *_long("number", "start", "end"))


def _paged(spark, sf_dir) -> DataFrame:
    return X.documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("ts")).select("doc_id", F.array_join("ts", "\n\n").alias("text"), pages.page_array(F.col("ts")).alias("pages"))


@query(_OFFSETS)
def page_arrays(spark, sf_dir):
    """page_offsets without a shuffle, for documents that carry their pages."""
    return _paged(spark, sf_dir).select("doc_id", F.inline("pages")).select("doc_id", *_long("number", "start", "end"))


@query("""
    with recursive boxes as (select page_id, unnest([0, 1, 2]) as k from pages),
    raw as (select page_id, (page_id * 7 + k * 31) % 90 - 10.0 as l, (page_id * 13 + k * 17) % 90 - 10.0 as b, 20.0 + (page_id + k * 11) % 50 as w, 15.0 + (page_id * 3 + k) % 60 as h from boxes),
    c as (select page_id, greatest(0, l) as l, greatest(0, b) as b, least(100, l + w) as r, least(80, b + h) as t from raw),
    v as (select * from c where r > l and t > b),
    xs as (select distinct page_id, x from (select page_id, l as x from v union all select page_id, r from v)),
    ys as (select distinct page_id, y from (select page_id, b as y from v union all select page_id, t from v)),
    xi as (select page_id, x, lead(x) over (partition by page_id order by x) as x1 from xs),
    yi as (select page_id, y, lead(y) over (partition by page_id order by y) as y1 from ys),
    cells as (select xi.page_id, (x1 - x) * (y1 - y) as a from xi join yi using (page_id) where exists (select 1 from v where v.page_id = xi.page_id and l <= x and r >= x1 and b <= y and t >= y1)),
    areas as (select page_id, sum(a) as a from cells group by page_id)
    select p.page_id, round(least(1.0, coalesce(a, 0) / 8000.0), 6)::double as coverage from pages p left join areas using (page_id)""")
def image_coverage_union(spark, sf_dir):
    one = lambda k: F.expr(f"struct((page_id * 7 + {k * 31}) % 90 - 10.0D as left, (page_id * 13 + {k * 17}) % 90 - 10.0D as bottom, (page_id * 7 + {k * 31}) % 90 - 10.0D + 20.0D + (page_id + {k * 11}) % 50 as right, (page_id * 13 + {k * 17}) % 90 - 10.0D + 15.0D + (page_id * 3 + {k}) % 60 as top)")
    boxes = X.table(spark, sf_dir, "pages").select("page_id", F.array(*map(one, range(3))).alias("boxes"))
    return boxes.select("page_id", F.round(pages.covered_share(F.col("boxes"), F.lit(100.0), F.lit(80.0)), 6).alias("coverage"))


_SPAN_SQL = "(select doc_id, 100 as s, 300 as e from documents union all select doc_id, 900, 1000 from documents)"


@query(f"""
    with {X.SQL_PAGES}, spans as {_SPAN_SQL},
    hit as (select distinct o.doc_id, number from offsets o join spans using (doc_id) where start < e and s < start + n),
    runs as (select doc_id, number, number - row_number() over (partition by doc_id order by number) as g from hit)
    select doc_id, min(number)::bigint as lo, max(number)::bigint as hi from runs group by doc_id, g""")
def coverage_page_ranges(spark, sf_dir):
    spans = F.expr("array(struct(100 as start, 300 as end), struct(900 as start, 1000 as end))")
    r = pages.page_ranges(pages.pages_of_spans(F.col("pages"), spans))
    return _paged(spark, sf_dir).select("doc_id", F.inline(r)).select("doc_id", *_long("lo", "hi"))


# ---- sections ---------------------------------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    return sections.exploded(df.select("doc_id", "sections")).select("doc_id", F.col("s.form_ref").alias("form_ref"), F.col("s.label").alias("label"), F.array_join("s.keys", ",").alias("keys"), F.element_at("s.spans", 1)["start"].cast("long").alias("start"), F.element_at("s.spans", 1)["end"].cast("long").alias("end"), F.array_join("s.flags", ",").alias("flags"), F.col("s.method").alias("method"))


def _items(spark, sf_dir) -> DataFrame:
    return X.filings(spark, sf_dir).select("doc_id", "text", "form", sections.item_sections(F.col("text"), F.col("form")).alias("sections"))


#: The items that the fixtures' headings can name, written without the engine's table.
_KEY_SQL = """case when form_ref = '10-K 1' or form_ref = '20-F 4' then 'business' when form_ref in ('10-K 1A', '10-Q II.1A', '20-F 3.D') then 'risk_factors'
    when form_ref in ('10-K 7', '10-Q I.2', '20-F 5') then 'mdna' when form_ref in ('10-Q II.6', '10-K 15', '20-F 19') then 'exhibits' else 'other' end"""
_SECTION_COLS = f'doc_id, form_ref, label, {_KEY_SQL} as keys, start::bigint as start, "end"::bigint as "end"'


@query(f"with {X.SQL_ITEMS} select {_SECTION_COLS} from sections")
def item_sections_all(spark, sf_dir):
    return _flat(_items(spark, sf_dir)).drop("flags", "method")


@query(f"with {X.SQL_ITEMS} select {_SECTION_COLS} from longest where k = 1")
def item_sections_longest(spark, sf_dir):
    return _flat(_items(spark, sf_dir).withColumn("sections", sections.longest_per_ref(F.col("sections")))).drop("flags", "method")


@query(f"with {X.SQL_FILINGS} select doc_id, form as inferred from filings")
def form_inference(spark, sf_dir):
    return X.filings(spark, sf_dir).select("doc_id", T.infer_form(F.col("text")).alias("inferred"))


@query(f"with {X.SQL_FILINGS} select doc_id, form as base from filings")
def form_normalise(spark, sf_dir):
    variant = F.concat(F.lit(" "), F.lower("form"), F.element_at(F.array(F.lit("/A"), F.lit(""), F.lit(" ")), (F.col("doc_id") % 3 + 1).cast("int")))
    return X.filings(spark, sf_dir).select("doc_id", T.base_form(variant).alias("base"))


@query(f"with {X.SQL_ITEMS} select key, count(*) as n from (select {_KEY_SQL} as key from sections) group by key")
def section_keys_by_form(spark, sf_dir):
    return _flat(_items(spark, sf_dir)).groupBy(F.col("keys").alias("key")).agg(F.count("*").alias("n"))


_SYNONYMS_SQL = f"""{X.SQL_REPORTS}, {X.SQL_LINES.format("reports")},
    found as (select doc_id, text, line, pos, case line when '1. Strategic report' then 'business' when 'Principal risks and uncertainties' then 'risk_factors' else 'mdna' end as key,
        lead(pos, 1, length(text)) over (partition by doc_id order by i) as nxt from lines where line in ('1. Strategic report', 'Principal risks and uncertainties', 'Financial Review .... 12')),
    ended as (select *, pos + length(regexp_replace(substring(text, pos + 1, nxt - pos), '\\s+$', '')) as "end" from found),
    synonyms as (select doc_id, line as label, key as keys, pos::bigint as start, "end"::bigint as "end" from ended where "end" - pos >= 200)"""


@query(f"with {_SYNONYMS_SQL} select * from synonyms")
def synonym_sections(spark, sf_dir):
    found = X.annual_reports(spark, sf_dir).select("doc_id", sections.synonym_sections(F.col("text")).alias("sections"))
    return _flat(found).drop("flags", "method", "form_ref")


_HEADINGS = "array(struct('Our business' as text, 40 as start, 1 as level), struct('Notes' as text, 10 as start, 1 as level), struct(concat('Litigation ', doc_id % 3) as text, 20 as start, 2 as level), struct('Chair''s letter' as text, 0 as start, 1 as level))"


@query("select doc_id, unnest(['Chair''s letter', 'Notes']) as heading from documents")
def unmatched_headings(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select("doc_id", F.explode(sections.unmatched_headings(F.expr(_HEADINGS))).alias("h"))
    return docs.select("doc_id", F.col("h.text").alias("heading"))


@query(f"""
    with {X.SQL_PAGES}, entries as (select doc_id, unnest([0, 1, 50]) as page_index, unnest(['the', 'de', 'zzz']) as title from documents)
    select e.doc_id, e.title, (start + greatest(instr(text, title) - 1, 0))::bigint as start from entries e join offsets o on o.doc_id = e.doc_id and o.number = e.page_index + 1 join pages_ p on p.doc_id = o.doc_id and p.number = o.number""")
def outline_headings(spark, sf_dir):
    entries = F.expr("array(struct(1 as level, 'the' as title, 0 as page_index), struct(1 as level, 'de' as title, 1 as page_index), struct(1 as level, 'zzz' as title, 50 as page_index))")
    h = sections.outline_headings(F.col("text"), F.col("pages"), entries)
    return _paged(spark, sf_dir).select("doc_id", F.inline(h)).select("doc_id", F.col("text").alias("title"), F.col("start").cast("long").alias("start"))


_POINTERS_SQL = f"""{X.SQL_ITEMS},
    bodies_ as (select *, trim(case when instr(substring(text, start + 1, "end" - start), chr(10)) > 0 then regexp_replace(substring(text, start + 1, "end" - start), '^[^\\n]*\\n', '') else '' end) as body from longest where k = 1),
    pointers as (select *, length(body) between 1 and 600 and regexp_matches(body, 'incorporated by reference') as points from bodies_)"""


@query(f"with {_POINTERS_SQL} select doc_id, form_ref, 'Exhibit 13.1' as target from pointers where points")
def pointer_targets(spark, sf_dir):
    found = sections.exploded(_items(spark, sf_dir).select("doc_id", "text", sections.longest_per_ref(F.col("sections")).alias("sections")))
    return found.select("doc_id", F.col("s.form_ref").alias("form_ref"), sections.pointer_target(F.col("text"), F.col("s")).alias("target")).where("target is not null")


def _detected(spark, sf_dir) -> DataFrame:
    f = X.filings(spark, sf_dir)
    return f.select("doc_id", "text", "form", sections.detect_sections(F.col("text"), F.col("form")).alias("sections"))


@query(f"with {_POINTERS_SQL} select doc_id, form_ref, {_KEY_SQL} as keys, case when points then 'pointer' else '' end as flags from pointers")
def pointer_sections(spark, sf_dir):
    return _flat(_detected(spark, sf_dir)).select("doc_id", "form_ref", "keys", "flags")


@query(f"with {_POINTERS_SQL} select doc_id, form_ref from pointers where not points")
def usable_sections(spark, sf_dir):
    return _flat(_detected(spark, sf_dir).withColumn("sections", sections.usable(F.col("sections")))).select("doc_id", "form_ref")


@query(f"""
    with {_POINTERS_SQL}, {_SYNONYMS_SQL.replace(X._SQL_BODIES + ",", "").replace("cut as", "cut2 as").replace("rows_ as", "rows2 as").replace("from cut)", "from cut2)").replace("lines as", "lines2 as").replace("from rows_)", "from rows2)").replace("from lines where", "from lines2 where")}
    select 'filing' as kind, 'item_regex' as method, count(*) as n from pointers union all select 'report', 'heading_synonym', count(*) from synonyms""")
def detector_chain(spark, sf_dir):
    a = X.filings(spark, sf_dir).select(F.lit("filing").alias("kind"), "doc_id", "text", "form")
    b = X.annual_reports(spark, sf_dir).select(F.lit("report").alias("kind"), "doc_id", "text", F.lit(None).cast("string").alias("form"))
    found = sections.exploded(a.union(b).select("kind", sections.detect_sections(F.col("text"), F.col("form")).alias("sections")))
    return found.groupBy("kind", F.col("s.method").alias("method")).agg(F.count("*").alias("n"))


# ---- planning ---------------------------------------------------------------------------------------------

_PLAN_SQL = f"""{_POINTERS_SQL},
    have as (select doc_id, bool_or(not points and {_KEY_SQL} = 'risk_factors') as risk, bool_or(not points and {_KEY_SQL} = 'mdna') as mdna,
        max(case when points and {_KEY_SQL} = 'risk_factors' then form_ref end) as risk_pointer, max(case when points and {_KEY_SQL} = 'mdna' then form_ref end) as mdna_pointer from pointers group by doc_id),
    named as (select *, case when risk_pointer is null then 'risk_factors' else 'risk_factors (pointer → ' || risk_pointer || ')' end as risk_name,
        case when mdna_pointer is null then 'mdna' else 'mdna (pointer → ' || mdna_pointer || ')' end as mdna_name from have)"""


@query(f"with {_PLAN_SQL} select doc_id, 'risk' as name, 'missing section: ' || risk_name as skipped from named where not risk")
def skipped_answers(spark, sf_dir):
    return planner.plan_asks(_detected(spark, sf_dir), X.ASKS).where("skipped is not null").select("doc_id", "name", "skipped")


@query(f"with {_PLAN_SQL} select doc_id, 'outlook' as name, 'missing section: ' || concat_ws(', ', case when not mdna then mdna_name end, case when not risk then risk_name end) || '; read head+tail instead' as note from named where not (mdna and risk)")
def fallback_answers(spark, sf_dir):
    return planner.plan_asks(_detected(spark, sf_dir), X.ASKS).where("note is not null").select("doc_id", "name", "note")


@query(f"""with {_PLAN_SQL},
    asked as (select doc_id, 'topic' as name, '*' as reads from named union all select doc_id, 'risk', 'risk_factors' from named where risk
        union all select doc_id, 'outlook', case when mdna and risk then 'mdna|risk_factors' else '*' end from named)
    select doc_id, reads, string_agg(name, ',' order by name) as names from asked group by doc_id, reads""")
def request_groups(spark, sf_dir):
    g = planner.request_groups(planner.plan_asks(_detected(spark, sf_dir), X.ASKS))
    return g.select("doc_id", "reads", F.array_join("names", ",").alias("names"))


@query(f"""
    with {X.SQL_PAGES}, docs as (select doc_id, (max(start + n))::bigint as size from offsets group by doc_id),
    heads as (select d.doc_id, size, coalesce((select max(start + n) from offsets o where o.doc_id = d.doc_id and start + n > 0 and start + n <= 123), 123) as h,
        coalesce((select min(start) from offsets o where o.doc_id = d.doc_id and start >= size - 370 and start < size), size - 370) as t from docs d)
    select doc_id, size <= 498 as whole, (case when size <= 498 then size else h end)::bigint as head_end, (case when size > 498 then t end)::bigint as tail_start from heads""")
def head_tail_cut(spark, sf_dir):
    docs = _paged(spark, sf_dir)
    c = planner.cut(planner.extents(F.col("text"), F.lit(None), None), F.col("pages"), F.lit(500))
    spans = docs.select("doc_id", c.alias("c")).select("doc_id", F.col("c.truncated").alias("cut"), F.get("c.kept", F.lit(0))["spans"].alias("s"))
    tail = F.when(F.col("cut"), F.element_at("s", -1)["start"])
    return spans.select("doc_id", (~F.col("cut")).alias("whole"), F.get("s", F.lit(0))["end"].cast("long").alias("head_end"), tail.cast("long").alias("tail_start"))


@query("""
    with e as (select doc_id, length(text) // 5 as a, length(text) - length(text) // 5 as b, length(text) as n from documents where length(text) > 700),
    p as (select *, greatest(0, 496 * a // n - 5) as pa, greatest(0, 496 * b // n - 5) as pb from e)
    select doc_id, pa::bigint as first_chars, pb::bigint as second_chars from p""")
def group_proportional_cut(spark, sf_dir):
    docs = X.documents(spark, sf_dir).where(F.length("text") > 700)
    a = F.floor(F.length("text") / 5).cast("int")
    ext = F.array(F.struct(F.lit("x").alias("key"), F.lit(0).alias("start"), a.alias("end")), F.struct(F.lit("y").alias("key"), a.alias("start"), F.length("text").alias("end")))
    none = F.expr("cast(array() as array<struct<number:int,start:int,end:int>>)")
    sizes = F.transform(planner.cut(ext, none, F.lit(500))["kept"], lambda k: F.aggregate(k["spans"], F.lit(0), lambda n, s: n + s["end"] - s["start"]))
    return docs.select("doc_id", sizes.alias("n")).select("doc_id", F.get("n", F.lit(0)).cast("long").alias("first_chars"), F.get("n", F.lit(1)).cast("long").alias("second_chars"))


_STATE = """'{"document":{"title":"doc ' || doc_id || '","text":' || to_json(text) || '}}'"""
_caps = planner.Capabilities()


def _states(spark, sf_dir) -> DataFrame:
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).alias("spans")))
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return X.documents(spark, sf_dir).select("doc_id", planner.state_json(F.col("text"), whole, None, {"title": title}).alias("state"))


_ask_chars = sum(a.chars for a in X.ASKS)


@query(f"select doc_id, round((length({_STATE}) + {_ask_chars}) / 3.0 + 220, 6)::double as est_tokens from documents")
def token_estimates(spark, sf_dir):
    return _states(spark, sf_dir).select("doc_id", F.round(planner.tokens(F.col("state"), _ask_chars, _caps), 6).alias("est_tokens"))


@query(f"select name, chars::bigint as chars from (values {', '.join(f'({chr(39)}{a.name}{chr(39)}, {a.chars})' for a in X.ASKS)}) t(name, chars) order by chars desc limit 1")
def longest_judgment(spark, sf_dir):
    a = planner.longest(X.ASKS)
    return spark.createDataFrame([(a.name, a.chars)], "name string, chars long")


_key_head = f'{{"classifier_id":"{_caps.classifier_id}","judgment":{X.ASKS[0].canonical},"model":"{_caps.model}","state":'


@query(f"select doc_id, sha256('{_key_head}' || {_STATE} || '}}') as cache_key from documents")
def cache_keys(spark, sf_dir):
    return _states(spark, sf_dir).select("doc_id", planner.cache_key(F.col("state"), X.ASKS[0], _caps).alias("cache_key"))


@query("select doc_id % 3 = 0 as hit, count(*) as n from (select min(doc_id) as low, text, unnest(list(doc_id)) as d from documents group by text) join (select doc_id from documents) on doc_id = d group by 1")
def cache_hits_misses(spark, sf_dir):
    req = _states(spark, sf_dir).withColumn("cache_key", planner.cache_key(F.col("state"), X.ASKS[0], _caps))
    cache = req.where("doc_id % 3 = 0").select("cache_key", F.lit("0.5").alias("value"))
    hits, misses = judge.split_by_cache(req, cache)
    return hits.select(F.lit(True).alias("hit")).union(misses.select(F.lit(False).alias("hit"))).groupBy("hit").agg(F.count("*").alias("n"))


@query("select doc_id, (case when length(text) > 1000 then least(length(text), floor(length(text) * 0.85)) else length(text) end)::bigint as sent_chars, length(text) > 1000 and floor(length(text) * 0.85) > 1000 as failed from documents")
def shrink_retry(spark, sf_dir):
    """States of over 1,000 characters are refused once, sent at 85%, and fail if they are refused again."""
    docs = X.documents(spark, sf_dir).select("doc_id", F.lit("topic").alias("name"), F.col("text").alias("state"))
    local = judge.SizeLimited(lambda name, state: ("finance", 1.0), 1000)
    smaller = lambda r: r.withColumn("state", F.substring(F.col("state"), F.lit(1), judge.shrunk_chars(F.length("state"))))
    done = judge.retry_too_big(docs, judge.judge(docs, local), local, smaller).select("doc_id", F.col("error").isNotNull().alias("failed"))
    sizes = docs.select("doc_id", F.when(F.length("state") > 1000, judge.shrunk_chars(F.length("state"))).otherwise(F.length("state")).cast("long").alias("sent_chars"))
    return done.join(sizes, "doc_id").select("doc_id", "sent_chars", "failed")


@query(f"with {_choice_sql(X.CHOICE, 'documents')} select doc_id, value, round(confidence, 6) as confidence from chosen")
def answers_choice(spark, sf_dir):
    a = X.documents(spark, sf_dir).select("doc_id", judge.keyword_choice(F.col("text"), X.CHOICE).alias("a"))
    return a.select("doc_id", "a.value", F.round("a.confidence", 6).alias("confidence"))


@query(f"select doc_id, round((h1 + 2 * h2) / (h0 + h1 + h2), 6) as value from (select doc_id, {_hits_sql(['er'])} as h0, {_hits_sql(['on'])} as h1, {_hits_sql(['en'])} as h2 from documents)")
def answers_score(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.round(judge.keyword_score(F.col("text"), [["er"], ["on"], ["en"]])["value"], 6).alias("value"))


@query(f"select doc_id, round(y / (y + n), 6) as value from (select doc_id, {_hits_sql(['er', 'on'])} as y, {_hits_sql(['en'])} as n from documents)")
def answers_noul(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.round(judge.keyword_noul(F.col("text"), ["er", "on"], ["en"]), 6).alias("value"))


# ---- records ----------------------------------------------------------------------------------------------


@query()
def section_locator(spark, sf_dir):
    """Parsed sections placed in their document's text by their first and last words, in order."""
    rows = X.documents(spark, sf_dir)
    third = F.floor(F.length("text") / 3).cast("int")
    parsed = F.array(F.substring(F.col("text"), F.lit(1), third), F.substring(F.col("text"), third + 1, third), F.substring(F.col("text"), 2 * third + 1, third))
    return locator.locate(rows.select("doc_id", "text", parsed.alias("bodies"))).select("doc_id", F.posexplode("spans").alias("section", "s")).select("doc_id", "section", "s.start", "s.end")


@query("""select * from (values ('error', 'duplicate_name', 'risk'), ('error', 'unknown_reads_key', 't: busines (did you mean business?)'), ('warning', 'taxonomy_budget', 't: options take 13334 tokens of 32000'),
    ('error', 'too_many_options', 'q: 300 of 255'), ('warning', 'instructions_ignore_document', 'risk'), ('error', 'unknown_override', 'b.pdf (did you mean a.pdf?)'), ('error', 'unsupported_ocr_language', 'job: xx'),
    ('error', 'unsupported_ocr_language', 'a.pdf: ja')) t(level, code, message)""")
def validation_findings(spark, sf_dir):
    """What the checks of a faulty job specification find."""
    spec = specs.JobSpec(
        inputs=["a.pdf"], overrides={"b.pdf": {}, "a.pdf": {"profile": "quality", "ocr_languages": ["en", "ja"]}}, ocr_languages=["xx"],
        taxonomy=specs.Taxonomy("t", [specs.Category("a", "x" * 40_000), specs.Category("b")], reads=("busines",)),
        question_sets=[specs.QuestionSet("risk", "1", [specs.Question("risk", "noul", "Is there risk?"), specs.Question("q", "choice", "Pick from the document.", [specs.Category(f"o{i}") for i in range(300)])])],
    )
    return spark.createDataFrame([(f.level, f.code, f.message) for f in specs.validate(spec)], "level string, code string, message string")


@query(f"with {_PLAN_SQL}, texts as (select doc_id, text from filings), {_choice_sql(X.CHOICE, 'texts')}, per as (select doc_id, count(*) as n from pointers group by doc_id) select doc_id, 'ok' as status, value as category, round(confidence, 6) as confidence, n as n_sections, length(text)::bigint as n_chars from chosen join per using (doc_id)")
def document_records(spark, sf_dir):
    """Filings to sections, an answer and a record: all in one pass, without a shuffle."""
    d = _detected(spark, sf_dir).select("doc_id", "text", "sections", judge.keyword_choice(F.col("text"), X.CHOICE).alias("a"))
    return d.select("doc_id", F.lit("ok").alias("status"), F.col("a.value").alias("category"), F.round("a.confidence", 6).alias("confidence"), F.size("sections").cast("long").alias("n_sections"), F.length("text").cast("long").alias("n_chars"))


_REC = f"with {X.SQL_RECORDS} select seq, doc_id, status, category from records where "


@query(_REC + "status = 'partial'")
def records_by_status(spark, sf_dir):
    return records.find_documents(X.records(spark, sf_dir), status="partial").select("seq", "doc_id", "status", "category")


@query(_REC + "confidence >= 0.25 and confidence <= 0.5")
def records_by_confidence(spark, sf_dir):
    return records.find_documents(X.records(spark, sf_dir), least=0.25, most=0.5).select("seq", "doc_id", "status", "category")


@query(_REC + "status = 'ok' and escalation_status = 'queued' and category = 'c2' and confidence >= 0.1 and doc_id % 4 = 0")
def records_by_all(spark, sf_dir):
    answers = X.documents(spark, sf_dir).select("doc_id", F.lit("risk").alias("name"), F.when(F.col("doc_id") % 4 == 0, "yes").otherwise("no").alias("value"))
    found = records.find_documents(X.records(spark, sf_dir), status="ok", escalation="queued", category="c2", least=0.1, answer=("risk", "yes"), answers=answers)
    return found.select("seq", "doc_id", "status", "category")


@query(_REC + "seq > 100 order by seq limit 50")
def records_page(spark, sf_dir):
    """A page of the API: 50 records after a cursor."""
    return records.find_documents(X.records(spark, sf_dir), after=100, limit=50).select("seq", "doc_id", "status", "category")


@query(f"with {X.SQL_RECORDS} select seq, doc_id, status, category, confidence, escalation_status from records")
def records_without_text(spark, sf_dir):
    return records.without_text(X.records(spark, sf_dir))


@query(f"with {X.SQL_RECORDS} select doc_id, case when doc_id % 2 = 0 then 'retried' else status end as status, case when doc_id % 2 = 0 then 'c9' else category end as category from records")
def records_upsert(spark, sf_dir):
    base = X.records(spark, sf_dir).select("doc_id", F.lit(1).alias("version"), "status", "category")
    again = base.where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("version"), F.lit("retried").alias("status"), F.lit("c9").alias("category"))
    return records.latest_records(base.union(again)).select("doc_id", "status", "category")


@query("select doc_id, 'topic' as name, 'v' || (doc_id % 3) as value from documents where doc_id % 5 <> 0")
def record_answer_values(spark, sf_dir):
    a = F.create_map(F.lit("topic"), F.struct(F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.when(F.col("doc_id") % 5 == 0, "missing section: mdna").alias("skipped")))
    return records.answer_values(X.documents(spark, sf_dir).select("doc_id", a.alias("answers")))


_JOBS_SQL = """jobs as (select event_id as seq, case when event_id % 9 = 0 then 'ingest' else 'run' end as kind, case event_type when 'signup' then 'queued' when 'purchase' then 'done' when 'error' then 'failed' else 'classifying' end as state,
    ts as finished_at, event_id % 8 = 0 as pruned, event_id % 5 as queue, event_id % 7 = 0 as priority from events)"""


def _jobs(spark, sf_dir) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("classifying")
    kind = F.when(F.col("event_id") % 9 == 0, "ingest").otherwise("run")
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), state.alias("state"), F.col("ts").alias("finished_at"), (F.col("event_id") % 8 == 0).alias("pruned"), (F.col("event_id") % 5).alias("queue"), (F.col("event_id") % 7 == 0).alias("priority"))


@query(f"with {_JOBS_SQL}, t as (select max(ts) as now from events) select seq, kind, state from jobs, t where state in ('done', 'failed', 'cancelled') and not pruned and finished_at <= now - interval 5 days and kind = 'run'")
def prune_retention(spark, sf_dir):
    now = F.lit(X.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])
    return records.retention(_jobs(spark, sf_dir), now, 5, "run").select("seq", "kind", "state")


@query(f"with {_JOBS_SQL} select seq, kind, state from jobs where kind <> 'ingest'")
def job_list(spark, sf_dir):
    return records.list_jobs(_jobs(spark, sf_dir)).select("seq", "kind", "state")


@query(f"with {_JOBS_SQL} select seq, kind from jobs where state = 'queued' order by seq limit 1")
def job_fifo(spark, sf_dir):
    return records.next_job(_jobs(spark, sf_dir)).select("seq", "kind")


@query(f"with {_JOBS_SQL} select queue, seq, row_number() over (partition by queue order by priority desc, seq) as position from jobs")
def priority_order(spark, sf_dir):
    return records.priority_order(_jobs(spark, sf_dir)).select("queue", "seq", F.col("position").cast("long").alias("position"))


@query("select user_id % 50 as k, max(event_id) as last_used from events group by 1 having max(event_id) >= 20")
def cache_put_and_prune(spark, sf_dir):
    """Cache rows appended and compacted by key, then those used before a time dropped."""
    rows = X.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("cache_key"), F.lit("x").alias("value"), F.col("event_id").alias("last_used"))
    old, new = rows.where("last_used % 2 = 0"), rows.where("last_used % 2 = 1")
    return judge.cache_prune(judge.cache_put(old, new), F.lit(20)).select(F.col("cache_key").alias("k"), "last_used")


@query("with a as (select doc_id, doc_id // 3 as request_id, length(text) as input_tokens, doc_id % 4 = 0 as cached, lang from documents) select lang, count(distinct request_id) as requests, sum(input_tokens)::bigint as input_tokens, count(*) filter (where cached) as cache_hits from a group by lang")
def usage_totals(spark, sf_dir):
    a = X.documents(spark, sf_dir).select("lang", F.floor(F.col("doc_id") / 3).alias("request_id"), F.length("text").cast("long").alias("input_tokens"), (F.col("doc_id") % 4 == 0).alias("cached"))
    return records.usage_totals(a, "lang")


@query("select doc_id, round(case when doc_id % 4 = 0 then 0.0 else length(text) * 0.042 / 1e6 end, 9)::double as usd from documents")
def judgment_price(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.round(records.price(F.length("text"), cached=F.col("doc_id") % 4 == 0), 9).alias("usd"))


@query("select status_code::bigint as status_code, case when status_code in (429, 529) then 'throttled' when status_code = 422 then 'rejected' when status_code = 400 then 'too_big' when status_code >= 500 then 'unavailable' when status_code = 0 then 'transient' else 'ok' end as outcome, count(*) as n from (select [200, 429, 529, 422, 400, 503, 0][event_id % 7 + 1] as status_code from events) group by 1, 2")
def classifier_errors(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, (200, 429, 529, 422, 400, 503, 0))), (F.col("event_id") % 7 + 1).cast("int"))
    return X.table(spark, sf_dir, "events").select(status.cast("long").alias("status_code")).groupBy("status_code", judge.outcome(F.col("status_code"), F.lit("max_tokens_exceeded")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""with {X.SQL_RECORDS}, a as (select doc_id, 'topic' as name, confidence from records where confidence is not null),
    f as (select *, row_number() over (order by doc_id) as k from a where confidence < 0.4)
    select doc_id, name, confidence, case when k <= ceil(0.02 * (select count(distinct doc_id) from a)) then 'queued' else 'capped' end as status from f""")
def escalation_flags_capped(spark, sf_dir):
    a = X.records(spark, sf_dir).where("confidence is not null").select("doc_id", F.lit("topic").alias("name"), "confidence", F.lit(0.4).alias("escalate_below"))
    return judge.escalation(a)


# ---- runtime ----------------------------------------------------------------------------------------------


def _requests(spark, sf_dir) -> DataFrame:
    t0 = X.table(spark, sf_dir, "events").agg(F.min("ts")).first()[0]
    at = F.col("ts").cast("timestamp").cast("double") - F.lit(t0).cast("timestamp").cast("double")
    return X.job_log(spark, sf_dir).select(
        (F.col("key") % 8).alias("key"), "seq", at.alias("at"), F.col("tokens").cast("double").alias("tokens"), F.when(F.col("outcome") == "done", F.col("tokens") * 0.9).alias("actual"),
        (F.col("seconds") / 10).alias("seconds"), (F.col("seq") % 50 == 0).cast("int").alias("throttled"), (F.col("seq") % 70 == 0).cast("int").alias("transient"),
        F.when(F.col("seq") % 100 == 0, 3.0).alias("retry_after"), (F.col("seq") % 9 == 0).alias("priority"),
    )


@query()
def token_bucket_schedule(spark, sf_dir):
    got = runtime.schedule(_requests(spark, sf_dir), 2000.0, 10.0)
    return got.select("key", "seq", F.round("started", 6).alias("started"), F.round("done", 6).alias("done"), F.col("attempts").cast("long").alias("attempts"))


@query()
def aimd_factor(spark, sf_dir):
    return runtime.schedule(_requests(spark, sf_dir), 2000.0, 10.0).groupBy("key").agg(F.min("factor").alias("least"), F.max("factor").alias("most"))


@query("""
    with recursive e as (select user_id % 16 as resource, event_id as seq, event_id * 4.0 as t, user_id % 5 as actor, ['acquire', 'heartbeat', 'release'][event_id % 3 + 1] as action,
        row_number() over (partition by user_id % 16 order by event_id) as k from events),
    s as (select resource, 0::bigint as k, null::bigint as seq, false as granted, null::bigint as holder, null::double as beat from (select distinct resource from e)
        union all
        select resource, k, seq, granted, case when not granted then holder when action = 'release' then null else actor end, case when granted and action <> 'release' then t else beat end
        from (select e.resource, e.k, e.seq, e.t, e.actor, e.action, s.holder, s.beat,
            case when e.action = 'acquire' then s.holder is null or e.t - s.beat > 30 or s.holder = e.actor
                when e.action = 'heartbeat' then coalesce(s.holder = e.actor and e.t - s.beat <= 30, false) else coalesce(s.holder = e.actor, false) end as granted
            from s join e on e.resource = s.resource and e.k = s.k + 1))
    select resource, seq, granted, holder from s where k > 0""")
def lease_timeline(spark, sf_dir):
    action = F.element_at(F.array(F.lit("acquire"), F.lit("heartbeat"), F.lit("release")), (F.col("seq") % 3 + 1).cast("int"))
    e = X.job_log(spark, sf_dir).select((F.col("key") % 16).alias("resource"), "seq", (F.col("seq") * 4).cast("double").alias("at"), (F.col("key") % 5).alias("actor"), action.alias("action"))
    return runtime.leases(e)


@query(f"with {X.SQL_LOG}, g as (select key, ts, epoch(ts) - lag(epoch(ts)) over (partition by key order by ts, seq) as gap_s from log where outcome = 'done') select key, ts, round(gap_s, 3)::double as gap_s from g where gap_s >= 900")
def stall_gaps(spark, sf_dir):
    return runtime.stalls(X.job_log(spark, sf_dir).where("outcome = 'done'")).withColumn("gap_s", F.round("gap_s", 3))


@query(f"with {X.SQL_LOG}, w as (select key, seq, count(*) over r as n, sum(crashed::int) over r as c from log window r as (partition by key order by seq rows unbounded preceding)) select key, seq, round(c / n, 6) as rate, max(case when 20 * c >= n then 1 else 0 end) over (partition by key order by seq rows unbounded preceding) = 1 as cancel from w")
def crash_rate_running(spark, sf_dir):
    return runtime.crash_rate(X.job_log(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"with {X.SQL_LOG} select time_bucket(interval 5 minutes, ts) as start, outcome, count(*) as n, sum(tokens)::bigint as tokens from log group by 1, 2")
def throughput_tumbling(spark, sf_dir):
    return runtime.throughput(X.job_log(spark, sf_dir))


@query(f"with {X.SQL_LOG}, w as (select unnest([time_bucket(interval 1 minute, ts) - k * interval 1 minute for k in range(5)]) as start, outcome, tokens from log) select start, outcome, count(*) as n, sum(tokens)::bigint as tokens from w group by 1, 2")
def throughput_sliding(spark, sf_dir):
    return runtime.throughput(X.job_log(spark, sf_dir), "5 minutes", "1 minute")


@query(f"""with {X.SQL_LOG}, g as (select key, ts, case when ts - lag(ts) over (partition by key order by ts) < interval 30 minutes then 0 else 1 end as fresh from log),
    s as (select *, sum(fresh) over (partition by key order by ts rows unbounded preceding) as k from g)
    select key, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by key, k""")
def activity_sessions(spark, sf_dir):
    return runtime.activity_sessions(X.job_log(spark, sf_dir))


@query(ORACLE_SQL["throughput_tumbling"])
def throughput_streamed(spark, sf_dir):
    """The same windows from a stream of the events, run to its end."""
    schema = X.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may also be one file
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running")
    log = stream.select(F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"), (F.col("event_id") % 1000).alias("tokens"))
    folder = runtime.shared_folder(spark)
    runtime.drain(log, "ts", f"{folder}/log")
    closed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/log")
    return runtime.replay(runtime.throughput(closed, late="1 hour"), folder).where("outcome is not null").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- metrics ----------------------------------------------------------------------------------------------


@query(f"with {X.SQL_LOG} select outcome, count(*) as n, sum(tokens)::bigint as tokens, quantile_cont(seconds, 0.5) as p50_s, quantile_cont(seconds, 0.95) as p95_s from log group by rollup (outcome)")
def job_summary(spark, sf_dir):
    return metrics.job_summary(X.job_log(spark, sf_dir))


@query(f"""with {X.SQL_LOG}, r as (select *, row_number() over (partition by reason order by doc_id, seq) as k from log where reason is not null)
    select reason, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) filter (where k <= 3) as examples from r group by reason""")
def failures_by_reason(spark, sf_dir):
    f = metrics.failures_by_reason(X.job_log(spark, sf_dir).where("reason is not null"))
    return f.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(f"""with {X.SQL_GOLD}, c as (select distinct truth as c from gold),
    f as (select c, (select count(*) from gold where truth = c) as t, (select count(*) from gold where predicted = c) as p, (select count(*) from gold where truth = c and predicted = c) as h from c)
    select round(sum(h) / sum(t), 6) as accuracy, round(avg(2 * h / (t + p)), 6) as macro_f1 from f""")
def eval_accuracy_f1(spark, sf_dir):
    return metrics.accuracy_f1(X.gold(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""with {X.SQL_GOLD}, r as (select (truth = predicted)::int as hit, confidence, least(floor(confidence * 10), 9) as bin from gold), b as (select bin, count(*) as n, avg(hit) as acc, avg(confidence) as conf, sum((confidence - hit) ** 2) as sq from r group by bin)
    select round(sum(sq) / sum(n), 6) as brier, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from b""")
def eval_brier_ece(spark, sf_dir):
    return metrics.brier_ece(X.gold(spark, sf_dir)).select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


_LEVELS = f"{X.SQL_GOLD}, l as (select floor(confidence * 100)::bigint as level, count(*) as n, sum((truth = predicted)::int) as hit from gold group by 1), c as (select level, sum(n) over (order by level desc) as m, sum(hit) over (order by level desc) as h, sum(n) over () as a from l)"


@query(f"with {_LEVELS} select level, round(m / a, 6) as coverage, round(h / m, 6) as accuracy from c")
def accuracy_vs_coverage(spark, sf_dir):
    return metrics.accuracy_vs_coverage(X.gold(spark, sf_dir)).select(F.col("level").cast("long").alias("level"), F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query(f"with {_LEVELS} select min(case when h / m >= 0.97 and a >= 50 then level end) / 100.0::double as threshold from c")
def calibrate_threshold(spark, sf_dir):
    return metrics.calibrate(X.gold(spark, sf_dir).withColumn("weight", F.lit(1.0)), 0.97)


@query()
def char_error_rate(spark, sf_dir):
    """Whole texts of all documents against what a bad scan might give. SQL's edit distance is too slow on whole texts."""
    docs = X.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("truth"))
    got = F.regexp_replace(F.translate("truth", "lO", "10"), "rn", "m")
    return docs.select("doc_id", F.round(T.text_error_rate(got, F.col("truth")), 6).alias("cer"))


@query("select doc_id, round(length(text) / ((length(text) + 3) // 4), 2) as chars_per_token from documents where length(text) > 0")
def observed_chars_per_token(spark, sf_dir):
    n = F.length("text")
    return X.documents(spark, sf_dir).where(n > 0).select("doc_id", T.chars_per_token(n, F.floor((n + 3) / 4)).alias("chars_per_token"))


@query("select event_id, (event_id % 50) * case event_id % 5 when 0 then 1 when 1 then 60 when 2 then 3600 when 3 then 86400 else 604800 end as seconds from events")
def durations(spark, sf_dir):
    text = F.concat((F.col("event_id") % 50).cast("string"), F.element_at(F.array(*map(F.lit, "smhdw")), (F.col("event_id") % 5 + 1).cast("int")))
    return X.table(spark, sf_dir, "events").select("event_id", T.duration_seconds(text).alias("seconds"))


@query(f"""with {X.SQL_ITEMS}, t as (select doc_id, ref, start, "end" from longest where k = 1 and doc_id % 3 <> 0),
    f as (select doc_id, ref, start + (doc_id % 2) * 5000 as start, "end" from longest where k = 1 and doc_id % 5 <> 0),
    j as (select coalesce(t.ref, f.ref) as key, t.start is not null as has_t, f.start is not null as has_f, abs(f.start - t.start) <= 0.1 * (t."end" - t.start) as near from t full join f on t.doc_id = f.doc_id and t.ref = f.ref)
    select key, round(count(*) filter (where has_t and has_f) / count(*) filter (where has_f), 6) as precision, round(count(*) filter (where has_t and has_f) / count(*) filter (where has_t), 6) as recall, round(count(*) filter (where has_t and has_f and near) / count(*) filter (where has_t and has_f), 6) as agreed from j group by key""")
def section_detection_metrics(spark, sf_dir):
    s = _flat(_items(spark, sf_dir).withColumn("sections", sections.longest_per_ref(F.col("sections")))).select("doc_id", F.element_at(F.split("form_ref", " "), -1).alias("key"), "start", "end")
    found = s.where("doc_id % 5 <> 0").withColumn("start", F.col("start") + F.col("doc_id") % 2 * 5000)
    m = metrics.section_metrics(found, s.where("doc_id % 3 <> 0"))
    return m.select("key", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "agreed")])


from . import catalogue_jobs  # noqa: E402,F401  registers its queries in the tables above
