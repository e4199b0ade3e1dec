"""Inputs derived from the test tables, the same in Spark and in SQL. Each is a narrow transformation of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.planner import Ask

HEADS = {
    "10-K": ("Item 1. Business", "Item 1A. Risk Factors", "Item 7. Discussion"),
    "10-Q": ("PART I\nItem 2. Discussion", "PART II\nItem 1A. Risk Factors", "Item 6. Exhibits"),
    "20-F": ("Item 3. Key Information", "D. Risk Factors", "Item 4. Company"),
    "8-K": ("Item 2.02. Results", "Item 8.01. Other", "Item 9.01. Exhibits"),
}
REFERENCE = "The information is incorporated by reference to Exhibit 13.1 of this filing."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _assembled(headed: str, cover: str) -> str:
    return f"concat({cover}, 'Contents\\n', {headed.format(1)}, '\\n', {headed.format(2)}, '\\n', {headed.format(3)}, '\\n', {headed.format(1)}, '\\n', b1, '\\n', {headed.format(2)}, '\\n', b2, '\\n', {headed.format(3)}, '\\n', b3)"


def _bodies(docs: DataFrame) -> DataFrame:
    n = F.floor(F.length("text") / 3).cast("int")
    two = F.when(F.col("doc_id") % 7 == 0, REFERENCE).otherwise(F.substring(F.col("text"), n + 1, n))
    return docs.select("doc_id", F.substring(F.col("text"), F.lit(1), n).alias("b1"), two.alias("b2"), F.substring(F.col("text"), 2 * n + 1, F.length("text")).alias("b3"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, form, text: a cover, a table of contents, and three items (some of which only point elsewhere)."""
    form = F.element_at(F.array(*[F.lit(f) for f in HEADS]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _bodies(documents(spark, sf_dir)).withColumn("form", form)
    for k in range(3):
        rows = rows.withColumn(f"h{k + 1}", F.element_at(F.create_map(*[F.lit(x) for f, h in HEADS.items() for x in (f, h[k])]), F.col("form")))
    return rows.select("doc_id", "form", F.expr(_assembled("h{}", "'FORM ', form, '\\n'")).alias("text"))


def annual_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the same under headings in words."""
    rows = _bodies(documents(spark, sf_dir))
    for k, head in enumerate(("1. Strategic report", "Principal risks and uncertainties", "Financial Review .... 12")):
        rows = rows.withColumn(f"h{k + 1}", F.lit(head))
    return rows.select("doc_id", F.expr(_assembled("h{}", "''")).alias("text"))


_SQL_BODIES = f"""
    bodies as (select doc_id, substring(text, 1, length(text) // 3) as b1,
        case when doc_id % 7 = 0 then '{REFERENCE}' else substring(text, length(text) // 3 + 1, length(text) // 3) end as b2,
        substring(text, 2 * (length(text) // 3) + 1) as b3 from documents)"""


def _sql_text(cover: str) -> str:
    return cover + " || 'Contents' || chr(10) || h1 || chr(10) || h2 || chr(10) || h3 || chr(10) || h1 || chr(10) || b1 || chr(10) || h2 || chr(10) || b2 || chr(10) || h3 || chr(10) || b3"


_heads_sql = ", ".join(f"('{f}', {', '.join(chr(39) + h.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + chr(39) for h in hs)})" for f, hs in HEADS.items())
SQL_FILINGS = f"""{_SQL_BODIES},
    heads as (select * from (values {_heads_sql}) t(form, h1, h2, h3)),
    filings as (select doc_id, h.form, {_sql_text("'FORM ' || h.form || chr(10)")} as text
        from bodies join heads h on h.form = ['10-K', '10-Q', '20-F', '8-K'][doc_id % 4 + 1])"""
SQL_REPORTS = f"""{_SQL_BODIES},
    reports as (select doc_id, {_sql_text("''")} as text from
        (select *, '1. Strategic report' as h1, 'Principal risks and uncertainties' as h2, 'Financial Review .... 12' as h3 from bodies))"""
#: Lines of any table (doc_id, text) with their offsets.
SQL_LINES = """
    cut as (select doc_id, text, string_split(text, chr(10)) as ls from {0}),
    rows_ as (select doc_id, text, unnest(ls) as line, generate_subscripts(ls, 1) as i from cut),
    lines as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos from rows_)"""
#: Item marks of the filings, then sections (from every heading to the next mark), as the fixture's headings allow.
SQL_ITEMS = f"""{SQL_FILINGS},
    {SQL_LINES.format("(select doc_id, text from filings)")},
    parsed as (select l.*, f.form, nullif(regexp_extract(line, '^PART (IV|I{{1,3}}|V)$', 1), '') as part,
        nullif(case when f.form = '8-K' then regexp_extract(line, '^Item (\\d\\.\\d\\d)\\.', 1) else regexp_extract(line, '^Item (\\d{{1,2}}[A-K]?)\\. ', 1) end, '') as item
        from lines l join filings f using (doc_id)),
    carried as (select *, last_value(part ignore nulls) over w as in_part, last_value(item ignore nulls) over w as in_item
        from parsed window w as (partition by doc_id order by i rows between unbounded preceding and current row)),
    marks as (select *, case when item is not null and form = '10-Q' then coalesce(in_part || '.', '') || item when item is not null then item
        when form = '20-F' and in_item = '3' and line like 'D. Risk Factors%' and part is null then '3.D' end as ref from carried),
    spans as (select *, lead(pos, 1, length(text)) over (partition by doc_id order by i) as nxt from marks where part is not null or ref is not null),
    sections as (select doc_id, form, form || ' ' || ref as form_ref, ref, line as label, pos as start,
        pos + length(regexp_replace(substring(text, pos + 1, nxt - pos), '\\s+$', '')) as "end", i, text from spans where ref is not null),
    longest as (select *, row_number() over (partition by doc_id, form_ref order by "end" - start desc, start) as k from sections)"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number, text: the lines of each document as its pages."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("number"), "text")


SQL_PAGES = """
    pages_ as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as number from documents),
    offsets as (select doc_id, number, length(text) as n, coalesce(sum(length(text) + 2) over (partition by doc_id order by number rows between unbounded preceding and 1 preceding), 0)::bigint as start from pages_)"""


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number, text, image_coverage, path_count: every line as a page; some with bad characters before it."""
    bad = F.concat(F.repeat(F.lit("�"), F.floor(F.length("text") / 10).cast("int") + 5), "text")
    signal = F.col("doc_id") + F.col("number")
    rows = doc_pages(spark, sf_dir)
    return rows.select("doc_id", "number", F.when(signal % 13 == 0, bad).otherwise(F.col("text")).alias("text"), (signal % 11 / 10.0).alias("image_coverage"), (signal % 40).cast("int").alias("path_count"))


SQL_SIGNALS = SQL_PAGES + """,
    signals as (select doc_id, number, case when (doc_id + number) % 13 = 0 then repeat('�', length(text) // 10 + 5) || text else text end as text,
        ((doc_id + number) % 11) / 10.0 as image_coverage, (doc_id + number) % 40 as path_count from pages_),
    counted as (select *, length(regexp_replace(text, '\\s+', '', 'g')) as chars, length(text) - length(replace(text, '�', '')) as bad from signals),
    decided as (select doc_id, number, chars, case when chars > 0 then bad / chars else 0.0 end as ratio,
        case when chars < 80 then 1 when bad / chars >= 0.05 then 2 else 4 end as step,
        case when chars < 80 then image_coverage >= 0.6 or path_count >= 20 else bad / chars >= 0.05 end as ocr,
        case when chars < 80 and image_coverage >= 0.6 then 'few characters, images cover most of the page' when chars < 80 and path_count >= 20 then 'few characters, many vector paths'
            when chars < 80 then 'few characters, nothing to read' when bad / chars >= 0.05 then 'text layer has many bad characters' else 'text layer looks good' end as reason from counted)"""


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, key, outcome, reason, doc_id, tokens, seconds of judgments, from the events."""
    reason = F.when(F.col("event_type") == "error", F.concat(F.lit("reason "), (F.col("event_id") % 3).cast("string")))
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), outcome.alias("outcome"), reason.alias("reason"), (F.col("event_id") % 97).alias("doc_id"),
        (F.col("event_id") % 1000).alias("tokens"), (F.col("event_id") % 60).cast("double").alias("seconds"), (F.col("event_type") == "error").alias("crashed"),
    )


SQL_LOG = """
    log as (select event_id as seq, ts, user_id as key, case event_type when 'error' then 'failed' when 'purchase' then 'done' else 'running' end as outcome,
        case when event_type = 'error' then 'reason ' || (event_id % 3) end as reason, event_id % 97 as doc_id, event_id % 1000 as tokens,
        (event_id % 60)::double as seconds, event_type = 'error' as crashed from events)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, predicted, confidence: labels beside a simple guess by the share of symbols."""
    joined = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    share = (F.length("text") - F.length(F.translate("text", "!%*#$&|", ""))) / F.greatest(F.length("text"), F.lit(1))
    return joined.select("doc_id", F.col("quality").cast("long").alias("truth"), (share < 0.02).cast("long").alias("predicted"), (1 - F.least(share, F.lit(0.5))).alias("confidence"))


SQL_GOLD = """
    shares as (select doc_id, quality::bigint as truth, (length(text) - length(translate(text, '!%*#$&|', ''))) / greatest(length(text), 1) as share from documents join labels using (doc_id)),
    gold as (select doc_id, truth, (share < 0.02)::bigint as predicted, 1 - least(share, 0.5) as confidence from shares)"""

ASKS = [
    Ask("risk", "noul", "Does the document name risks?", reads=("risk_factors",)),
    Ask("outlook", "score", "How good is the document's outlook?", (("poor", None), ("fair", None), ("good", "clearly good")), reads=("mdna", "risk_factors"), fallback=True),
    Ask("topic", "choice", "Which topic does the document have?", (("legal", "courts and claims"), ("finance", None))),
]
CHOICE = {"legal": ["in", "de"], "finance": ["on", "que"], "other": []}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, doc_id, status, category, confidence, escalation_status, text of a small store."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("seq"), "doc_id", F.when(F.col("doc_id") % 17 == 0, "failed").when(F.col("doc_id") % 11 == 0, "partial").otherwise("ok").alias("status"),
        F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")).alias("category"), F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 100) / 100.0).alias("confidence"),
        F.when(F.col("doc_id") % 6 == 0, "queued").alias("escalation_status"), "text",
    )


SQL_RECORDS = """
    records as (select doc_id as seq, doc_id, case when doc_id % 17 = 0 then 'failed' when doc_id % 11 = 0 then 'partial' else 'ok' end as status, 'c' || (doc_id % 5) as category,
        case when doc_id % 9 <> 0 then (doc_id % 100) / 100.0 end as confidence, case when doc_id % 6 = 0 then 'queued' end as escalation_status, text from documents)"""
