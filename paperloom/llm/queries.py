"""The query of every corpus operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality_classifier, quality_rules, vocabulary
from .common import table
from .exact_dedup import dedup_report
from .license_scan import license_scan
from .line_dedup import line_report
from .sentencepiece_lattice import sampled_encodings
from .simhash import near_duplicates
from .source_mixing import mixing_report
from .token_counts import token_counts
from .url_filter import url_verdicts


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary.load())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_encodings(table(spark, sf_dir, "documents"), vocabulary.load())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_source_mixing": op6_source_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINES = "string_split(coalesce(text, ''), chr(10))"
ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": f"""
        with l as (select doc_id, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as pos from documents),
        k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        d as (select key, max(doc_id) as last_id from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
        select k.doc_id, count(*) as n_lines, count(*) filter (where d.key is not null and k.doc_id <> d.last_id) as n_dropped,
            sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where d.key is null or k.doc_id = d.last_id), '')) as kept_sha256
        from k left join d on k.key = d.key group by k.doc_id""",
    "op10_exact_dedup": f"""
        with n as (select doc_id, {_AZ} as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
        select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.t) as text_sha256
        from n join g using (t)""",
}
