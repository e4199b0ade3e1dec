"""Command line: ``python -m paperloom.cli run|validate|clear-cache|doctor``, a thin layer over the library."""

from __future__ import annotations

import argparse
import importlib.util
import sys

from .fixed import LANGUAGES

VERSION = "0.1.0"


def doctor() -> list[tuple[str, str, str]]:
    """(part, status, note); only a missing core part is an error."""
    rows = []
    for name, core in (("pyspark", True), ("pyarrow", True), ("pandas", True), ("yaml", False), ("pypdfium2", False)):
        there = importlib.util.find_spec(name) is not None
        rows.append((name, "ok" if there else "missing", "" if there else "core" if core else "optional"))
    return [*rows, ("languages", "ok", str(len(LANGUAGES)))]


def report(rows: list[tuple[str, str, str]]) -> str:
    wide = [max(len(r[i]) for r in rows) for i in range(2)]
    return "\n".join(f"{a.ljust(wide[0])}  {b.ljust(wide[1])}  {c}".rstrip() for a, b, c in rows)


def run(args: argparse.Namespace) -> int:
    """HTML or text files through sections, planning and judging to records as JSON lines; 1 if any record is not ok.

    Answers come from the local keyword classifier. With --cache answers are looked up there first and added after.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    from .operators.records import export_json
    from .operators.sections import detect_sections
    from .plans import judging
    from .session import local_session
    from .sources.files import scan_files, source_struct, title_or_stem
    from .sources.html import html_text, html_title
    from .specs import JobSpec, asks, load_taxonomy

    spark = local_session()
    job = JobSpec([args.input], load_taxonomy(args.taxonomy), question_sets=list(args.questions))
    if code := _report_findings(job):
        return code
    todo = asks(job)
    words = {a.name: {n: [w for w in (d or n).lower().split() if len(w) > 3] if n != "other" else [] for n, d in a.options} or {"yes": ["yes"], "no": ["no"]} for a in todo}
    files = scan_files(spark, args.input, args.glob).withColumn("source", source_struct(F.col("path"), F.col("content")))
    raw = F.decode("content", "UTF-8")
    is_html = F.col("source.format") == "html"
    docs = files.select(F.xxhash64("path").alias("doc_id"), "source", F.when(is_html, html_text(raw)).otherwise(raw).alias("text"), title_or_stem(F.when(is_html, html_title(raw)), F.col("path")).alias("title"))
    none = F.expr("cast(array() as array<struct<number:int,start:int,end:int>>)")
    docs = docs.withColumn("pages", none).withColumn("sections", detect_sections(F.col("text"), F.lit(None).cast("string")))
    cache = None
    if args.cache:
        try:
            cache = spark.read.parquet(args.cache)
        except AnalysisException:  # none yet
            cache = spark.createDataFrame([], "cache_key string, answer string")
    answers = judging.judge_documents(docs, todo, judging.Keywords(words), cache=cache)
    records = judging.records(answers).join(docs.select("doc_id", "source", "text", "sections"), "doc_id")
    export_json(records, args.out, not args.without_text)
    if args.cache:
        judging.new_cache_rows(answers).write.mode("append").parquet(args.cache)
    return int(spark.read.json(args.out).where("status <> 'ok'").limit(1).count() > 0)


def _report_findings(job) -> int:
    """Prints the findings of a job; 2 if one is an error."""
    from .specs import validate

    found = validate(job)
    for f in found:
        print(f"{f.level}: {f.code}: {f.message}", file=sys.stderr)
    return 2 if any(f.level == "error" for f in found) else 0


def check(args: argparse.Namespace) -> int:
    from .specs import JobSpec, load_taxonomy

    return _report_findings(JobSpec(list(args.inputs), load_taxonomy(args.taxonomy) if args.taxonomy else None, question_sets=list(args.questions), ocr_languages=args.languages.split(","), profile=args.profile))


def clear_cache(args: argparse.Namespace) -> int:
    """Drops a cache's answers; its schema stays."""
    from .session import local_session

    spark = local_session()
    spark.createDataFrame([], spark.read.parquet(args.cache).schema).write.mode("overwrite").parquet(args.cache)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paperloom")
    parser.add_argument("--version", action="version", version=VERSION)
    sub = parser.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help=run.__doc__)
    for name in ("input", "out"):
        r.add_argument(name)
    r.add_argument("--taxonomy", required=True)
    r.add_argument("--questions", action="append", default=[])
    r.add_argument("--glob", default="*.html")
    r.add_argument("--cache")
    r.add_argument("--without-text", action="store_true")
    v = sub.add_parser("validate", help="the findings about a job; 2 if one is an error")
    v.add_argument("inputs", nargs="+")
    v.add_argument("--taxonomy")
    v.add_argument("--questions", action="append", default=[])
    v.add_argument("--languages", default="en")
    v.add_argument("--profile", default="fast")
    c = sub.add_parser("clear-cache", help="drops all answers of a cache")
    c.add_argument("cache")
    sub.add_parser("doctor", help="which parts are there")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        rows = doctor()
        print(report(rows))
        return int(any(r[1:] == ("missing", "core") for r in rows))
    return {"run": run, "validate": check, "clear-cache": clear_cache}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
