"""Schemas and constants of the document record. Offsets count code points and spans are half-open."""

from __future__ import annotations

from pyspark.sql.types import StructType

from .fixed import KEYS  # noqa: F401

SCHEMA_VERSION = "0.1.0"
PAGE_JOIN = "\n\n"
OTHER, POINTER = "other", "pointer"
STATES = ("queued", "extracting", "extracted", "classifying", "done", "failed", "cancelled")
TERMINAL = ("done", "failed", "cancelled")

SPAN = "struct<start:int,end:int>"
PAGE = "struct<number:int,start:int,end:int>"
SECTION = f"struct<keys:array<string>,label:string,form_ref:string,spans:array<{SPAN}>,method:string,confidence:double,flags:array<string>,est_tokens:int>"
DECISION = "struct<ocr:boolean,step:int,reason:string,chars:int,bad_char_ratio:double,image_coverage:double,path_count:int>"
COVERAGE = f"struct<sections:array<string>,spans:array<{SPAN}>,page_ranges:array<struct<lo:int,hi:int>>,truncated:boolean,shrunk:boolean,est_tokens:int,input_tokens:int,note:string>"
JUDGMENT = f"struct<kind:string,value_str:string,value_num:double,probabilities:map<string,double>,confidence:double,classifier_id:string,coverage:{COVERAGE},skipped:string>"
RECORD = (
    "schema_version string, record_id string, job_id string, status string, "
    "errors array<struct<stage:string,code:string,message:string,page:int>>, attempts int, "
    "source struct<filename:string,format:string,sha256:string,bytes:bigint,group:string>, "
    "metadata map<string,struct<value:string,source:string>>, extraction_profile string, text string, "
    f"pages array<{PAGE}>, sections array<{SECTION}>, taxonomy struct<name:string,hash:string>, "
    f"classification {JUDGMENT}, answers map<string,{JUDGMENT}>, "
    "usage struct<requests:int,input_tokens:bigint,output_tokens:bigint,ocr_pages:int,cache_hits:int>"
)


def record_json_schema() -> dict:
    """The record's schema as JSON."""
    return StructType.fromDDL(RECORD).jsonValue()
