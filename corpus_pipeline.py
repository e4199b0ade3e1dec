"""The training corpus pipeline: each stage reads what its predecessor kept.

Defined cases, in every stage: a null text counts as empty; empty texts are scored, compared and encoded like any
others; texts of any length are read whole. Repeated rows stay alike until exact dedup, which leaves one of each. A null
doc_id is a document of its own that is smaller than any other. Extra columns are carried by all stages but the last,
whatever their names. An empty table goes through as an empty table. Where no labelled rows are left, the quality stage
accepts all and the mixing stage counts all as clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import quality_classifier, vocabulary
from paperloom.llm.common import stored, table
from paperloom.llm.exact_dedup import exact_dedup
from paperloom.llm.sentencepiece_lattice import sampled_encodings
from paperloom.llm.simhash import near_dedup
from paperloom.llm.source_mixing import mix_sources


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_quality(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest doc_id."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that bring the domains to their target weights; rates above 1 give several copies."""
    return mix_sources(docs, table(spark, sf_dir, "labels"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with piece ids."""
    return sampled_encodings(docs, vocabulary.load(), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs


#: Trained classifiers, XXH64 fingerprints and Gumbel samples are beyond SQL.
ORACLE_SQL = None
