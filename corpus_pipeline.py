"""Corpus preparation: language ID, quality rules, near-duplicates, source mix and packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All
but the last return the columns of ``documents``; run() writes each stage's rows as Parquet to the
shared folder and reads them again. Stage choices come from models fitted on the rows at hand
(trigram models, hash-based sampling of kept rows), so SQL can't express the whole; the tests
compare the stages with plain-Python versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.language_id import document_evidence, identify
from corpuslens.llm.minhash_dedup import keep_ids, near_duplicate_classes
from corpuslens.llm.mixing import mix
from corpuslens.llm.packing import pack
from corpuslens.llm.quality import judge
from corpuslens.llm.tables import DOCUMENT_COLUMNS, documents, table
from corpuslens.plans.scratch import Scratch, released


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; ``lang`` becomes that language."""
    judged = identify(document_evidence(docs, "n_chars")).filter("kept")
    return judged.select(F.col("id").alias("doc_id"), "text", F.col("lang_id").alias("lang"), F.col("host").alias("source"), "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels")).filter("kept").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    scratch = Scratch(spark, "pipeline-dedup")
    removed = scratch.save(near_duplicate_classes(docs).filter("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "removed")
    return keep_ids(docs, "doc_id", removed, "left_anti").select(*DOCUMENT_COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs.select(*DOCUMENT_COLUMNS)).filter("kept").select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        with released():  # the stage's own tables go when its rows are written
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
