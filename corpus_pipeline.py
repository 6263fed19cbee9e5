"""Cleaning a corpus: quality rules, line dedup, near-duplicates, benchmark decontamination and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four return rows with
the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathmill.llm import decontam, linededup, nearcopies, packing, rules
from pathmill.llm.common import keep, scratch, table

#: SQL cannot express a trained classifier, XXH64 or a tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fitted heads go; the heads are fitted on labelled rows of ``docs``."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; lines that are boilerplate at their source, counted once for each text, go from its text."""
    return linededup.drop_boilerplate(docs, copies_once=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays."""
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
