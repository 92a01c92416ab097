"""From raw documents to a weighted mix: each stage takes what the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.common import stored, table
from flowloom.llm.decontaminate import clean_documents
from flowloom.llm.jaccard_join import one_of_each_group
from flowloom.llm.mixing import mixed_documents
from flowloom.llm.pii import sanitised
from flowloom.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's reference."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links on word shingles hold together: the one with the least id."""
    return one_of_each_group(docs, scanned=True)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"), scanned=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced."""
    return sanitised(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    return mixed_documents(docs, scanned=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("personal data", personal_data),
    ("source mix", source_mix),
]

#: The stages between are not SQL; tests compare the whole with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
