"""From raw documents to packed training text: five stages, each an operator of orewright.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orewright.llm.common import dropped, fresh_path, stored, table
from orewright.llm.lines import line_dedup
from orewright.llm.packing import pack
from orewright.llm.quality import quality_filter
from orewright.llm.simhash import similar_dedup
from orewright.llm.substring import substring_filter


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of three lines that stand at an earlier place."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar at 0.8 or more."""
    return similar_dedup(docs, shingle=5, similarity=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that a smaller document has."""
    return substring_filter(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in batches."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("packing", packing),
]

#: The classifier is trained and the buckets are chosen outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is removed once the next one's is written; that of the last but one stays."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before, written = written, fresh_path(spark)
        docs = stored(stage(spark, docs, sf_dir), written)
        if before:
            dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
