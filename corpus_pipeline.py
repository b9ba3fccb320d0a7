"""Corpus pipeline: the stages that turn ``documents`` into packed training data.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet to the cluster's shared folder and read again as the next one's docs.
All stages but the last return the columns of ``documents`` (and whatever other
columns came along). Null and empty texts, repeated rows, empty tables and
columns with clashing names are handled as the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm import bin_packing, decontaminate, exact_dedup, lang_id, simhash_dedup
from assaybook.llm.common import Scratch, table
from assaybook.sources import files

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 1): documents without a letter go, and those whose best
    language is less likely than that of any labelled document of their length (nine
    tenths of the least score of them all; short texts are not judged by the
    confidence of long ones). The model learns from the stage's own labelled rows;
    without any, only documents without a letter go. Rows that share an id are
    judged each by their text."""
    model = lang_id.fit_languages(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return lang_id.keep_known(docs, model, lang_id.score_limits(docs, model))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (operator 5): one row of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 6): one document of each component stays, the
    one with the smallest id."""
    return simhash_dedup.drop_near_copies(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination (operator 7): documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (operator 4): one row per piece with its bin."""
    return bin_packing.pack_documents(docs)


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("decontamination", contaminated), ("packing", packed)]

#: Language ID and the similarity stages are beyond SQL; tests/llm holds the brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packing of what is left. What a stage wrote
    on the way, and the table it read, go once its own table is written; the
    packing's few tables stay until ``remove_staged``."""
    docs, spent = table(spark, sf_dir, "documents"), None
    for name, fn in STAGES[:-1]:
        with Scratch(spark) as block:
            docs = block.keep(fn(spark, docs, sf_dir), f"pipeline-{name}")
        if spent:
            files.remove(spark, spent)
        spent = block.kept
    return STAGES[-1][1](spark, docs, sf_dir)
