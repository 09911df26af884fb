"""A corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared scratch folder and reads back as the next stage's documents. All
stages but the last return the columns of ``documents``; the last adds the number of
the copy. Rows with nulls pass through the stages as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.decontaminate import decontaminated
from shelfmark.llm.jaccard import one_of_each
from shelfmark.llm.mixing import mix
from shelfmark.llm.tables import documents, materialise, table
from shelfmark.llm.templates import drop_recurring_lines
from shelfmark.llm.toxicity import CUT, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the cut."""
    scored, score = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(score) < CUT).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines of recurring templates; every document stays."""
    return drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL cannot express the first, third and fourth stage; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
