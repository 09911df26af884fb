"""Taxonomy and category mapping text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import SEPARATOR


NO_SEPARATOR = "\u0001"  # never in a line, so each line is one field


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated fields of each line after the header, lower-cased."""
    options = {"header": True, "sep": NO_SEPARATOR, "quote": ""}
    lines = spark.read.options(**options).schema("line string").csv(path)
    return lines.select(F.split(F.rtrim(F.lower("line"), F.lit(";")), ";").alias("f"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``id;level1;level2;...`` lines to ``(id, path, depth)``."""
    return _fields(spark, path).select(
        F.element_at("f", 1).cast("int").alias("id"),
        F.array_join(F.slice("f", 2, F.size("f")), SEPARATOR).alias("path"),
        (F.size("f") - 1).alias("depth"),
    )


def deep_pairs(df: DataFrame) -> DataFrame:
    """Mapping pairs in lower case; both paths need more than one level."""
    pairs = df.select(F.lower("source_path").alias("source_path"), F.lower("target_path").alias("target_path"))
    levels = lambda c: F.size(F.split(F.rtrim(F.col(c), F.lit(">")), ">"))
    return pairs.where((levels("source_path") > 1) & (levels("target_path") > 1))


def read_category_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``source>path;target > path`` lines to a mapping table."""
    pairs = _fields(spark, path).select(F.get("f", 0).alias("source_path"), F.get("f", 1).alias("target_path"))
    return deep_pairs(pairs)
