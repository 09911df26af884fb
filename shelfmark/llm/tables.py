"""The tables that the queries of this subpackage read, and steps that several operators share."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.sizing import materialise
from shelfmark.session import scratch_path

if TYPE_CHECKING:  # a task of this subpackage does not load it
    import pandas as pd

__all__ = ["documents", "table", "materialise", "scratch_path", "fold", "training_texts", "WORD"]

#: A word, as a pattern for Spark's own string functions.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BLANKS))).otherwise(0).cast("long")


#: Bytes of text that a model is trained on at most.
TRAIN_BYTES = 64 << 20


def training_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, limit: int = TRAIN_BYTES) -> pd.DataFrame:
    """The texts of a bounded table of ids (id, order, ...) with its columns: one text an id, the one of least hash.

    In order, as many whole texts as stay within ``limit`` bytes; null counts as empty.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(materialise(ids), "id")
    own = F.struct(F.xxhash64("text"), "text", *[c for c in ids.columns if c != "id"])
    one = materialise(texts.groupBy("id").agg(F.min(own).alias("own")).select("id", "own.*"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0))
    fits = one.select("id", upto.alias("upto")).where(F.col("upto") <= limit).select("id")
    return one.join(fits, "id", "left_semi").select("text", *ids.columns).orderBy("id").toPandas()
