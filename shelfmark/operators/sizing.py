"""Small derived tables whose true size Spark should know before it joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.session import scratch_path


def materialise(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared scratch folder and read it back.

    Spark cannot foresee how far an aggregate shrinks its input, so a join with
    one would shuffle the large side too. Read back from files the table has a
    measured size: under ``spark.sql.autoBroadcastJoinThreshold`` Spark broadcasts
    it, above that it sorts, merges and splits skewed keys. Nothing is forced by a
    hint, and a lost executor only costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
