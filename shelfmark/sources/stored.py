"""Refreshing a stored table in place: rows replaced by key, untouched partitions left alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import level_names
from shelfmark.operators.sizing import materialise


def _null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[c])
    return same


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], partitions: Sequence[str] = tuple(level_names(3)), newest: str | None = None) -> None:
    """Put ``rows`` into the Parquet table at ``path``, in place of stored rows with the same keys.

    Only partitions that hold an old or a new version of a key are read whole and written
    again; Spark swaps them when all their files are there. A partition that loses its last
    row is deleted. The same call may be repeated, also after one that broke off: rows are
    found by key, wherever their old version stands. ``rows`` have the columns of the table;
    of several rows with one key the greatest by ``newest`` counts, without it that is an error.
    """
    keys, partitions = list(keys), list(partitions)
    stored = spark.read.schema(rows.schema).parquet(path)
    if newest is not None:
        every = F.struct(newest, *[c for c in rows.columns if c != newest])
        rows = rows.groupBy(*keys).agg(F.max(every).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in rows.columns])
    rows = materialise(rows)
    if newest is None and not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("several rows have the same key; name the column that tells the newest")
    wanted = rows.select(*keys)
    old_places = stored.select(*keys, *partitions).join(wanted, _null_safe(stored, wanted, keys), "left_semi").select(*partitions)
    touched = materialise(old_places.unionByName(rows.select(*partitions)).distinct())
    affected = stored.select("*", F.col("_metadata.file_path").alias("__file")).join(touched, _null_safe(stored, touched, partitions), "left_semi")
    files = materialise(affected.select(*partitions, F.regexp_replace("__file", "/[^/]+$", "").alias("folder")).distinct())
    kept = affected.join(wanted, _null_safe(stored, wanted, keys), "left_anti").select(*rows.columns)
    fresh = materialise(kept.unionByName(rows))
    fresh.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    filled = fresh.select(*partitions).distinct()
    _delete(spark, [r["folder"] for r in files.join(filled, _null_safe(files, filled, partitions), "left_anti").select("folder").collect()])


def _delete(spark: SparkSession, folders: Sequence[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in folders:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
