"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", name: str = "shelfmark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one it provides."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_scratch: str | None = None


def scratch_path(spark: SparkSession) -> str:
    """A fresh path inside the folder that ``spark.checkpoint.dir`` names.

    Intermediate tables written here outlive any executor. Only a local master
    may fall back to a folder of its own; a cluster must name a shared one.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="shelfmark-")
        base = _local_scratch
    return f"{base.rstrip('/')}/shelfmark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when its results are written."""
    path = scratch_path(spark).rsplit("/", 1)[0]
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
