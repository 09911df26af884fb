"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import ftrl
from shelfmark.llm.decontaminate import benchmark_matches
from shelfmark.llm.jaccard import jaccard_components
from shelfmark.llm.language_model import text_scores
from shelfmark.llm.manifest import document_proofs
from shelfmark.llm.mixing import MIXED_SQL, mixed_sizes
from shelfmark.llm.passages import repeated_passages
from shelfmark.llm.pii import personal_by_document
from shelfmark.llm.quality import text_quality
from shelfmark.llm.runs import periodic_runs
from shelfmark.llm.secrets import secrets_by_document
from shelfmark.llm.tables import WORD, documents, fold, table
from shelfmark.llm.templates import LINES_SQL, drop_recurring_lines
from shelfmark.llm.toxicity import CUT, FOLDS, HELD_OUT, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf_dir))


SQL["op1_mix_sources"] = MIXED_SQL


@_query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


@_query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_by_document(documents(spark, sf_dir))


@_query
def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query
def op5_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@_query
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lines = F.when(F.col("before").isNull(), 0).otherwise(F.size(F.split("before", "\n"))).cast("long")
    kept = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return drop_recurring_lines(docs.withColumn("before", F.col("text"))).select(
        "doc_id", lines.alias("n_lines"), (lines - kept).alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


SQL["op6_line_templates"] = LINES_SQL


@_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_by_document(documents(spark, sf_dir))


@_query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(documents(spark, sf_dir))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored, score = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= CUT).cast("int").alias("predicted"))


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts that the id's checksum picks, the words from some place on repeat with a period."""
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select("doc_id", "text", checksum.alias("h"), F.floor(checksum / 10).cast("long").alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    ratio = F.expr("best.length * 1000 div best.period")
    return periodic_runs(with_planted_runs(documents(spark, sf_dir))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", ratio.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")
    learnt = labels.where(fold("doc_id", ftrl.FOLDS) != ftrl.HELD_OUT)
    scored, score = ftrl.score_quality(docs, learnt)
    held_out = fold("doc_id", ftrl.FOLDS) == ftrl.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= ftrl.CUT).cast("int").alias("predicted"))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return document_proofs(documents(spark, sf_dir), F.when(fold("doc_id", 5) == 0, lowered))
