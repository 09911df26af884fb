"""Mixing sources to target weights.

Words are summed per source, the mix's targets are set by weight, and a source's
rate is its target over its size. Each document is emitted floor(rate) times, and
once more with probability equal to the fraction, by a hash of its id.

Targets share all words of the input by weight; none exceeds ``limit`` times its
source's size. What a capped source leaves goes to the others by weight, until none
is above. With sources in order of cap over weight the capped ones come first, so
one running sum finds the level at which the rest is shared.

A null source is a source of its own, ordered last. Null and blank texts have no
words and are emitted at their source's rate like any other; a source without words
has the rate 0. Rows with a null id draw by a hash of the text. Rows whose id occurs more
than once draw by their place in the input as well, so that a repeated id is taken as
often as its rate says; reruns over the same files agree. Texts of any length are
counted whole. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import free_name, materialise, word_count

WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = "mix"


def draw(doc_id: Column, text: Column, place: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that follows from the id, from the text where the id is null, and from the place if there is one."""
    own = F.coalesce(F.concat(F.lit("id:"), doc_id.cast("string")), F.concat(F.lit("text:"), F.md5(text.cast("binary"))), F.lit(""))
    own = F.concat(own, F.coalesce(F.concat(F.lit("#"), place.cast("string")), F.lit("")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target, rate) from (source, size); weights repeat over the sources in order.

    The windows without a partition are over one row per source.
    """
    sources = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * limit
    by_cap = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("weights"))
        .withColumn("full", F.col("fill") < F.col("level"))
        # of the sources below their caps, the first in order sets the level for all of them
        .withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
            by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return shared.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _placed(docs: DataFrame, id_col: str, place: str) -> DataFrame:
    """The rows with their place in the input where their id, or the lack of one, occurs more than once; null elsewhere."""
    counted = docs.groupBy(F.col(id_col).alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    again = materialise(counted.select("of")).withColumn("again", F.lit(True))
    of, mark = free_name(docs, "id_again"), free_name(docs, "again")
    again = again.toDF(of, mark)
    rows = docs.withColumn(place, F.monotonically_increasing_id())
    joined = rows.join(again, F.col(id_col).eqNullSafe(F.col(of)), "left")
    return joined.withColumn(place, F.when(F.col(mark), F.col(place))).select(*docs.columns, place)


def _copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): what the mix takes of each document."""
    rows = _placed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "doc_id", "place")
    sized = materialise(rows.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), F.col("place"), seed).alias("drawn")))
    rates = materialise(source_rates(sized, weights, limit)).withColumnRenamed("source", "of")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", _copies(F.col("rate"), F.col("drawn"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with the number of the copy as a last column."""
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    of, rate, copy = (free_name(docs, c) for c in ("mix_source", "mix_rate", "copy"))
    rates = materialise(source_rates(sized, weights, limit)).select(F.col("source").alias(of), F.col("rate").alias(rate))
    place = free_name(docs, "place")
    times = _copies(F.col(rate), draw(F.col(id_col), F.col(text_col), F.col(place), seed)).cast("int")
    return (
        _placed(docs, id_col, place).join(rates, F.col(source_col).eqNullSafe(F.col(of))).withColumn(copy, times).where(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns, copy)
    )


MIXED_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce('id:' || CAST(doc_id AS VARCHAR), 'text:' || md5(text), '')), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS drawn
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS fill FROM s),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
              / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM f WINDOW before AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN fill < level THEN CAST(cap AS DOUBLE)
           ELSE weight * (SELECT level FROM l WHERE fill >= level ORDER BY fill, source NULLS LAST LIMIT 1) END AS target
  FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, d.source, size, source_size, target,
       CAST(floor(rate) AS BIGINT) + CAST(drawn < rate - floor(rate) AS BIGINT) AS copies,
       size * (CAST(floor(rate) AS BIGINT) + CAST(drawn < rate - floor(rate) AS BIGINT)) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""
