"""Places of pattern matches as rows, found with Spark's own string functions.

A text cut at a pattern's matches gives the pieces between them; the lengths of pieces
and matches, summed up in order, are the places. Lengths are code points. Texts are
named by a digest, so that copies of one text are looked at, joined and counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters kept on either side of a match.
CONTEXT = 40


def text_key(text: Column) -> Column:
    """A digest of a text; null for a null text."""
    return F.md5(text.cast("binary"))


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """An array of matches with the lengths of what lies before them."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(
        F.arrays_zip(
            found.alias("match"), inner.alias("inner"), F.slice(pieces, 1, F.size(found)).alias("gap"),
            F.slice(pieces, 2, F.greatest(F.size(found), F.lit(1))).alias("next")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["match"].alias("match"), x["inner"].alias("inner"), F.length(x["gap"]).alias("skipped"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")),
    )
    return F.when(text.rlike(pattern), rows)


def located(docs: DataFrame, text_col: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """(text_key, kind, start, end, match, inner, before, after) of all matches in all different texts.

    ``patterns`` has a pattern and the number of the group that ``inner`` returns, by kind.
    """
    text = F.col(text_col)
    kinds = [F.posexplode(_matches(text, kind, *of)).alias("nth", "m") for kind, of in patterns.items()]
    rows = None
    for exploded in kinds:
        part = docs.where(text.isNotNull()).select(text_key(text).alias("text_key"), exploded)
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("text_key", "kind").orderBy("nth")
    end = F.sum(F.col("skipped") + F.length("match")).over(order)
    return rows.select("text_key", "nth", "m.*").dropDuplicates(["text_key", "kind", "nth"]).select(
        "text_key", "kind", (end - F.length("match")).alias("start"), end.alias("end"), "match", "inner", "before", "after")


def binned(spans: DataFrame, width: int, around: int = 0) -> DataFrame:
    """Each span once for every stretch of ``width`` that it, or what is ``around`` it, lies in."""
    first, last = F.floor((F.col("start") - around) / width), F.floor((F.col("end") - 1 + around) / width)
    return spans.withColumn("bin", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def without_overlaps(spans: DataFrame, others: DataFrame, width: int = 200) -> DataFrame:
    """The spans that share no character with any of ``others`` in their text."""
    o = binned(others.select("text_key", "start", "end"), width).select("text_key", "bin", F.col("start").alias("o_start"), F.col("end").alias("o_end")).distinct()
    hit = (
        binned(spans.select("text_key", "kind", "start", "end"), width).join(o, ["text_key", "bin"])
        .where((F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))).select("text_key", "kind", "start").distinct()
    )
    return spans.join(hit, ["text_key", "kind", "start"], "left_anti")


def digest(spans: DataFrame, kinds: list[str], base: list[str], by_kind: bool) -> DataFrame:
    """(text_key, n_<kind> of base kinds, base: joined base spans, spans: all joined), one row for each text with spans.

    ``by_kind`` puts kind before start in the order; a text's spans are gathered in one row.
    """
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    order = (place, F.col("start")) if by_kind else (F.col("start"), place)
    named = F.struct(order[0].alias("a"), order[1].alias("b"), F.concat_ws(":", "kind", "start", "end").alias("name"), F.col("kind").isin(base).alias("base"))
    gathered = spans.groupBy("text_key").agg(
        F.sort_array(F.collect_list(named)).alias("all"), *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in base))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return gathered.select(
        "text_key", *(f"n_{k}" for k in base), names(F.filter("all", lambda x: x["base"])).alias("base"), names("all").alias("spans"))


def per_document(docs: DataFrame, id_col: str, text_col: str, digests: DataFrame, base: list[str]) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans), one row per document; empty where a text has no span."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key")).join(digests, "text_key", "left")
    return rows.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
