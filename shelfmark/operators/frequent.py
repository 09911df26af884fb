"""The most frequent items of an open vocabulary, without counting all of it.

A mergeable sketch of fixed size is built in one scan, combined map-side; a second scan
counts its items exactly. The sketch keeps every item that occurs more often than a bound
(``ERROR`` over its size, as a share of all occurrences), so a count above that bound proves
that no item outside can rank before it. Where the k-th count does not reach the bound, the
vocabulary is too flat for the sketch, and all items are counted: the result is exact always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.sizing import materialise

#: Items a sketch tracks, and the factor of its error bound.
SKETCH, ERROR = 50_000, 3.5


def sketched_items(items: DataFrame, item: str = "item", size: int = SKETCH) -> DataFrame:
    """(item, total): the items that a sketch of ``size`` tracks, with the number of all occurrences."""
    state = items.where(F.col(item).isNotNull()).agg(
        F.expr(f"approx_top_k_accumulate(`{item}`, {size})").alias("state"), F.count("*").alias("total"))
    return state.select("total", F.explode(F.expr(f"approx_top_k_estimate(state, {size})")).alias("of")).select(F.col("of.item").alias(item), "total")


def frequent_items(items: DataFrame, k: int, item: str = "item", size: int = SKETCH) -> DataFrame:
    """(item, count): the ``k`` commonest items, equals by name; NULL is no item."""
    known = items.where(F.col(item).isNotNull()).select(item)
    first = lambda counts: counts.orderBy(F.desc("count"), item).limit(k)
    candidates = materialise(sketched_items(known, item, max(size, k)))
    total = candidates.agg(F.max("total")).first()[0] or 0
    counted = materialise(known.join(candidates.select(item), item, "left_semi").groupBy(item).agg(F.count("*").alias("count")))
    found = first(counted)
    rows, least = found.agg(F.count("*"), F.min("count")).first()
    nothing_else = (counted.agg(F.sum("count")).first()[0] or 0) == total
    if nothing_else or (rows == k and least > ERROR * total / max(size, k)):
        return found
    return first(known.groupBy(item).agg(F.count("*").alias("count")))


def frequent_words(df: DataFrame, tokens: Column | str, k: int, distinct: bool = False, size: int = SKETCH) -> DataFrame:
    """(word, count) of the ``k`` commonest tokens, by occurrences or, ``distinct``, by rows."""
    column = F.col(tokens) if isinstance(tokens, str) else tokens
    return frequent_items(df.select(F.explode(F.array_distinct(column) if distinct else column).alias("word")), k, "word", size)
