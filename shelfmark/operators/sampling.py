"""Capped and split samples per category, exact and without ranking whole groups.

One category may hold a third of all rows, so no task ever sorts a category. Rows
are ordered by a hexadecimal key that spreads them evenly (``order_key``); its first
digits cut every category into even slices. Slice counts say which slice holds a
wanted rank, and only that slice is sorted to find the key at the rank. A sample is
then a plain comparison with that key: no shuffle of the rows.

``order`` names such a key column, hexadecimal. Equal keys and missing ones are exact as
well: a missing key is made from the row's other columns, and among the rows whose key is
the one at a wanted rank, as many are taken as the rank asks for, in the order of a hash
of the whole row. Rows that are equal in every column stand in for each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.paths import level_names
from shelfmark.operators.sizing import materialise

SLICE_DIGITS = 3  # 4,096 slices per category
BEFORE_ALL, AFTER_ALL = "", "g"  # no hexadecimal key sorts below or above these


ORDER = "__order"


def _ordered(df: DataFrame, order: str) -> DataFrame:
    """The rows with a key that is never NULL."""
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(ORDER, F.coalesce(F.col(order), F.md5(rest.cast("string"))))


def _slice(key: str) -> Column:
    return F.substring(key, 1, SLICE_DIGITS)


def _slice_counts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows per (keys, slice), with the rows before the slice and in the whole group."""
    counts = df.groupBy(*keys, _slice(order).alias("__slice")).agg(F.count(F.lit(1)).alias("__rows"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        *keys, "__slice", "__rows",
        (F.sum("__rows").over(upto) - F.col("__rows")).alias("__before"),
        F.sum("__rows").over(group).alias("__total"),
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def rank_keys(
    df: DataFrame, keys: Sequence[str], order: str, ranks: dict[str, Column], sizes: DataFrame | None = None
) -> DataFrame:
    """The order key at given ranks of every group, as one small table.

    ``ranks`` maps output names to rank expressions over ``__total`` (rows in the
    group) and the columns of ``sizes``, an optional table joined on ``keys``. A rank
    below 1 gives a key before all rows, a rank past the end one after all rows, and
    a NULL rank (no entry in ``sizes``) NULL. ``<name>__need`` says how many of the rows
    with exactly that key are up to the rank, and ``<name>__ties`` how many there are.
    """
    keys = list(keys)
    narrow = df.select(*keys, order)
    slices = _slice_counts(narrow, keys, order)
    if sizes is not None:
        slices = slices.join(sizes, keys, "left")
    aggs = []
    for name, rank in ranks.items():
        here = (rank > F.col("__before")) & (rank <= F.col("__before") + F.col("__rows"))
        side = F.when(F.max(rank) < 1, BEFORE_ALL).when(F.max(rank) > F.max("__total"), AFTER_ALL)
        aggs += [
            F.max(F.when(here, F.col("__slice"))).alias(f"{name}__slice"),
            F.max(F.when(here, rank - F.col("__before"))).alias(f"{name}__rank"),
            side.alias(f"{name}__side"),
        ]
    bounds = materialise(slices.groupBy(*keys).agg(*aggs))

    wanted = F.lit(False)
    for name in ranks:
        wanted = wanted | F.coalesce(F.col("__slice") == F.col(f"{name}__slice"), F.lit(False))
    cut = narrow.withColumn("__slice", _slice(order))
    near = cut.join(bounds, _same(cut, bounds, keys)).where(wanted).select(
        *[cut[k] for k in keys], cut[order], "__slice",
        *[f"{name}__{part}" for name in ranks for part in ("slice", "rank")],
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(order)
    taken = F.struct(F.col(order).alias("key"), (F.col("__at") - F.col("__first") + 1).alias("need"), "__ties")
    found = (
        near.withColumn("__at", F.row_number().over(inside)).withColumn("__first", F.rank().over(inside))
        .withColumn("__ties", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__slice", order)))
        .groupBy(*keys)
        .agg(*[
            F.max(F.when((F.col("__slice") == F.col(f"{name}__slice")) & (F.col("__at") == F.col(f"{name}__rank")), taken)).alias(f"{name}__key")
            for name in ranks
        ])
    )
    table = bounds.join(found, _same(bounds, found, keys), "left").select(
        *[bounds[k] for k in keys],
        *[F.coalesce(f"{name}__side", f"{name}__key.key").alias(name) for name in ranks],
        *[F.coalesce(f"{name}__key.need", F.lit(0)).alias(f"{name}__need") for name in ranks],
        *[F.coalesce(f"{name}__key.__ties", F.lit(0)).alias(f"{name}__ties") for name in ranks],
    )
    return materialise(table)


def _with_keys(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        table = table.withColumnRenamed(k, f"__{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(table[f"__{k}"])
    return df.join(table, cond)


def _upto(df: DataFrame, keys: Sequence[str], order: str, ranks: dict[str, Column], sizes: DataFrame | None = None) -> DataFrame:
    """The rows with one flag for each of ``ranks``: whether the row is among the first so many of its group."""
    rows = _ordered(df, order)
    marks = rank_keys(rows, keys, ORDER, ranks, sizes)
    marked = _with_keys(rows, marks, keys)
    key = F.col(ORDER)
    open_ties = F.lit(False)
    for name in ranks:
        open_ties = open_ties | (F.col(f"{name}__need") < F.col(f"{name}__ties"))
    if marks.where(open_ties).isEmpty():  # every key at a rank is taken whole
        return marked.select(*df.columns, *[(key <= F.col(name)).alias(f"{name}__in") for name in ranks])
    at = F.lit(False)
    for name in ranks:
        at = at | F.coalesce(key == F.col(name), F.lit(False))
    plain = marked.where(~at).select(*df.columns, *[(key < F.col(name)).alias(f"{name}__in") for name in ranks])
    # rows whose key is the one at a rank: all equal keys of a group are there
    tied = marked.where(at).withColumn("__at", F.row_number().over(
        Window.partitionBy(*keys, ORDER).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))))
    tied = tied.select(*df.columns, *[
        ((key < F.col(name)) | ((key == F.col(name)) & (F.col("__at") <= F.col(f"{name}__need")))).alias(f"{name}__in") for name in ranks])
    return plain.unionByName(materialise(tied))


def stratified_cap(df: DataFrame, keys: Sequence[str], n: int, order: str, sizes: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows of every group by ``order``.

    With ``sizes`` (keys and ``count``) the cap is the smaller of ``n`` and the listed
    count, and groups it does not list are dropped.
    """
    cap = F.lit(n).cast("bigint")
    if sizes is not None:
        cap = F.when(F.col("count").isNotNull(), F.least(F.col("count"), cap))
    return _upto(df, keys, order, {"__last": cap}, sizes).where("__last__in").select(*df.columns)


def stratified_split(
    df: DataFrame, keys: Sequence[str], n: int | None, frac: float, order: str, sizes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of every group, at most ``n`` in all; all of them without ``n``.

    With s the capped group size and t = round(s * frac), ranks below t train and
    ranks t..s test. ``sizes`` works as in ``stratified_cap``.
    """
    listed = F.col("count") if sizes is not None else F.col("__total")
    size = F.when(listed.isNotNull(), F.least(listed, F.lit(n).cast("bigint")))  # a null ``n`` bounds nothing
    before = F.round(size * F.lit(frac)).cast("bigint") - 1
    rows = _upto(df, keys, order, {"__train": before, "__last": size}, sizes)
    test = rows.where("__last__in and not __train__in")
    return rows.where("__train__in").select(*df.columns), test.select(*df.columns)


def split_by_top_category(
    df: DataFrame, n: int, frac: float, order: str, key: str = "cat1"
) -> tuple[DataFrame, DataFrame]:
    """Split by level 1: ranks up to round(min(size, n) * frac) train, then up to ``n`` test."""
    size = F.least(F.col("__total"), F.lit(n).cast("bigint"))
    ranks = {"__train": F.round(size * F.lit(frac)).cast("bigint"), "__last": F.lit(n).cast("bigint")}
    rows = _upto(df, [key], order, ranks)
    test = rows.where("__last__in and not __train__in")
    return rows.where("__train__in").select(*df.columns), test.select(*df.columns)


def with_rank(df: DataFrame, keys: Sequence[str], order: str, out: str = "rn") -> DataFrame:
    """Exact ``row_number`` within each group, computed slice by slice.

    Rows are shuffled once, by (keys, slice); the rows before each slice come from
    the slice counts, which are partitioned the same way.
    """
    keys, columns = list(keys), df.columns
    df, order = _ordered(df, order), ORDER
    before = _slice_counts(df.select(*keys, order), keys, order)
    renamed = before.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__slice").alias("__of"), "__before"
    )
    cut = df.withColumn("__slice", _slice(order))
    inside = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(order))
    cond = F.col("__slice") == F.col("__of")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        cut.withColumn("__at", inside)
        .join(renamed, cond)
        .select(*columns, (F.col("__before") + F.col("__at")).alias(out))
    )


def stratified_folds(df: DataFrame, label: str, k: int, order: str) -> DataFrame:
    """Add ``fold`` 0..k-1, dealt round-robin within every class."""
    return with_rank(df, [label], order, "__rn").withColumn(
        "fold", ((F.col("__rn") - 1) % k).cast("int")
    ).drop("__rn")


def hierarchical_cap(df: DataFrame, n: int, depth: int, order: str) -> DataFrame:
    """Cap at the deepest level, then cap what is left one level up, and so on to level 1.

    How many rows of each slice survive every level follows from slice counts alone;
    rows are then ranked only inside their slice, all levels on one partitioning.
    """
    levels = level_names(depth)
    filled = _ordered(df, order).withColumns({f"__{c}": F.coalesce(c, F.lit("")) for c in levels}).withColumn("__slice", _slice(ORDER))
    keys = [f"__{c}" for c in levels]

    room = filled.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__left"))
    for d in range(depth, 0, -1):
        above = keys[:d]
        in_slice = Window.partitionBy(*above, "__slice")
        upto = Window.partitionBy(*above).orderBy("__slice").rangeBetween(Window.unboundedPreceding, 0)
        first = F.row_number().over(in_slice.orderBy(*keys[d:] or ["__slice"])) == 1
        here, cumulated = F.sum("__left").over(in_slice), F.sum("__left").over(upto)
        open_rows = F.least(here, F.greatest(F.lit(0), F.lit(n) - (cumulated - here)))
        room = room.withColumn(f"__room{d}", open_rows).withColumn(
            "__left", F.when(first, F.col(f"__room{d}")).otherwise(0)
        )
    rooms = [f"__room{d}" for d in range(1, depth + 1)]
    room = materialise(room.where(F.least(*rooms) > 0 if depth > 1 else F.col(rooms[0]) > 0).drop("__left"))

    last = materialise(room.groupBy(*keys).agg(F.max("__slice").alias("__last")))
    kept = filled.join(last, keys).where(F.col("__slice") <= F.col("__last")).drop("__last")
    kept = kept.join(room, [*keys, "__slice"])
    kept = kept.repartition(keys[0], "__slice")
    for d in range(depth, 0, -1):
        at = F.row_number().over(Window.partitionBy(*keys[:d], "__slice").orderBy(ORDER))
        kept = kept.withColumn("__at", at).where(F.col("__at") <= F.col(f"__room{d}")).drop("__at")
    return kept.select(*df.columns)
