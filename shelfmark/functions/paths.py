"""Category paths: lower-case level names joined by ``" > "``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " > "
MAX_DEPTH = 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a higher-order function is recomputed for every element;
    bound as the only element of an array it is a plain variable there.
    """
    return F.get(F.transform(F.array(value), body), 0)


def path_levels(path: Column, depth: int = MAX_DEPTH) -> list[Column]:
    """Columns ``cat1..catN``; levels the path does not have are NULL."""
    parts = F.split(path, SEPARATOR)
    return [F.get(parts, i).alias(f"cat{i + 1}") for i in range(depth)]


def level_names(depth: int = MAX_DEPTH) -> list[str]:
    return [f"cat{i}" for i in range(1, depth + 1)]


def label_path(levels: Sequence[Column | str]) -> Column:
    """Join levels into one path and drop every empty level at the end."""
    return F.regexp_replace(F.concat_ws(SEPARATOR, *levels), r"(?: > )* > \z", "")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, SEPARATOR))


def path_prefixes(path: Column, separator: str = SEPARATOR) -> Column:
    """All prefixes of a path, shortest first, as ``array<struct<depth, prefix>>``."""
    return let(F.split(path, separator), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda d: F.struct(
            d.alias("depth"),
            F.array_join(F.slice(parts, 1, d), separator).alias("prefix"),
        ),
    ))


def path_prefix(path: Column, depth: int | Column) -> Column:
    """The first ``depth`` levels of a path, or NULL when it is shallower."""
    parts = F.split(path, SEPARATOR)
    wanted = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(F.size(parts) >= wanted, F.array_join(F.slice(parts, 1, wanted), SEPARATOR))


def path_leaf(path: Column) -> Column:
    return F.element_at(F.split(path, SEPARATOR), -1)


def parent_path(path: Column) -> Column:
    """Everything above the last level; the empty string for level 1."""
    parts = F.split(path, SEPARATOR)
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), SEPARATOR)
