"""Scalar cleaning expressions for product text, prices and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price bands as (upper bound, rounding step).
PRICE_STEPS = ((20.0, 2.0), (100.0, 10.0), (1e3, 100.0), (1e4, 1e3), (1e5, 2e4))
PRICE_TOP_BAND = 1e6


def text_of(*cols: Column | str) -> Column:
    """One text from several fields; NULL fields vanish, empty ones stay."""
    return F.concat_ws(" ", *cols)


def clean_json(text: Column) -> Column:
    """Undo CSV quoting of a JSON field: outer quotes off, doubled quotes single."""
    return F.replace(F.btrim(text, F.lit('"')), F.lit('""'), F.lit('"'))


def clean_material(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[0-9%]", ""))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, "[,']", "")


def price_bucket(price: Column) -> Column:
    """Band a price: each band of PRICE_STEPS rounds half up to its own step."""
    value = price.cast("double")
    banded = F.when(value.isNull(), None).when(value == 0, 0.0).when(value <= 1, 1.0)
    for bound, step in PRICE_STEPS:
        banded = banded.when(value <= bound, F.floor(value / step + 0.5) * step)
    return banded.when(value <= PRICE_TOP_BAND, PRICE_TOP_BAND).otherwise(value)


def is_odd(word: Column) -> Column:
    """True for a non-empty word that is not purely ASCII letters."""
    return ~word.rlike(r"\A[a-zA-Z]*\z")


def is_placeholder(word: Column) -> Column:
    return word.rlike(r"\A<.*>\z")


def order_key(id_cols: Column | str | Sequence[Column | str], seed: str | int = "") -> Column:
    """A repeatable pseudo-random hex key: same rows, same order on every run.

    Name the columns that together tell rows apart. A missing part counts as one more
    value; with all parts missing there is no key, and samplers fall back on the row.
    """
    named = [id_cols] if isinstance(id_cols, str | Column) else list(id_cols)
    cols = [F.col(c) if isinstance(c, str) else c for c in named]
    parts = [c.cast("string") for c in cols]
    if len(parts) == 1:
        return F.md5(F.concat(parts[0], F.lit(f":{seed}")))
    joined = F.concat_ws(":", *[F.coalesce(p, F.lit("\x00")) for p in parts], F.lit(str(seed)))
    return F.when(F.coalesce(*parts).isNotNull(), F.md5(joined))


def round_array(values: Column, places: int = 3) -> Column:
    return F.transform(values, lambda x: F.round(x, places))


def logistic_array(values: Column, places: int = 3) -> Column:
    """Logistic squashing of raw scores, element by element."""
    return F.transform(values, lambda x: F.round(1 / (1 + F.exp(-x)), places))


def max_probability(values: Column) -> Column:
    return F.array_max(values)


def add_term(tokens: Column, term: Column, keep_counts: bool = False) -> Column:
    """Put ``term`` before the tokens: as a set union, or keeping repeats."""
    head = F.array(term)
    return F.concat(head, tokens) if keep_counts else F.array_union(head, tokens)
