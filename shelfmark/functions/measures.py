"""Replace measurements and dimensions in a token by a typed placeholder."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import let

# Number formats that count as a measurement or dimension; group 1 is the unit.
_NUMBER = r"[0-9]+(?:\.?[0-9]+)?"
SINGLE = rf"""\A{_NUMBER}([°º]?[a-zA-Z]{{0,9}}(?:/[a-zA-Z])?|'|"[a-zA-Z]{{0,9}}|%)\z"""
RANGE = rf"""\A{_NUMBER}-{_NUMBER}([°º]?[a-zA-Z]{{0,9}}(?:/[a-zA-Z])?|'|"|%)\z"""
TWO_D = rf"""\A{_NUMBER}[*xX×]{_NUMBER}([a-zA-Z]{{0,9}}|'|")\z"""
THREE_D = rf"""\A{_NUMBER}[*xX×]{_NUMBER}[*xX×]{_NUMBER}([a-zA-Z]{{0,9}}|'|")\z"""

# Unit spellings and the name each one gets.
LENGTH_UNITS = {
    "mm": "mm", "cm": "cm", "m": "m", "km": "km",
    '"': "inch", "quot": "inch", "in": "inch", "inch": "inch", "inches": "inch",
    "'": "ft", "ft": "ft",
}
UNITS = {
    "mg": "mg", "g": "g", "kg": "kg", "kgs": "kg", "oz": "oz", "lbs": "lbs",
    "ml": "ml", "l": "l", "kl": "kl", **LENGTH_UNITS,
    "psi": "psi", "%": "%", "percent": "%", "ohms": "ohm", "ohm": "ohm",
    "w": "watt", "watts": "watt", "wattage": "watt", "wh": "watt_hour",
    "ah": "amp_hour", "mah": "milli_amp_hour",
    "v": "volt", "volts": "volt", "voltage": "volt",
    "min": "minute", "mins": "minute", "h": "hour", "hr": "hour", "hrs": "hour", "cc": "cc",
}


def _unit_name(unit: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    other = (
        F.when(F.length(unit) <= 1, unit)
        .when(unit.startswith("'"), "ft")
        .when(unit.startswith('"'), "inch")
        .when((F.length(unit) > 4) & unit.rlike(r"\A(?:mm|cm|hz)"), F.substring(unit, 1, 2))
        .when(unit.startswith("quot"), "inch")
        .otherwise(unit)
    )
    return F.coalesce(known[unit], other)


def _placeholder(token: Column, prefix: Column, suffix: Column, pattern: str, names: dict) -> Column:
    number = F.when(token.contains("."), "float").otherwise("int")
    unit = let(F.lower(F.regexp_extract(token, pattern, 1)), lambda u: _unit_name(u, names))
    return F.concat(F.lit("<"), prefix, number, suffix, F.lit("_"), unit, F.lit(">"))


def _times(token: Column, sign: str) -> Column:
    return F.length(token) - F.length(F.replace(token, F.lit(sign), F.lit("")))


def _is_three_d(token: Column) -> Column:
    return (_times(token, "x") == 2) | (_times(token, "*") == 2) | (_times(token, "×") == 2)


def _has_times_sign(token: Column) -> Column:
    return token.rlike("[x*×]")


def measurement(token: Column) -> Column:
    """``12cm`` to ``<int_cm>``, ``2*4in`` to ``<2d_int_inch>``; other tokens stay."""
    none = F.lit("")
    plain = F.replace(token, F.lit(","), none)
    dimension = (
        F.when(
            _is_three_d(token),
            F.when(token.rlike(THREE_D), _placeholder(token, F.lit("3d_"), none, THREE_D, LENGTH_UNITS)),
        ).when(token.rlike(TWO_D), _placeholder(token, F.lit("2d_"), none, TWO_D, LENGTH_UNITS))
    )
    amount = F.when(
        plain.contains("-"),
        F.when(plain.rlike(RANGE), _placeholder(plain, none, F.lit("_range"), RANGE, UNITS)),
    ).when(plain.rlike(SINGLE), _placeholder(plain, none, none, SINGLE, UNITS))
    return (
        F.when(~token.rlike("[0-9]"), token)
        .when(_has_times_sign(token), F.coalesce(dimension, token))
        .otherwise(F.coalesce(amount, plain))
    )


def keeps_its_digits(token: Column) -> Column:
    """True for a token with digits that ``measurement`` would leave as it is."""
    dimension = F.when(_is_three_d(token), token.rlike(THREE_D)).otherwise(token.rlike(TWO_D))
    amount = F.when(token.contains("-"), token.rlike(RANGE)).otherwise(token.rlike(SINGLE))
    return token.rlike("[0-9]") & F.when(_has_times_sign(token), ~dimension).otherwise(
        ~token.contains(",") & ~amount
    )
