"""Token rules in SQL, one token at a time, to check the whole-text Spark rewriting."""

from __future__ import annotations

from collections.abc import Iterable

TOKEN = r"""[a-zA-Z0-9$%@\x{80}¢£¥°º½¾`.\-*×±µ"'',/]{3,30}"""
REJECT = "[a-z]{2,}[0-9]|[aeiou]{5,}|[bcdfghjklmnpqrstvwxyz]{5,}|[0-9]{6,}|[0-9]+[a-z]+[0-9]+|[a-z]+[0-9]+[a-z]+"
NOISE = (
    "[aeiou]{5,}|[bcdfghjklmnpqrstvwxyz]{5,}|[0-9]{5,}|[0-9]+[a-z]+[0-9]+|[a-z]+[0-9]+[a-z]+|"
    r"\A(?:[a-z]+-)*[a-z]*[0-9]+(?:-[0-9]+)*(?:-[a-z]+)*\z"
)
NUM = r"[0-9]+(?:\.?[0-9]+)?"
ONE = rf"""\A{NUM}([°º]?[a-zA-Z]{{0,9}}(?:/[a-zA-Z])?|''|"[a-zA-Z]{{0,9}}|%)\z"""
SPAN = rf"""\A{NUM}-{NUM}([°º]?[a-zA-Z]{{0,9}}(?:/[a-zA-Z])?|''|"|%)\z"""
D2 = rf"""\A{NUM}[*xX×]{NUM}([a-zA-Z]{{0,9}}|''|")\z"""
D3 = rf"""\A{NUM}[*xX×]{NUM}[*xX×]{NUM}([a-zA-Z]{{0,9}}|''|")\z"""


def _sub(expr: str, *rules: tuple[str, str]) -> str:
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"
    return expr


SPLIT = _sub(
    "replace(t, '''''', '\"')",
    ("''(?:(t)|s|d|ll|re|m|ve)", r"\1"), ('"{2,}', '"'), ("-{2,}", "-"), ("([a-zA-Z])-([a-zA-Z])", r"\1 \2"),
    (",{2,}", ","), (r"\.{2,}", "."), (r"(.)[.,*]+([^0-9\-\s])", r"\1 \2"), (r"([^0-9\-])[.,]+(.)", r"\1 \2"),
    ("(.)/(..)", r"\1 \2"),
)
CAMEL = _sub("t", ("([a-z]{2})([A-Z][a-z])", r"\1 \2"))
EDGES = _sub("ltrim(rtrim(trim(t, ',-*:/'), '.'), '''\"')", (r"\A\.([^0-9])", r"\1"), ("([^0-9])[''\"]+\\z", r"\1"))
TIMES = "len(t) - len(replace(t, '{0}', ''))"
THREE = " OR ".join(f"len(t) - len(replace(t, '{s}', '')) = 2" for s in "x*×")
REPEATED = f"""regexp_matches(t, '[0-9]') AND CASE
  WHEN regexp_matches(t, '[x*×]') THEN NOT CASE WHEN {THREE} THEN regexp_matches(t, '{D3}') ELSE regexp_matches(t, '{D2}') END
  ELSE NOT contains(t, ',') AND NOT CASE WHEN contains(t, '-') THEN regexp_matches(t, '{SPAN}') ELSE regexp_matches(t, '{ONE}') END END"""


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '\\w+')"


def normalised(source: str, text: str, carry: str, name: str = "norm") -> str:
    """CTEs ending in ``name(carry..., tokens)``: product tokens of a text column."""
    return f"""{name}0 AS (SELECT {carry}, list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda t: {SPLIT}) AS a FROM {source}),
{name}1 AS (SELECT {carry}, flatten(list_transform(a, lambda t: string_split(t, ' '))) AS a FROM {name}0),
{name}2 AS (SELECT {carry}, flatten(list_transform(a, lambda t: string_split({CAMEL}, ' '))) AS a FROM {name}1),
{name}3 AS (SELECT {carry}, list_transform(a, lambda t: lower({EDGES})) AS a FROM {name}2),
{name}4 AS (SELECT {carry}, list_filter(a, lambda t: len(t) >= 2 AND NOT regexp_matches(t, '{REJECT}')) AS a FROM {name}3),
{name} AS (SELECT {carry}, flatten(list_transform(a, lambda t: CASE WHEN {REPEATED} THEN [t, t] ELSE [t] END)) AS tokens FROM {name}4)"""


def without(tokens: str, words: Iterable[str], fold: bool = True) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))
    return f"list_filter({tokens}, lambda w: {'lower(w)' if fold else 'w'} NOT IN ({listed}))"


def bands_sql(freq: str, bands: dict, tops, odd: bool, word: str = "word") -> str:
    """The band summary straight from ranks."""
    cols = ["CAST(sum(count) AS BIGINT) AS total", 'count(*) AS "distinct"']
    cols += [f"CAST(coalesce(sum(count) FILTER (WHERE rk <= {k}), 0) AS BIGINT) AS top_{k}" for k in tops]
    for kind, cond in (("", "true"), ("odd_", "odd")) if odd else (("", "true"),):
        cols += [f"count(*) FILTER (WHERE count >= {n} AND {cond}) AS {kind}ge_{n}" for n in bands["ge"]]
        cols += [f"count(*) FILTER (WHERE count <= {n} AND {cond}) AS {kind}le_{n}" for n in bands["le"]]
    return f"""SELECT {', '.join(cols)} FROM (SELECT *, row_number() OVER (ORDER BY count DESC, {word}) AS rk,
      NOT regexp_matches({word}, '\\A[a-zA-Z]*\\z') AS odd FROM {freq})"""
