"""Tokenising and normalising product text with native string expressions.

The normaliser keeps a document's tokens in one newline-separated string while it
rewrites them, so each rule is a single regular expression over the whole text
(inside generated code) instead of one call per token. Token characters never
include a newline, and no rule lets a match cross one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.measures import keeps_its_digits, measurement
from shelfmark.functions.paths import let

# Token alphabet and the shapes of tokens that are thrown away.
TOKEN_PATTERN = r"""[a-zA-Z0-9$%@\x{80}¢£¥°º½¾`.\-*×±µ"',/]{3,30}"""
REJECTED = (
    "[a-z]{2}[0-9]",
    "[aeiou]{5}",
    "[bcdfghjklmnpqrstvwxyz]{5}",
    "[0-9]{6}",
    "[0-9][a-z]+[0-9]",
    "[a-z][0-9]+[a-z]",
)
NOISE = (
    "[aeiou]{5,}",
    "[bcdfghjklmnpqrstvwxyz]{5,}",
    "[0-9]{5,}",
    "[0-9]+[a-z]+[0-9]+",
    "[a-z]+[0-9]+[a-z]+",
    r"\A(?:[a-z]+-)*[a-z]*[0-9]+(?:-[0-9]+)*(?:-[a-z]+)*\z",
)


def tokenize(text: Column) -> Column:
    """Runs of 3 to 30 product characters, case kept; NULL text has no tokens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def tokenize_words(text: Column) -> Column:
    """Lower-cased runs of ``\\w``; NULL text has no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), 0)


def tokenize_list(text: Column) -> Column:
    """Items of a list written with ``, / | : ;``, lower-cased and trimmed."""
    items = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[,/|:;]"), lambda t: t != "")
    return F.transform(items, lambda t: F.trim(t))


def clean_apostrophes(text: Column) -> Column:
    """Drop English contraction endings; two apostrophes are an inch mark."""
    marks = F.replace(text, F.lit("''"), F.lit('"'))
    return F.regexp_replace(marks, "'(?:(t)|s|d|ll|re|m|ve)", "$1")


def collapse(text: Column, marks: str) -> Column:
    """Squeeze repeats of any of the given punctuation marks."""
    return F.regexp_replace(text, rf"([{marks}])\1+", "$1")


# The rules below name the rare punctuation mark first, so that most positions fail
# on one character test. Each rule takes the character after the mark; ``(?!\G)`` keeps
# a mark from using the character that the match before it has taken.


def split_punctuation(text: Column) -> Column:
    """Put a space where hyphens, stops, commas and slashes join separate words."""
    out = F.regexp_replace(collapse(text, r"\-,."), r"(?!\G)-(?<=[a-zA-Z]-)([a-zA-Z])", " $1")
    out = F.regexp_replace(out, r"(?!\G)[.,*](?<=.[.,*])[.,*]*([^0-9\-\s])", " $1")
    out = F.regexp_replace(out, r"(?!\G)[.,](?<=[^0-9\-\n][.,])[.,]*(.)", " $1")
    return F.regexp_replace(out, r"(?!\G)/(?<=./)(..)", " $1")


def split_camel(text: Column, gap: str = " ") -> Column:
    """Put a gap before a capitalised word that follows two small letters."""
    return F.regexp_replace(text, r"[A-Z](?<=[a-z]{2}[A-Z])(?<!\G[a-z][A-Z])[a-z]", f"{gap}$0")


def clean_edges(text: Column) -> Column:
    """Strip punctuation from both ends of every line."""
    out = F.regexp_replace(text, r"(?m)(?=[,\-*:/.])(?:^[,\-*:/]+|(?:\.+[,\-*:/]*|[,\-*:/]+)$)", "")
    out = F.regexp_replace(out, r"""(?m)(?=['".])(?:^['"]*\.(?=[^0-9\n])|^['"]+)""", "")
    return F.regexp_replace(out, r"""(?m)['"](?<=[^0-9\n]['"])['"]*$""", "")


def keep_token(token: Column) -> Column:
    """At least two characters and none of the rejected shapes."""
    return (F.length(token) >= 2) & ~token.rlike("|".join(REJECTED))


def normalize_tokens(tokens: Column, emit: str = "published") -> Column:
    """Clean, split, lower-case and filter a token array.

    ``emit="published"`` repeats a digit token that is no measurement;
    ``emit="placeholder"`` follows a measurement by its ``<...>`` placeholder.
    """
    lines = F.array_join(F.coalesce(tokens, F.array().cast("array<string>")), "\n")
    split = split_punctuation(collapse(clean_apostrophes(lines), '"'))
    clean = F.lower(clean_edges(split_camel(F.translate(split, " ", "\n"), "\n")))
    if emit == "published":
        extra = lambda t: F.when(keeps_its_digits(t), F.array(t, t)).otherwise(F.array(t))
    elif emit == "placeholder":
        extra = lambda t: let(measurement(t), lambda m: F.when(
            m.startswith("<"), F.array(t, m)).otherwise(F.array(t)))
    else:
        raise ValueError("emit must be 'published' or 'placeholder'")

    def finish(line: Column) -> Column:
        kept = F.filter(F.split(line, "\n"), keep_token)
        return F.when(line.rlike("[0-9]"), F.flatten(F.transform(kept, extra))).otherwise(kept)

    return let(clean, finish)


def product_tokens(text: Column, emit: str = "published") -> Column:
    return normalize_tokens(tokenize(text), emit)


def drop_noise_tokens(tokens: Column) -> Column:
    """Keep tokens whose lower-case form has none of the noise shapes."""
    return F.filter(tokens, lambda t: ~F.lower(t).rlike("|".join(NOISE)))


def sorted_ngrams(tokens: Column, n: int = 2) -> Column:
    """Windows of ``n`` tokens with the words of each window in order."""
    if n == 2:
        def pairs(t: Column) -> Column:
            first, second = F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1)
            return F.zip_with(first, second, lambda x, y: F.concat_ws(" ", F.least(x, y), F.greatest(x, y)))

        windows = pairs
    else:
        def windows(t: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(t) - (n - 1)),
                lambda i: F.array_join(F.array_sort(F.slice(t, i, n)), " "),
            )

    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, windows(t)).otherwise(none))
