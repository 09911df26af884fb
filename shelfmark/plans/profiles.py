"""Vocabulary and attribute profiles: named report tables per job.

Each profile counts once, writes the counts to the scratch folder and derives its
reports from them. Profiles run over all rows; ``cap`` samples so many of each
category, by the repeatable random key (``order_key``) that ``order`` names. ``k`` is the
length of the ranked reports, None for whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.stopwords import BIGRAM, DICTIONARY, EMPIRICAL, english, remove_stop_words
from shelfmark.functions.text import clean_material, text_of
from shelfmark.functions.tokens import drop_noise_tokens, product_tokens, sorted_ngrams, tokenize_list, tokenize_words
from shelfmark.operators import vocabulary as V
from shelfmark.operators.attributes import explode_clean
from shelfmark.operators.sampling import stratified_cap
from shelfmark.operators.sizing import materialise

Reports = dict[str, DataFrame]


def _rows(df: DataFrame, keys: Sequence[str], cap: int | None, order: str | None) -> DataFrame:
    """All rows, or with a cap the first ones of each category by ``order``."""
    if cap is None:
        return df
    if order is None:
        raise ValueError("a cap needs the name of an order key")
    return stratified_cap(df, keys, cap, order)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Documents per normalised word."""
    return V.doc_freq(df, product_tokens(F.col(text)))


def word_profile(
    df: DataFrame, text: str, order: str | None = None, cap: int | None = None, keys: Sequence[str] = ("cat1", "cat2"), k: int | None = 200,
) -> Reports:
    """Word statistics of a name or description column."""
    freq = materialise(word_counts(_rows(df, keys, cap, order), text))
    return {
        "shares": V.rank_share(freq),
        "bands": V.vocab_bands(freq),
        "most_common": V.top_k(freq, k),
        "least_common": V.top_k(freq, k, ascending=True),
        "odd_outliers": V.top_k(V.odd_tokens(freq, 1, 5), k),
        "odd_common": V.top_k(V.odd_tokens(freq, 1), k),
    }


def bigrams(text: Column) -> Column:
    return sorted_ngrams(remove_stop_words(product_tokens(text), BIGRAM, case_sensitive=True))


def bigram_profile(
    df: DataFrame, text: str, order: str | None = None, cap: int | None = None, keys: Sequence[str] = ("cat1", "cat2"), k: int | None = 1_000,
) -> Reports:
    """Statistics of order-free word pairs."""
    freq = materialise(V.term_freq(_rows(df, keys, cap, order), bigrams(F.col(text)), "bigram"))
    return {
        "shares": V.rank_share(freq, word="bigram"),
        "bands": V.vocab_bands(freq, word="bigram"),
        "most_common": V.top_k(freq, k, word="bigram"),
    }


def gain_profile(
    df: DataFrame, text: str, order: str | None = None, cap: int | None = None, keys: Sequence[str] = ("cat1", "cat2"), k: int | None = 200,
) -> Reports:
    """Information gain of words about the category, and how it agrees with frequency."""
    gains = materialise(V.information_gain(_rows(df, keys, cap, order), product_tokens(F.col(text)), F.concat_ws(" > ", *keys)))
    return {
        "most_informative": V.top_k(gains, k, "gain"),
        "least_informative": V.top_k(gains, k, "gain", ascending=True),
        "most_common": V.top_k(gains, k),
        "overlap": V.topk_overlap(gains),
    }


def stop_word_profile(df: DataFrame, text: str, order: str | None = None, cap: int | None = None, k: int | None = 19 * 50) -> DataFrame:
    """Frequent plain words per level-1 category once known stop words are gone."""
    words = remove_stop_words(product_tokens(F.col(text)), EMPIRICAL)
    return V.common_words_by_category(_rows(df, ["cat1"], cap, order), words, "cat1", k)


def plain_word_profile(df: DataFrame, text: Column, stop_words: Sequence[str] | None = None, k: int | None = 900) -> Reports:
    """Plain ``\\w+`` words of whole records without stop words, by default Spark's English ones."""
    kept = remove_stop_words(tokenize_words(text), english() if stop_words is None else stop_words)
    words = df.select(kept.alias("tokens"))
    return {"totals": V.token_totals(words, "tokens"), "most_common": V.top_k(V.term_freq(words, "tokens"), k)}


def dictionary(df: DataFrame, texts: Sequence[str], order: str | None = None, cap: int | None = None, key: str = "cat1") -> DataFrame:
    """Dictionary words with their counts: stop words and noise left out."""
    rows = _rows(df.withColumn("__text", text_of(*texts)), [key], cap, order)
    tokens = remove_stop_words(product_tokens(F.col("__text")), DICTIONARY)
    return V.term_freq(rows, drop_noise_tokens(tokens))


def dictionary_profile(df: DataFrame, texts: Sequence[str], order: str | None = None, cap: int | None = None, k: int | None = 200) -> Reports:
    freq = materialise(dictionary(df, texts, order, cap))
    return {
        "bands": V.vocab_bands(freq, tops=()),
        "measurements": V.top_k(V.placeholder_tokens(freq), k),
        "odd_outliers": V.top_k(V.odd_tokens(freq, 1, 5), k),
        "odd_common": V.top_k(V.odd_tokens(freq, 1), k),
    }


def _by_category(pairs: DataFrame, category: str, k: int | None) -> DataFrame:
    ordered = pairs.orderBy(F.desc("count"), category, "word")
    return ordered if k is None else ordered.limit(k)


def manufacturer_profile(df: DataFrame, name: str = "manufacturer", category: str = "cat1", k: int | None = 200) -> Reports:
    pairs = materialise(V.counts_by(df.select(F.lower(name).alias("word"), category), category, "word"))
    freq = materialise(pairs.groupBy("word").agg(F.sum("count").alias("count")))
    return {
        "shares": V.rank_share(freq),
        "bands": V.vocab_bands(freq, V.MAKER_BANDS, tops=(), odd=False),
        "most_common": V.top_k(freq, k),
        "by_category": _by_category(pairs, category, k),
    }


def _value_profile(values: DataFrame, category: str, k: int | None) -> Reports:
    """Reports on a long table of (category, word) values."""
    pairs = materialise(V.counts_by(values, category, "word"))
    freq = materialise(pairs.groupBy("word").agg(F.sum("count").alias("count")))
    return {
        "bands": V.vocab_bands(freq, V.VALUE_BANDS, V.VALUE_TOPS, odd=False),
        "most_common": V.top_k(freq, k),
        "least_common": V.top_k(freq, k, ascending=True),
        "by_category": _by_category(pairs, category, k),
    }


def material_profile(df: DataFrame, material: str = "material", category: str = "cat1", k: int | None = 200) -> Reports:
    items = tokenize_list(clean_material(F.col(material)))
    known = df.where(F.col(material).isNotNull())
    return _value_profile(known.select(category, F.explode(items).alias("word")), category, k)


def colour_profile(df: DataFrame, colour: str = "color", category: str = "cat1", k: int | None = 200) -> Reports:
    return _value_profile(explode_clean(df.select(category, colour), colour), category, k)


def demographics_profile(df: DataFrame, category: str = "cat1", fields: Sequence[str] = ("gender", "ageGroup", "adult")) -> Reports:
    """Rows per value of each field, over all rows and per category; the rows are counted once, the rest are sums."""
    counts = materialise(V.counts_by(df, category, *fields))
    out: Reports = {}
    for field in fields:
        out[field] = counts.groupBy(field).agg(F.sum("count").alias("count"))
        out[f"{field}_by_category"] = counts.groupBy(category, field).agg(F.sum("count").alias("count"))
    return out


def price_profile(df: DataFrame, price: str = "dollarPrice", category: str = "cat1") -> Reports:
    counts = materialise(V.price_counts(df, price, category))
    return {
        "overall": V.price_shares(counts).orderBy("price"),
        "by_category": V.price_shares(counts, category).orderBy("price", F.desc("fraction"), category),
    }
