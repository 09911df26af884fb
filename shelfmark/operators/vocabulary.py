"""Word and value statistics.

Reports on "the k most frequent words" never rank the whole vocabulary in one
window. How many occurrences the top k carry, and how they spread over rank blocks,
depends only on how many words share each count, so those reports run on the count
spectrum: one row per distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import is_odd, is_placeholder, price_bucket
from shelfmark.operators.sizing import materialise

# Report bands, top-k sizes and rank blocks.
WORD_BANDS = {"ge": (1_000_000, 100_000, 10_000, 1_000), "le": (100, 10, 1)}
MAKER_BANDS = {"ge": (100_000, 10_000, 1_000), "le": (999, 100)}
VALUE_BANDS = {"ge": (10_000, 1_000), "le": (100, 10, 1)}
WORD_TOPS = (100, 1_000, 10_000, 20_000)
VALUE_TOPS = (100, 200, 500, 1_000)
OVERLAP_TOPS = (10_000, 20_000, 30_000, 40_000, 50_000)


def counts_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def term_freq(df: DataFrame, tokens: Column | str, out: str = "word") -> DataFrame:
    """Occurrences of every token."""
    return counts_by(df.select(F.explode(tokens).alias(out)), out)


def doc_freq(df: DataFrame, tokens: Column | str, out: str = "word") -> DataFrame:
    """Rows in which every token occurs."""
    return counts_by(df.select(F.explode(F.array_distinct(tokens)).alias(out)), out)


def top_k(freq: DataFrame, k: int | None, by: str = "count", word: str = "word", ascending: bool = False) -> DataFrame:
    """The k first rows by ``by``, ties in word order; without ``k`` all of them."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    ranked = freq.orderBy(order, F.col(word))
    return ranked if k is None else ranked.limit(k)


def count_spectrum(freq: DataFrame, word: str = "word") -> DataFrame:
    """Words (and odd words) per distinct count."""
    return freq.groupBy("count").agg(
        F.count(F.lit(1)).alias("words"), F.count_if(is_odd(F.col(word))).alias("odd_words")
    )


def _ranked_spectrum(spectrum: DataFrame) -> DataFrame:
    """The spectrum with the number of words that rank before each count.

    Distinct counts grow with the square root of the occurrences at most, so the one
    ordered window stays small.
    """
    higher = Window.orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return spectrum.withColumn("before", F.coalesce(F.sum("words").over(higher), F.lit(0)))


def vocab_bands(
    freq: DataFrame, bands: dict[str, Sequence[int]] = WORD_BANDS, tops: Sequence[int] = WORD_TOPS,
    word: str = "word", odd: bool = True,
) -> DataFrame:
    """One row: occurrences, distinct words, occurrences of the top k, words per count band."""
    count, words = F.col("count"), F.col("words")
    aggs = [F.sum(count * words).alias("total"), F.sum(words).alias("distinct")]
    for k in tops:
        taken = F.greatest(F.lit(0), F.least(words, F.lit(k) - F.col("before")))
        aggs.append(F.sum(count * taken).alias(f"top_{k}"))
    for kind, column in (("", words), *((("odd_", F.col("odd_words")),) if odd else ())):
        for n in bands["ge"]:
            aggs.append(F.sum(F.when(count >= n, column).otherwise(0)).alias(f"{kind}ge_{n}"))
        for n in bands["le"]:
            aggs.append(F.sum(F.when(count <= n, column).otherwise(0)).alias(f"{kind}le_{n}"))
    return _ranked_spectrum(count_spectrum(freq, word)).agg(*aggs)


def rank_share(freq: DataFrame, block: int = 5_000, top: int = 100_000, word: str = "word") -> DataFrame:
    """Percent of all occurrences in each block of ranks, most frequent first."""
    spectrum = _ranked_spectrum(count_spectrum(freq, word))
    starts = F.array(*[F.lit(s).cast("bigint") for s in range(0, top, block)])
    inside = F.greatest(
        F.lit(0),
        F.least(F.col("before") + F.col("words"), F.col("start") + block) - F.greatest("before", "start"),
    )
    last = F.col("before") + F.col("words")
    touched = F.filter(starts, lambda s: (s < last) & (s + block > F.col("before")))
    # every block is in the report, so the most frequent count also carries the empty ones
    blocks = F.when(F.col("before") == 0, starts).otherwise(touched)
    return (
        spectrum.withColumn("total", F.sum(F.col("count") * F.col("words")).over(Window.partitionBy()))
        .select("*", F.explode(blocks).alias("start"))
        .groupBy("start")
        .agg(F.round(100 * F.sum(F.col("count") * inside) / F.max("total"), 3).alias("share"))
    )


def token_totals(df: DataFrame, tokens: Column | str) -> DataFrame:
    """Distinct token lists, distinct tokens and tokens in all."""
    arrays = df.select((F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))
    lists = arrays.groupBy(F.sha2(F.array_join("tokens", "\x00"), 256), F.size("tokens").alias("size")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    whole = lists.agg(
        F.count(F.lit(1)).alias("distinct_lists"),
        F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).alias("tokens"),
    )
    words = term_freq(arrays, "tokens").agg(F.count(F.lit(1)).alias("distinct_tokens"))
    return whole.select("*", words.scalar().alias("distinct_tokens"))


def odd_tokens(freq: DataFrame, low: int, high: int | None = None, word: str = "word") -> DataFrame:
    """Odd words within a count range; without an upper bound, placeholders left out."""
    odd = freq.where(is_odd(F.col(word)) & (F.col("count") >= low))
    return odd.where(F.col("count") <= high) if high is not None else odd.where(~F.col(word).contains("<"))


def placeholder_tokens(freq: DataFrame, word: str = "word") -> DataFrame:
    return freq.where(is_placeholder(F.col(word)))


def information_gain(df: DataFrame, tokens: Column | str, category: Column | str = "category") -> DataFrame:
    """Information gain (natural log) and document frequency of every word.

    With n documents, n_c in category c, w holding the word and b of those in c, the
    absent half of the sum over all categories collapses, so only pairs that occur
    are ever built:  n * gain = sum_c [b ln(b/n_c) + (n_c-b) ln((n_c-b)/n_c)]
    + w ln(n/w) + (n-w) ln(n/(n-w)).

    Rows without a category are left out altogether: they count in no sum.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    category = F.col(category) if isinstance(category, str) else category
    df = df.where(category.isNotNull())
    totals = materialise(df.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("in_category")))
    size = totals.agg(F.sum("in_category")).scalar()
    pairs = counts_by(
        df.select(category.alias("category"), F.explode(F.array_distinct(tokens)).alias("word")), "word", "category"
    ).withColumnRenamed("count", "both")

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / F.col("in_category"))).otherwise(0.0)

    both, rest = F.col("both"), F.col("in_category") - F.col("both")
    n, w = F.col("n").cast("double"), F.col("count")
    words = (
        pairs.join(totals, "category")
        .groupBy("word")
        .agg(F.sum(part(both) + part(rest)).alias("split"), F.sum("both").alias("count"))
        .withColumn("n", size)
    )
    gain = F.col("split") + w * F.ln(n / w) + F.when(n > w, (n - w) * F.ln(n / (n - w))).otherwise(0.0)
    return words.select("word", (gain / n).alias("gain"), "count")


def topk_overlap(gains: DataFrame, tops: Sequence[int] = OVERLAP_TOPS) -> DataFrame:
    """How many words are in both the top k by gain and the top k by count."""
    rounded = gains.select("word", "count", F.round("gain", 9).alias("gain"))
    deepest = max(tops)

    def ranked(by: str) -> DataFrame:
        order = Window.orderBy(F.col(by).desc(), F.col("word"))
        return top_k(rounded, deepest, by).select("word", F.row_number().over(order).alias(f"by_{by}"))

    worst = F.greatest("by_gain", "by_count")
    both = ranked("gain").join(ranked("count"), "word")
    hits = both.agg(*[F.count_if(worst <= k).alias(f"k{k}") for k in tops])
    return hits.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("overlap")) for k in tops
    ])))


def common_words_by_category(
    df: DataFrame, tokens: Column | str, category: str, k: int | None = 19 * 50
) -> DataFrame:
    """The k most frequent (word, category) pairs among letters-only tokens."""
    pairs = df.select(category, F.explode(tokens).alias("word")).where(~is_odd(F.col("word")))
    ranked = counts_by(pairs, "word", category).orderBy(F.desc("count"), "word", category)
    return ranked if k is None else ranked.limit(k)


def price_counts(df: DataFrame, price: str, *by: str) -> DataFrame:
    """Rows per price band, optionally per category."""
    return counts_by(df.select(*by, price_bucket(F.col(price)).alias("price")), *by, "price")


def price_shares(counts: DataFrame, *by: str) -> DataFrame:
    """Percent of all rows in each price band, from ``price_counts`` by at least these keys."""
    total = counts.agg(F.sum("count")).scalar()
    summed = counts.groupBy(*by, "price").agg(F.sum("count").alias("count"))
    return summed.select(*by, "price", F.round(F.col("count") / total * 100, 6).alias("fraction"))


def price_distribution(df: DataFrame, price: str, *by: str) -> DataFrame:
    """Percent of all rows in each price band, optionally per category."""
    return price_shares(price_counts(df, price, *by), *by)


def shared_topic_terms(topics: DataFrame, n: int = 3, terms: str = "terms") -> DataFrame:
    """Terms that describe at least ``n`` topics."""
    return counts_by(topics.select(F.explode(terms).alias("term")), "term").where(F.col("count") >= n)
