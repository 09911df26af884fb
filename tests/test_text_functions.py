"""Golden values for the text functions (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import measures, paths, stopwords, text, tokens


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


GOLDEN = {
    "split_punctuation": (tokens.split_punctuation, {
        "abc.def..ghi.2.0": "abc def ghi 2.0",
        "2..0 2,,0 1--2": "2.0 2,0 1-2",
        "0.1-0.3": "0.1-0.3",
        "aa-bb--cc-3-4": "aa bb cc-3-4",
        ".1.,2": ".1  2",
        "a,,b,3,0": "a b 3,0",
    }),
    "split_camel": (tokens.split_camel, {
        "2.54cmIncludes": "2.54cm Includes",
        "MaterialColorBlackSize45*40cmW": "Material Color Black Size45*40cmW",
        "SizingSizeSmallMediumLargeX": "Sizing Size Small Medium LargeX",
        "glovesAdjustable": "gloves Adjustable",
        "bearingwhich": "bearingwhich",
        "UPPER": "UPPER",
        "aBcDeeFFggHH": "aBcDeeFFggHH",
        "displayAMD": "displayAMD",
        "110PresetNOVision": "110PresetNOVision",
    }),
    "clean_edges": (tokens.clean_edges, {
        "*,-abc..*--": "abc",
        ".556,": ".556",
        ",556*-": "556",
        "-556.": "556",
        "'\".abc'": "abc",
        "5'": "5'",
        "ab'\"": "ab",
        "abc-.": "abc-",
        ",.-": "",
    }),
    "clean_apostrophes": (tokens.clean_apostrophes, {
        "don't": "dont",
        "men's": "men",
        "5''": '5"',
        "'door": "oor",
        "we'll": "we",
        "they've'": "they'",
        "'''s": '"',
    }),
    "measurement": (measures.measurement, {
        "3.42×2.55×2.55in": "<3d_float_inch>",
        ".50×1.18in": ".50×1.18in",
        "3.73×2.16×1.7": "<3d_float_>",
        "7.00×6.00×6.00cm": "<3d_float_cm>",
        "900-1,100": "<int_range_>",
        '16"x22"': '16"x22"',
        "1,100,000": "<int_>",
        "25m/s": "<int_m/s>",
        "5'4in": "5'4in",
        '23.4"W': "<float_inch>",
        "212ºF": "<int_ºf>",
        '29.25"Length': "<float_inch>",
        "12cm": "<int_cm>",
        "1.5-2oz": "<float_range_oz>",
        "45*40cm": "<2d_int_cm>",
        "10watts": "<int_watt>",
        "7cmwide": "<int_cm>",
        "3quots": "<int_inch>",
        "2,5abcdefghijk": "25abcdefghijk",
        "plain": "plain",
        "5%": "<int_%>",
    }),
    "clean_json": (text.clean_json, {
        '"{""a"":""x""}"': '{"a":"x"}',
        '"{""a"":""""}"': '{"a":""}',
    }),
    "clean_material": (text.clean_material, {"100% Cotton": "Cotton", "80%wool 20% silk": "wool  silk"}),
    "strip_marks": (text.strip_marks, {"men's, tops": "mens tops"}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    fn, cases = GOLDEN[name]
    assert dict(zip(cases, apply(spark, fn, list(cases)))) == cases


def test_normaliser_matches_rule_by_rule_reading(spark):
    cases = {
        "don't stop": ["dont", "stop"],
        "MaterialColorBlack bb-cc.dd": ["material", "color", "black", "bb", "cc", "dd"],
        # a digit token that is no measurement is repeated, a measurement is not
        "5'4in 12cm 1,100": ["5'4in", "5'4in", "12cm", "1,100"],
        "abc123 aeiouaeiou 1234567 3x4cm": [],
        "nice (blue) a": ["nice", "blue"],
        "ends. .dots 'quoted'": ["ends", "dots", "quoted"],
        "x": [],
    }
    got = apply(spark, tokens.product_tokens, list(cases))
    assert dict(zip(cases, got)) == cases


def test_normaliser_placeholders_follow_their_token(spark):
    got = apply(spark, lambda c: tokens.product_tokens(c, "placeholder"), ["lamp 12cm 45*40cm 5'4in"])
    assert got == [["lamp", "12cm", "<int_cm>", "45*40cm", "<2d_int_cm>", "5'4in"]]


def test_normaliser_equals_token_at_a_time(spark):
    """The whole-text rewrite gives what rewriting each token alone gives."""
    words = ["a.,5", ".5x", "'t", "aa-bb", "x/yy", "it''s", "..a", "-3.", "Ab.Cd,ef", "wordOne", "9,0.", "'\"", "a'", ".9'"]
    pairs = [[a, b] for a in words for b in words]
    whole = apply(spark, tokens.normalize_tokens, pairs, "array<string>")
    single = {w: r for w, r in zip(words, apply(spark, tokens.normalize_tokens, [[w] for w in words], "array<string>"))}
    assert whole == [single[a] + single[b] for a, b in pairs]


def test_empty_and_null_text(spark):
    assert apply(spark, tokens.product_tokens, [None, ""]) == [[], []]
    assert apply(spark, tokens.tokenize_words, [None, "A b_1"]) == [[], ["a", "b_1"]]
    assert apply(spark, tokens.tokenize_list, ["Red, Blue|| Green/x"]) == [["red", "blue", "green", "x"]]


def test_long_runs_are_cut_at_thirty(spark):
    assert [len(t) for t in apply(spark, tokens.tokenize, ["x" * 65])[0]] == [30, 30, 5]


def test_sorted_ngrams(spark):
    got = apply(spark, tokens.sorted_ngrams, [["c", "a", "b"], ["c"], []], "array<string>")
    assert got == [["a c", "a b"], [], []]
    assert apply(spark, lambda c: tokens.sorted_ngrams(c, 3), [["c", "a", "b"]], "array<string>") == [["a b c"]]


def test_stop_words(spark):
    got = apply(spark, lambda c: stopwords.remove_stop_words(c, ["and"]), [["And", "x", "x"]], "array<string>")
    assert got == [["x", "x"]]
    got = apply(spark, lambda c: stopwords.remove_stop_words(c, ["and"], True), [["And", "and"]], "array<string>")
    assert got == [["And"]]
    assert (len(set(stopwords.EMPIRICAL)), len(set(stopwords.BIGRAM))) == (137, 103)
    assert (len(set(stopwords.TOPIC)), len(set(stopwords.DICTIONARY))) == (115, 83)


def test_drop_noise_tokens(spark):
    got = apply(spark, tokens.drop_noise_tokens,
                [["lamp", "AEIOUA", "12345", "1a2", "a1b", "abc-12", "12-3-x", "ab-cd"]], "array<string>")
    assert got == [["lamp", "ab-cd"]]


def test_price_bucket(spark):
    cases = {0.0: 0, 0.4: 1, 3.0: 4, 15.0: 16, 47.0: 50, 940.0: 900, 9400.0: 9000, 55000.0: 60000,
             200000.0: 1e6, 2e6: 2e6, -3.0: 1, None: None}
    assert dict(zip(cases, apply(spark, text.price_bucket, list(cases), "double"))) == cases


def test_paths(spark):
    rows = spark.createDataFrame([("a", "b", "", ""), ("a", None, "c", None), (None, None, None, None)],
                                 "a string, b string, c string, d string")
    assert [r.p for r in rows.select(paths.label_path(["a", "b", "c", "d"]).alias("p")).collect()] == ["a > b", "a > c", ""]
    row = spark.createDataFrame([("x > y",)], "v string").select(*paths.path_levels(F.col("v"), 3)).first()
    assert tuple(row) == ("x", "y", None)
    assert apply(spark, paths.path_depth, ["a > b > c", None]) == [3, None]
    assert apply(spark, lambda c: paths.path_prefix(c, 2), ["a > b > c", "a"]) == ["a > b", None]
    assert apply(spark, paths.parent_path, ["a > b > c", "a"]) == ["a > b", ""]
    got = apply(spark, lambda c: paths.path_prefixes(c), ["a > b"])
    assert [tuple(r) for r in got[0]] == [(1, "a"), (2, "a > b")]


def test_odd_words(spark):
    assert apply(spark, text.is_odd, ["abc", "a1", "", "é"]) == [False, True, False, True]
    assert apply(spark, text.is_placeholder, ["<int_cm>", "int"]) == [True, False]
