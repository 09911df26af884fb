"""Stop-word lists and removal."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Word lists that decide which tokens the jobs keep.
EMPIRICAL = """
and all are an a at also any add after about actual allows allow around
be by but best back before between
can could come comes change choice choose
different difference differences due do does
each etc every even easy easily extra
for from free four
get got good give great
has had have help
in it its is item items including included includes into
just keep like left
make makes made more must making much most many might may
nbsp not non needs need new
of or on other our one over order off only out
product products perfect put quality right
so sure such some suitable
the this that than then two they through them their there too
very
with which what was were will when without would way want while well
you your yet
""".split()

BIGRAM = """
and are all any an a as at also about
be but by back
can color com
do design designed different
easy each
for from features free fit
get got great
has had have high how
its in is it item included includes into
keep like
made more most make may might
not new no non nbsp
or of our out one other only on
product products per package perfect please quality
so some size suitable set
the that to this these they their them there than time then
use used very
with which what was were will when weight
you your yes
""".split()

TOPIC = """
<int_>
and are all any an a as at also available about
be but by back buy been
can color com
do design designed different description
easy each etc
for from features free
get got great
has had have high how
its in is it item included includes into
keep like
made more most make may material might
not new no non nbsp now
or of our out one other only on original
product products per package perfect please quality
so some size suitable set
the that to this these they their them there than time then thing
use used very
with which what was were will when weight want without while
you your yes
""".split()

DICTIONARY = """
and are all any also available an a as at
be been being but because by
can do did doing from for get got
has had have having here how
its in is it if just made more most not none
out our only other ours or of
some such so same
the this that them those they these their top than theirs to too
until very
with will when which while we who whom what was were where why
your you yours
""".split()


def english() -> list[str]:
    """Spark's own English list, the default for word statistics."""
    return StopWordsRemover.loadDefaultStopWords("english")


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A stop-word list of one's own from a text file, one word a line; a few hundred words."""
    return [r["value"] for r in spark.read.text(path).distinct().orderBy("value").collect()]


def remove_stop_words(tokens: Column, words: Iterable[str], case_sensitive: bool = False) -> Column:
    """Drop stop words from a token array, keeping order and repeats."""
    if case_sensitive:
        stop = sorted(set(words))
        return F.filter(tokens, lambda t: ~t.isin(stop))
    stop = sorted({w.lower() for w in words})
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stop))
