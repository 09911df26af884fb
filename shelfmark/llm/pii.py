"""Personal data by weak supervision.

Candidates are spans of the base patterns and of looser ones. Labelers vote on each:
its shape, a gazetteer, words before it, what it touches. A vote is for, against or
abstaining. Expectation-maximisation over the counts of vote patterns estimates how
often each labeler is right and how likely each pattern is personal data; a logistic
span classifier, trained with these likelihoods as weights, then decides on all
candidates by votes, kind and length. Looser candidates with a probability of at least
``CUT`` are added; spans of the base patterns always stay.

Votes are columns and patterns are counted by Spark: their number is bounded by the
labelers (3 to the power of 5 per kind), whatever the number of texts, and so are
the classifier's training rows. Counts cover all candidates of all different texts.

Spans are half-open and in code points. Null and empty texts have none; without any
candidate there is no model and nothing to add. Rows with equal texts have equal spans;
ids, null or repeated, play no part in the search.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.spans import digest, located, per_document, without_overlaps
from shelfmark.llm.tables import materialise

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["name", "mailbox", "number"]
CUT = 0.7
ROUNDS = 30

# The base patterns, without the starts that cannot begin a leftmost match and so without their cost.
# Repeated groups are possessive: nothing follows that would take anything back, and a very long run needs no stack.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0),
    "ip": (r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", 0),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0),
}
LOOSE_PATTERNS = {
    "name": (r"\b[A-Z][a-z]{1,20}(?:\x20[A-Z]\.)?\x20[A-Z][a-z]{1,20}\b", 0),
    "mailbox": (r"\b[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}", 0),
    "number": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])", 0),
}
# The gazetteers.
FIRST_NAMES = (
    "Anna Maria Marie Sophie Emma Laura Julia Sarah Lisa Eva Elena Carmen Lucia Paula Claire Camille Alice Jane Mary Susan "
    "John James Robert Michael David Thomas Peter Paul Daniel Martin Jan Hans Karl Max Jose Juan Carlos Luis Antonio Jean Pierre Louis Hugo Omar Ali Wei"
).split()
DOMAINS = "com org net edu gov io co de fr es uk eu ch at it nl info".split()
# Words before a span that speak for it or against it.
FOR_WORDS = r"(?i)\b(?:e-?mail|mail|contact|write to|tel|phone|call|mobile|fax|card|visa|account|iban|from ip|ip|address|name|mr|mrs|ms|dr|herr|frau|signed|by)\b[^\n]{0,20}$"
AGAINST_WORDS = r"(?i)\b(?:version|release|chapter|section|figure|table|isbn|order|invoice|page|line|equation|build)\b[^\n]{0,20}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """The base patterns' own checks."""
    n = F.length(_digits(match))
    return (
        F.when(kind == "ip", F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255)))
        .when(kind == "card", F.when((n >= 13) & (n <= 19), _luhn(_digits(match))).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(True)
    )


def _vote(for_it: Column, against: Column) -> Column:
    return F.when(for_it, 1).when(against, -1).otherwise(0)


def _votes() -> dict[str, Column]:
    """The labelers, each a column of 1, -1 or 0."""
    kind, match, n = F.col("kind"), F.col("match"), F.length(_digits(F.col("match")))
    first = F.split(match, " ")[0]
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    numeric = kind.isin("card", "phone", "number")
    return {
        "shape": _vote(
            F.when(kind == "name", F.lit(False)).when(kind == "number", (n >= 9) & (n <= 13)).otherwise(True),
            F.when(kind == "number", (n < 8) | match.rlike(r"^(?:19|20)[0-9]{2}[-/.\x20][0-9]{1,2}[-/.\x20][0-9]{1,2}$")).otherwise(False)),
        "gazetteer": _vote(
            F.when(kind == "name", first.isin(FIRST_NAMES)).when(kind.isin("email", "mailbox"), domain.isin(DOMAINS)).otherwise(False),
            F.when(kind == "name", ~first.isin(FIRST_NAMES)).otherwise(False)),
        "context": _vote(F.col("before").rlike(FOR_WORDS), F.col("before").rlike(AGAINST_WORDS)),
        "border": _vote(F.lit(False), F.col("before").rlike(r"[A-Za-z0-9_/#]$") | F.col("after").rlike("[A-Za-z0-9_/]")),
        "variety": _vote(
            F.when(numeric, F.size(F.array_distinct(F.split(_digits(match), ""))) >= 5).otherwise(False),
            F.when(numeric, F.size(F.array_distinct(F.split(_digits(match), ""))) <= 2).otherwise(False)),
    }


LABELERS = ["shape", "gazetteer", "context", "border", "variety"]


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """How likely each (kind, votes) is personal data, by expectation-maximisation over counted patterns.

    Each labeler has, for data and for anything else, a distribution over its three votes;
    each kind has its own share of data. Starts from the balance of votes.
    """
    likely = {(k, v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        share, table = {}, {}
        for kind, votes, n in patterns:
            p = likely[kind, votes]
            a, b = share.get(kind, (1.0, 2.0))
            share[kind] = (a + p * n, b + n)
            for labeler, vote in enumerate(votes):
                cell = table.setdefault(labeler, {(s, v): 1.0 for s in (0, 1) for v in (-1, 0, 1)})
                cell[1, vote] += p * n
                cell[0, vote] += (1 - p) * n
        for kind, votes, _ in patterns:
            a, b = share[kind]
            odds = math.log(a / (b - a))
            for labeler, vote in enumerate(votes):
                if vote:
                    cell = table[labeler]
                    # votes count by how they tell data from the rest among those cast
                    cast = [cell[s, 1] + cell[s, -1] for s in (0, 1)]
                    odds += math.log(cell[1, vote] / cast[1]) - math.log(cell[0, vote] / cast[0])
            likely[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return likely


def _features(kinds: list[str]) -> list[Column]:
    votes = [(F.col(c) == v).cast("double") for c in LABELERS for v in (1, -1)]
    return votes + [(F.col("kind") == k).cast("double") for k in kinds] + [F.least(F.col("length") / 20, F.lit(2)).cast("double")]


def scored(candidates: DataFrame, kinds: list[str]) -> DataFrame:
    """The candidates with ``probability`` from the trained span classifier; 0 without candidates."""
    voted = candidates.select("*", *(c.alias(n) for n, c in _votes().items()), F.length("match").alias("length"))
    counted = materialise(voted.groupBy("kind", *LABELERS, "length").agg(F.count("*").alias("n")))
    by_votes = counted.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect()  # at most 3^5 a kind
    patterns = sorted((r["kind"], tuple(r[c] for c in LABELERS), r["n"]) for r in by_votes)
    if not patterns:
        return voted.withColumn("probability", F.lit(0.0))
    likely = reliabilities(patterns)
    rows = candidates.sparkSession.createDataFrame(
        [(k, *v, float(p)) for (k, v), p in likely.items()], ", ".join(["kind string", *(f"{c} int" for c in LABELERS), "p double"]))
    rows = counted.join(rows, ["kind", *LABELERS]).select(
        array_to_vector(F.array(*_features(kinds))).alias("features"),
        F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("weight")))).alias("x"),
    ).select("features", "x.*")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(materialise(rows))
    terms = zip(fitted.coefficients.toArray().tolist(), _features(kinds), strict=True)
    odds = sum((F.lit(w) * f for w, f in terms), F.lit(float(fitted.intercept)))
    return voted.withColumn("probability", 1 / (1 + F.exp(-odds)))


def personal_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, kind, start, end) of all personal data in all different texts."""
    found = located(docs, text_col, PATTERNS | LOOSE_PATTERNS)
    found = materialise(found.where(_valid(F.col("kind"), F.col("match"))))
    base, loose = found.where(F.col("kind").isin(BASE)), found.where(F.col("kind").isin(LOOSE))
    candidates = base.unionByName(materialise(without_overlaps(loose, base)))
    kept = scored(candidates, BASE + LOOSE).where(F.col("kind").isin(BASE) | (F.col("probability") >= CUT))
    return kept.select("text_key", "kind", "start", "end")


def personal_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per document."""
    found = materialise(digest(personal_spans(docs, text_col), BASE + LOOSE, BASE, by_kind=True))
    return per_document(docs, id_col, text_col, found, BASE)
