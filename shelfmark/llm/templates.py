"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its number of tokens with its first ``depth`` tokens; a token with a
digit is a variable field from the start. What lines of at least ``min_docs`` different
texts share is a recurring template, and those lines are dropped:

* a line that is the same in so many texts, whatever its tokens;
* a line that is the same but for its variable fields, if at least ``constant`` of the
  tokens are fixed (else it generalises too much);
* among the other lines of a leaf, split once more at the first place where they
  disagree (a token that ``min_docs`` texts have there is a branch, all rarer ones are
  one branch): the tokens that at least half of the branch's lines have at each place,
  with variable fields elsewhere, under the same condition on fixed tokens.

Lines in exact copies of one text count once. A document more than half of whose words
stand in recurring lines is a copy rather than a carrier of boilerplate; it is left
whole, for document-level deduplication, which would not know an emptied copy. Lines are
separated by ``\n``; blanks at their ends and between tokens do not matter; blank lines
are never dropped. Equally common tokens: the greater one counts. Null texts stay null,
empty ones empty; repeated rows are treated alike; texts of any length are split whole;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import BLANKS, free_name, materialise, word_count

DEPTH, MIN_DOCS, CONSTANT = 4, 10, 0.5
FIELD = "<*>"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), FIELD).otherwise(token)


def _lines(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """(text_key, pos, tokens, leaf) of each line with a token."""
    # the key comes before the lines, so that it is not taken of the whole text for each of them
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text_key"), F.split(F.col(text_col), "\n").alias("lines"))
    rows = texts.select("text_key", F.posexplode("lines").alias("pos", "line"))
    # blank lines are told by the trimmed line: a condition on the tokens would be pushed below the split and do it twice
    rows = rows.where(_trimmed(F.col("line")) != "").select("text_key", "pos", F.split(_trimmed(F.col("line")), BLANKS).alias("tokens"))
    head = F.transform(F.slice("tokens", 1, depth), _masked)
    return rows.withColumn("leaf", F.xxhash64(F.size("tokens"), head))


def dropped_lines(
    docs: DataFrame, text_col: str = "text", *, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT
) -> DataFrame:
    """(text_key, dropped: positions of recurring lines, words: how many words they have) of each text with such lines."""
    lines = _lines(docs, text_col, depth)
    # leaves of too few texts cannot hold a recurring template
    leaves = lines.select("leaf", "text_key").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs)
    leaves = materialise(leaves.select("leaf"))
    held = materialise(lines.join(leaves, "leaf", "left_semi").distinct())

    held = held.withColumn("masked", F.transform("tokens", _masked))

    fixed_share = F.size(F.filter("masked", lambda x: x != FIELD)) >= F.size("masked") * F.lit(constant)
    same = _in_texts(held, ["leaf", "tokens"], min_docs)
    alike = _in_texts(held.where(fixed_share), ["leaf", "masked"], min_docs)
    plain = held.join(same, ["leaf", "tokens"], "left_semi").unionByName(held.join(alike, ["leaf", "masked"], "left_semi").select(*held.columns))
    plain = materialise(plain.select("text_key", "pos", F.size("tokens").alias("words")).distinct())

    rest = held.join(same, ["leaf", "tokens"], "left_anti").join(alike, ["leaf", "masked"], "left_anti").select(*held.columns)
    rest = materialise(_split(materialise(rest), depth, min_docs))
    votes = rest.select("leaf", "text_key", "masked").distinct().groupBy("leaf", "masked").agg(F.count("*").alias("votes"))
    places = (
        votes.select("leaf", "votes", F.posexplode("masked").alias("place", "token"))
        .groupBy("leaf", "place", "token").agg(F.sum("votes").alias("votes"))
        .groupBy("leaf", "place").agg(F.max(F.struct("votes", "token")).alias("most"), F.sum("votes").alias("all"))
    )
    fixed = F.when((F.col("most.votes") * 2 >= F.col("all")) & (F.col("most.token") != FIELD), F.col("most.token"))
    templates = (
        places.select("leaf", F.struct("place", fixed.alias("token")).alias("at"))
        .groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["token"]).alias("template"))
        .where(F.size(F.filter("template", lambda x: x.isNotNull())) >= F.size("template") * F.lit(constant))
    )
    fits = F.forall(F.zip_with("template", "tokens", lambda t, x: t.isNull() | (t == x)), lambda x: x)
    fitting = materialise(rest.join(materialise(templates), "leaf").where(fits).select("leaf", "text_key", "pos", F.size("tokens").alias("words")))
    general = fitting.join(_in_texts(fitting, ["leaf"], min_docs), "leaf", "left_semi").select("text_key", "pos", "words")
    return plain.unionByName(general).groupBy("text_key").agg(F.collect_list("pos").alias("dropped"), F.sum("words").alias("words"))


def _in_texts(lines: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The keys that lines of at least so many texts have; a frequent key is one number a text before it is shuffled."""
    return materialise(lines.select(*keys, "text_key").distinct().groupBy(*keys).count().where(F.col("count") >= least).select(*keys))


def _split(lines: DataFrame, depth: int, least: int) -> DataFrame:
    """Lines with the branch of their leaf as new leaf; branches of too few texts are left out."""
    cells = lines.select("leaf", "text_key", F.posexplode("masked").alias("place", "token")).where(F.col("place") >= depth)
    tokens = materialise(cells.distinct().groupBy("leaf", "place", "token").agg(F.count("*").alias("texts")))
    first = tokens.groupBy("leaf", "place").count().where("count > 1").groupBy("leaf").agg(F.min("place").alias("place"))
    branches = tokens.where(F.col("texts") >= least).join(first, ["leaf", "place"]).select("leaf", "place", F.col("token").alias("branch"))
    at = lines.join(materialise(first), "leaf", "left").withColumn("token", F.get("masked", F.col("place")))
    named = at.join(materialise(branches.select("leaf", F.col("branch").alias("token"), F.lit(True).alias("own"))), ["leaf", "token"], "left")
    leaf = F.xxhash64("leaf", F.when(F.col("own"), F.col("token")))
    out = named.withColumn("leaf", leaf).select(*lines.columns)
    return out.join(_in_texts(out, ["leaf"], least), "leaf", "left_semi")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with recurring lines taken out of their texts; all rows and columns stay."""
    key, dropped, words = (free_name(docs, c) for c in ("text_key", "dropped", "words"))
    # texts are dealt out by their key once, at any size, and not sorted; the hashed side has only line numbers
    found = materialise(dropped_lines(docs, text_col, **options)).toDF(key, dropped, words).hint("shuffle_hash")
    text = F.col(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(dropped), i)), "\n")
    carrier = F.col(dropped).isNotNull() & (2 * F.col(words) <= word_count(text))
    return (
        docs.withColumn(key, F.xxhash64(text)).join(found, key, "left")
        .withColumn(text_col, F.when(carrier, kept).otherwise(text)).select(*docs.columns)
    )


LINES_SQL = r"""
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
s AS (SELECT text, string_split(text, chr(10)) AS parts FROM t),
p AS (SELECT text, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
k AS (SELECT text, pos, string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS tokens FROM p),
m AS (SELECT text, pos, tokens, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END for x in tokens] AS masked FROM k WHERE tokens[1] <> ''),
l AS (SELECT *, len(tokens) AS n, masked[1:4] AS head FROM m),
held AS MATERIALIZED (SELECT l.* FROM l JOIN (SELECT n, head FROM l GROUP BY n, head HAVING count(DISTINCT text) >= 10) USING (n, head)),
same AS (SELECT tokens FROM held GROUP BY tokens HAVING count(DISTINCT text) >= 10),
alike AS (SELECT masked FROM held WHERE len(list_filter(masked, lambda x: x <> '<*>')) >= 0.5 * n GROUP BY masked HAVING count(DISTINCT text) >= 10),
rest AS MATERIALIZED (SELECT * FROM held WHERE tokens NOT IN (SELECT tokens FROM same) AND masked NOT IN (SELECT masked FROM alike)),
cells AS (SELECT n, head, text, unnest(masked) AS token, unnest(range(len(masked))) AS place FROM rest),
spread AS (SELECT n, head, place, token, count(DISTINCT text) AS texts FROM cells WHERE place >= 4 GROUP BY ALL),
firsts AS (SELECT n, head, min(place) AS place FROM (SELECT n, head, place FROM spread GROUP BY ALL HAVING count(*) > 1) GROUP BY n, head),
branch AS (
  SELECT r.*, CASE WHEN s.token IS NOT NULL THEN s.token END AS own FROM rest r LEFT JOIN firsts f USING (n, head)
  LEFT JOIN spread s ON s.n = r.n AND s.head = r.head AND s.place = f.place AND s.token = r.masked[f.place + 1] AND s.texts >= 10),
votes AS (SELECT n, head, own, masked, count(*) AS votes FROM (SELECT DISTINCT n, head, own, text, masked FROM branch) GROUP BY ALL),
spots AS (SELECT n, head, own, unnest(masked) AS token, unnest(range(len(masked))) AS place, votes FROM votes),
most AS (
  SELECT n, head, own, place, max({'v': votes, 't': token}) AS top, sum(votes) AS everyone
  FROM (SELECT n, head, own, place, token, sum(votes) AS votes FROM spots GROUP BY ALL) GROUP BY ALL),
tpl AS (
  SELECT n, head, own, list(CASE WHEN 2 * top.v >= everyone AND top.t <> '<*>' THEN top.t END ORDER BY place) AS template
  FROM most GROUP BY n, head, own),
good AS (SELECT * FROM tpl WHERE len(list_filter(template, lambda x: x IS NOT NULL)) >= 0.5 * n),
fit AS (
  SELECT b.n, b.head, b.own, text, pos FROM branch b JOIN good g ON g.n = b.n AND g.head = b.head AND g.own IS NOT DISTINCT FROM b.own
  WHERE len(list_filter(range(1, b.n + 1), lambda i: template[i] IS NOT NULL AND template[i] <> tokens[i])) = 0),
enough AS (SELECT n, head, own FROM fit GROUP BY ALL HAVING count(DISTINCT text) >= 10),
every AS (
  SELECT text, pos, n FROM held WHERE tokens IN (SELECT tokens FROM same) OR masked IN (SELECT masked FROM alike)
  UNION ALL SELECT text, pos, f.n FROM fit f JOIN enough e ON e.n = f.n AND e.head = f.head AND e.own IS NOT DISTINCT FROM f.own),
gone AS (SELECT text, list(pos) AS dropped, sum(n) AS words FROM every GROUP BY text),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS parts,
         CASE WHEN 2 * words <= len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')) THEN dropped ELSE [] END AS dropped
  FROM documents d LEFT JOIN gone ON d.text = gone.text)
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
       md5(array_to_string([parts[i] for i in range(1, len(parts) + 1) if NOT list_contains(coalesce(dropped, []), i - 1)], chr(10))) AS kept_md5
FROM cut"""
