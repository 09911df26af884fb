"""Models level by level, language profiles and nested sets against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.models import levels
from shelfmark.models.levels import decode_paths, fit_levels
from shelfmark.operators import categories as C
from shelfmark.operators import languages as L
from shelfmark.operators import nested as N


def plain_models(rows, smoothing=1.0):
    """(prior, unseen, word counts) of each (parent, child)."""
    docs, words = Counter(), defaultdict(Counter)
    for tokens, path in rows:
        parts = path.split(" > ")
        nodes = ["", *(" > ".join(parts[: i + 1]) for i in range(len(parts)))]
        for parent, child in zip(nodes, [*nodes[1:], nodes[-1]], strict=True):
            docs[parent, child] += 1
            words[parent, child].update(tokens)
    return docs, words


def plain_path(tokens, docs, words, smoothing=1.0):
    """The best path by trying all of them."""
    children = defaultdict(list)
    for parent, child in docs:
        children[parent].append(child)

    def share(parent):
        known = set().union(*(words[parent, c] for c in children[parent]))
        scores = {}
        for c in children[parent]:
            mass = sum(words[parent, c].values()) + smoothing * (len(known) + 1)
            prior = math.log(docs[parent, c] / sum(docs[parent, k] for k in children[parent]))
            scores[c] = prior + sum(math.log((words[parent, c][t] + smoothing) / mass) for t in tokens)
        top = max(scores.values())
        total = top + math.log(sum(math.exp(s - top) for s in scores.values()))
        return {c: s - total for c, s in scores.items()}

    def search(node, score):
        for c, s in share(node).items():
            if c == node:
                yield round(score + s, 9), c
            else:
                yield from search(c, score + s)

    return min(search("", 0.0), key=lambda x: (-x[0], x[1]))


def test_decoded_paths_are_the_best_of_all(spark):
    rng = random.Random(3)
    paths = ["a", "a > b", "a > b > c", "a > d", "e > f > g > h", "e > f", "e > k", "m"]
    rows = [([rng.choice("stuvwxyz" if len(p) < 6 else "pqrstuv") for _ in range(rng.randint(0, 6))] + [p[-1]] * rng.randint(0, 2), p) for p in rng.choices(paths, k=150)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)] + [(900, ["never", "seen"], None), (901, [], None), (902, None, None)],
                               "id int, tokens array<string>, category string")
    models = fit_levels(df, "tokens")
    got = {r["id"]: (round(r["log_probability"], 6), r["prediction"]) for r in decode_paths(df, models, "id", "tokens", beam=50).collect()}
    docs, words = plain_models(rows)
    asked = {i: t for i, (t, _) in enumerate(rows)} | {900: ["never", "seen"], 901: [], 902: []}
    assert set(got) == set(asked)
    for i, tokens in asked.items():
        score, path = plain_path(tokens, docs, words)
        assert got[i][0] == pytest.approx(score, abs=1e-6) and got[i][1] == path


def test_children_are_numbered_like_level_local_classes(spark):
    df = spark.createDataFrame([(["x"], "b > z"), (["y"], "b > a"), (["y"], "b"), (["y"], "a")], "tokens array<string>, category string")
    nodes = {(r["parent"], r["child"]): r["target"] for r in fit_levels(df, "tokens").nodes.collect()}
    assert nodes["b", "b > a"] == 0 and nodes["b", "b > z"] == 1 and nodes["b", "b"] is None
    taxonomy = C.taxonomy_from_paths(df)
    local = C.index_children(df.withColumn("cat2", F.element_at(F.split("category", " > "), -1)), taxonomy, "b", "cat2").where("category like 'b > %'").collect()
    assert {r["category"]: r["target"] for r in local} == {"b > a": 0, "b > z": 1}


def test_a_narrow_beam_is_never_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id id", "split(text, ' ') tokens", "concat(lang, ' > ', source) category")
    models = fit_levels(docs, "tokens")
    one, wide = (dict(map(tuple, decode_paths(docs, models, "id", "tokens", beam=b).select("id", "log_probability").collect())) for b in (1, 8))
    assert one.keys() == wide.keys() and all(wide[i] >= one[i] - 1e-9 for i in one)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    profiles = L.language_profiles(docs.where("not held"), "text", "lang")
    found = L.detect_language(docs.where("held"), "doc_id", "text", profiles).where("language is not null").join(docs, "doc_id").collect()
    assert len(found) > 300 and sum(r["language"] == r["lang"] for r in found) / len(found) > 0.95


def test_ranked_ngrams_and_edges(spark):
    texts = ["Ab ab, c9", "", None, "12 34", "é", "x" * 50_000]
    rows = spark.createDataFrame([(i, t, "never") for i, t in enumerate(texts)], "id int, text string, language string")
    got = [r[0] for r in rows.select(L.ranked(L.character_ngrams(F.col("text")), 5)).collect()]

    def plain(text):
        words, grams = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(), Counter()
        for w in (f"_{w}_" for w in words):
            grams.update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1))
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))][:5]

    assert got == [plain(t) for t in texts]
    profiles = L.language_profiles(spark.createDataFrame([("ab abc", "p"), ("xyz", "q"), ("zz", None)], "text string, l string"), "text", "l")
    found = [(r["language"], r["distance"]) for r in L.detect_language(rows, "id", "text", profiles).orderBy("id").collect()]
    assert [f[0] for f in found] == ["p", None, None, None, "p", "q"] and found[1][1] is None


@pytest.fixture(scope="module")
def tree(spark):
    paths = ["a > b > c", "a > b > d", "a-x > b", "a > bb", "a b > c", "z"]
    return C.taxonomy_from_paths(spark.createDataFrame([(p,) for p in paths], "category string"))


def test_nested_sets_equal_the_path_expansions(spark, tree):
    nested = N.nested_sets(tree)
    counts = spark.createDataFrame([("a > b", 3), ("a > b > c", 4), ("a", 1), ("a-x > b", 7), ("nowhere", 9), ("z", 2)], "category string, count long")
    labels = counts.withColumnRenamed("category", "label")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert same(N.subtree_totals(nested, counts), C.taxonomy_counts(C.category_counts(labels), tree))
    assert same(N.leaf_totals(nested), C.leaf_counts(tree))
    assert same(N.ancestor_ids(nested), C.taxonomy_ancestors(tree))
    assert N.nested_sets(tree.limit(0)).count() == 0


def test_a_token_is_sent_once_for_all_categories_of_its_row(spark):
    asking = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b")], "id int, parent string")
    rows = spark.createDataFrame([(1, ["u", "v", "u"]), (2, ["v", "w"]), (None, ["u"]), (3, ["u"])], "id int, tokens array<string>")
    nodes = spark.createDataFrame([("a", "a > c", 0), ("a", "a", 1), ("b", "b > d", 2), ("e", "e > f", 3)], "parent string, child string, number long")
    weights = spark.createDataFrame(
        [("a", "u", [("a", 1.0), ("a > c", 2.0)]), ("b", "u", [("b > d", 3.0)]), ("b", "v", [("b > d", 4.0)]), ("e", "v", [("e > f", 9.0)])],
        "parent string, token string, children array<struct<child string, weight double>>")
    bags = levels._bags(rows, "id", "tokens")
    assert sorted((r["id"], sorted((b["token"], b["n"]) for b in r["bag"])) for r in bags.collect()) == [
        (1, [("u", 2), ("v", 1)]), (2, [("v", 1), ("w", 1)]), (3, [("u", 1)])]
    sums = levels._evidence(asking, bags, nodes, weights)
    # a category that a row has twice counts twice, as a join of rows would have it
    assert sorted(map(tuple, sums.collect())) == [(1, 0, 4.0), (1, 1, 2.0), (1, 2, 2 * (6.0 + 4.0)), (2, 2, 4.0)]


def test_carried_tokens_do_not_leave_their_row(spark, monkeypatch):
    """However many weights tasks carry, paths and scores are the same; a token that is carried is in no joined bag."""
    rng = random.Random(8)
    paths = ["a > b", "a > c", "d > e", "d > f", "g"]
    rows = [(i, p, [rng.choice("stuvwx") + p[-1 if rng.random() < 0.5 else 0] for _ in range(rng.randint(1, 12))]) for i, p in enumerate(rng.choices(paths, k=120))]
    df = spark.createDataFrame([*rows, (500, None, None), (501, None, []), (502, None, ["new"])], "id int, category string, tokens array<string>")
    models = fit_levels(df, "tokens")
    found = []
    for most in (0, 25, 1 << 20):
        monkeypatch.setattr(levels, "CARRIED", most)
        carried = levels._carried(models.weights)
        tokens = {r["token"] for r in carried.collect()}
        entries = sum(len(r["children"]) for r in models.weights.collect() if r["token"] in tokens)
        assert entries <= most and (len(tokens) > 0) == (most > 0)
        bags = {r["id"]: r for r in levels._coded(levels._bags(df, "id", "tokens"), carried).collect()}
        for i, _, own in rows:
            left = {b["token"]: b["n"] for b in bags[i]["bag"]}
            assert left == {t: own.count(t) for t in own if t not in tokens}
            assert sum(bags[i]["counts"]) + sum(left.values()) == len(own)
        found.append([(r[0], r[1], round(r[2], 9)) for r in decode_paths(df, models, "id", "tokens", beam=2).orderBy("id").collect()])
    assert len(found[0]) == 123 and found[0] == found[1] == found[2]
