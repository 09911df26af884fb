"""The Jaccard join against all pairs compared in plain Python."""

import random
import re

import pytest

from shelfmark.llm.jaccard import jaccard_components, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """Each row's (id, set size, least id reachable)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)]
    rows, line = [], " ".join(rng.choices(vocab, k=9))
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not rows:
            text = " ".join(rng.choices(vocab, k=rng.randint(1, 90)))
        elif kind < 0.5:
            text = rng.choice(rows)[1] or ""
        else:  # a changed copy: single words, cut ends, another case
            words = (rng.choice(rows)[1] or "a b c d e f").split()
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words[rng.randint(0, 2) : len(words) - rng.randint(0, 2)] or ["x"])
            text = text.upper() if rng.random() < 0.2 else text
        rows.append((i, text + ("\n" + line if rng.random() < 0.3 else "")))
    return rows


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("block", [512, 3])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr("shelfmark.llm.jaccard.BLOCK", block)
    rows = corpus(seed=block)
    assert result(spark, rows) == brute(rows)


def test_nulls_blanks_repeats_and_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "ONE"), (5, "one two"), (6, "é Ö"), (7, "É Ö"),
        (8, long), (9, long + " tail"), (None, None), (10, "a a a a a a a a"), (11, "a a a a a"), (None, "alone and null here"),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_one_of_each_keeps_columns(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base, "x"), (1, base + " end", "y"), (1, base + " end", "y"), (None, base, "z"), (5, "other words", "x"), (6, None, "x"), (6, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.component) for r in kept.collect()) == [(1, "y"), (5, "x"), (6, "x"), (6, "x")]
