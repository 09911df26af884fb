"""The template tree on planted lines, and against its SQL."""

import duckdb

from shelfmark.llm.queries import QUERIES, SQL
from shelfmark.llm.templates import _lines, drop_recurring_lines

SF = "/root/testdata/sf0.01"


def filler(i, n=30):
    return " ".join(f"w{(i * 37 + k * k) % 997}x" for k in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def test_variable_fields_and_copies(spark):
    rows = [(i, f"{filler(i)}\nPage {i} of the printed report, item {i * 3}\n{filler(i + 500)}", "a", i) for i in range(14)]
    rows += [(100 + i, "exact copy of one line\nand of another one", "a", 1) for i in range(30)]  # copies count once
    rows += [(200 + i, f"The and of it {filler(i + 900)}", "a", 1) for i in range(20)]  # one leaf, nothing in common
    rows += [(300, None, "a", 1), (301, "", None, 1), (None, "\n \n", "a", None), (302, "Page 7 of the printed report, item 21", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped string, text_key int")
    out = drop_recurring_lines(df)
    assert out.columns == df.columns
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = [(i, t if i is None or i >= 14 else f"{filler(i)}\n{filler(i + 500)}", *rest) for i, t, *rest in rows]
    assert got == sorted(want, key=repr)  # 302 is nothing but the line: left whole
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(SQL["op6_line_templates"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op6_line_templates"](spark, SF).collect())
    assert got == want and sum(r[2] for r in got) > 20


def test_no_recurring_line_hides_another_of_its_leaf(spark):
    """Identical lines that share a leaf in equal and in unequal shares, lines of numbers, and several templates a leaf."""
    rows = []
    for i in range(600):  # three lines, 200 texts each
        rows.append((i, f"{filler(i)}\nall rights of this {('page', 'site', 'book')[i % 3]} are reserved {('today', 'here', 'always')[i % 3]}"))
    for i in range(600, 1200):  # 80 % and 20 %
        rows.append((i, f"{filler(i)}\nprinted on paper by the {'old' if i % 5 else 'new'} press of the town"))
    for i in range(1200, 1230):
        rows.append((i, f"{filler(i)}\n12 34 56 78"))
    letters = str.maketrans("0123456789", "abcdefghij")
    for i in range(1230, 1290):  # two templates with a variable word each
        name = f"n{i}".translate(letters)
        rows.append((i, f"{filler(i)}\nsent by the post {'from' if i % 2 else 'with'} {name} {'on a day in spring' if i % 2 else 'to some other house'}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r["text"] for r in drop_recurring_lines(df).collect() if "\n" in r["text"]]
    assert left == []


def test_ties_long_texts_and_lines(spark):
    long = "\n".join(f"{filler(i, 12)}" for i in range(3_000))
    rows = [(i, f"{filler(i)}\none two three four {'x' if i % 2 else 'y'} six seven") for i in range(18)] + [(100, long + "\nfoot note of the whole edition"), (101, "w " * 200_000)]
    rows += [(200 + i, f"{filler(i + 90)}\nfoot note of the whole edition") for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == long and out[101] == "w " * 200_000 and all("\n" not in out[200 + i] for i in range(12))
    assert all("\n" in out[i] for i in range(18))  # nine texts each, two tokens as common as each other: too few for a branch, no majority beyond


def test_each_line_is_split_once(spark):
    df = spark.createDataFrame([(1, " a  b\n\n \t\n1 c ")], "doc_id long, text string")
    lines = _lines(df, "text", 4)
    assert sorted((r["pos"], r["tokens"]) for r in lines.collect()) == [(0, ["a", "b"]), (3, ["1", "c"])]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim(") == 1
    assert plan.index("xxhash64(text") > plan.index("Generate posexplode")  # below: once a text, not once a line
