import re

import pytest

from lodeframe.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, h string, c int"
ITEM = "A train leaves London at 9 and drives 120 km to Leeds, where Anna waits 9 hours before the next train goes back over the old bridge."
CLEAN = "Some quite different words that no benchmark item holds in this order, though it says 9 and 120 km as well, and goes on and on for a while."


def docs():
    changed = ITEM.replace("9", "14").replace("120", "77").replace("London", "Paris").replace("Anna", "Otto")
    broken = ITEM.replace("at 9", "at 14")  # one value of the item would stand for two
    return [
        (1, "He said that it was so. " + ITEM + " Then more.", "verbatim"),
        (2, "intro words " * 3000 + changed + " and after", "re-parameterised"),
        (3, "x " + broken, None),
        (4, CLEAN, None),
        (5, " ".join(w + "***" for w in ITEM.upper().split()), None),
        (6, " ".join(w + "!!" for w in ITEM.split()), None),
        (7, "pad pad pad " + ITEM[:110], "verbatim"),
        (8, "", None),
        (9, None, None),
        (10, "A train leaves", None),
    ]


def test_leaks(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, CLEAN.replace("Some", "No").replace("quite", "rather").replace("words that", "things"))], "item_id long, text string")
    rows = [(d, t, "x", None, 1) for d, t, _ in docs()] + [(1, docs()[0][1], None, None, 0)] * 3 + [(None, ITEM, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.kind) for r in decontaminate.leaks(df, benchmark).collect() if r.item_id == 1}
    want = {(d, kind) for d, _, kind in docs() if kind} | {(None, "verbatim")}
    assert {g for g in got if g[0] not in (5, 6)} == want
    kept = decontaminate.decontaminated(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id not in (4, 5, 6)) == [3, 8, 9, 10]
    assert decontaminate.leaks(df, benchmark.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), benchmark).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = decontaminate.leaks(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_against_brute_force(spark, sf):
    """Whole passages are found, and documents that share no run of words with an item are left alone."""
    folder = f"/root/testdata/{sf}"
    documents, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    items = [(r.item_id, norm(r.text)) for r in benchmark.collect()]
    index = {}
    for i, w in items:
        for k in range(len(w) - 7):
            index.setdefault(tuple(w[k : k + 8]), set()).add((i, k))
    want, none = set(), set()
    for r in documents.select("doc_id", "text").collect():
        w, runs = norm(r.text), {}
        for k in range(len(w) - 7):
            for i, p in index.get(tuple(w[k : k + 8]), ()):
                runs[i, k - p] = runs.get((i, k - p), 0) + 1
        want |= {(r.doc_id, i) for (i, _), n in runs.items() if n >= 8}
        if not runs:
            none.add(r.doc_id)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, benchmark).collect()}
    assert want and want <= got and not {d for d, _ in got} & none


def planted(spark, items, forms=(str,)):
    """Of each item, the places (form, words before it) where a copy is found."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    places = [(i, f, n) for i in range(len(items)) for f in range(len(forms)) for n in range(4)]
    rows = [(k, "word " * n + "before it " + forms[f](items[i]) + " then more words come") for k, (i, f, n) in enumerate(places)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert all(places[d][0] == i for d, i in got)
    return {i: {(f, n) for k, (j, f, n) in enumerate(places) if i == j and (k, i) in got} for i in range(len(items))}


def test_items_full_of_numbers(spark):
    items = ["Compute 12 + 35 - 7 * 4 / 2 + 19 - 3 * 8 + 6 / 5 - 11 + 40 * 2 as 7 digits", "A box of 3 kg costs 12 dollars, 5 kg costs 18 dollars, 9 kg costs 30 dollars, so what do 14 kg cost?"]
    assert all(len(found) == 4 for found in planted(spark, items).values())


def test_short_items(spark):
    items = ["Alpha beta gamma delta epsilon zeta eta theta", "Why do red cats like to sit near warm stoves", "One two red four big six old eight new", "what is seven times nine", "add 12 and 30"]
    assert all(len(found) == 4 for found in planted(spark, items).values())


def test_case_and_white_space(spark):
    forms = (str, str.upper, str.lower, str.title, lambda x: x.replace(" ", "\n"), lambda x: " ".join(w + "!!" for w in x.split()))
    items = [ITEM, "Anna has bought 12 red apples and London sells them to Paul for 9 pounds each day"]
    assert all(len(found) == 4 * len(forms) for found in planted(spark, items, forms).values())
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    df = spark.createDataFrame([(d, t, None, None, 1) for d, t, _ in docs() if d in (5, 6)], SCHEMA)
    assert {(r.doc_id, r.kind) for r in decontaminate.leaks(df, benchmark).collect()} == {(5, "verbatim"), (6, "verbatim")}


def test_different_values_stay_different_and_decimals_count(spark):
    items = ["Mix 12 cups of flour with 5 cups of milk and 6 spoons of sugar before you bake the whole cake slowly", "The small boat needs 3.5 hours for the way up the wide river and the old ferry needs 35 minutes more than that"]
    rows = [
        (1, items[0].replace("12", "9").replace("5", "9").replace("6", "9"), None),
        (2, items[0].replace("12", "31").replace("5", "8").replace("6", "40"), "re-parameterised"),
        (3, items[1].replace("35 ", "3.5 "), None),
        (4, items[1].replace("35 ", "70 ").replace("3.5", "7.25"), "re-parameterised"),
        (5, items[1], "verbatim"),
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(d, k) for d, _, k in rows if k}
    clashing = spark.createDataFrame([(str(d), t, "x", "y") for d, t, _ in rows], "doc_id string, text string, leaked string, item_id string")
    assert sorted(r.doc_id for r in decontaminate.decontaminated(clashing, benchmark).collect()) == ["1", "3"]


def test_join_by_shuffle_finds_the_same(spark, monkeypatch):
    documents, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(str, decontaminate.leaks(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert want == sorted(map(str, decontaminate.leaks(documents, benchmark).collect()))
