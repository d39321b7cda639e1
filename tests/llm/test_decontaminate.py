"""Templates, slots and runs."""

import random

import pytest

from larder.llm import decontaminate as dc

ITEM = "A train leaves the old station at noon. On Monday John buys 3 apples and 12 pears for 5 dollars, then John gives 2 apples to Mary."


@pytest.fixture(scope="module")
def benchmark(spark):
    def make(*texts):
        rows = [(k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "item_id long, text string")

    return make


def template(text):
    code, slot, start, end, _ = dc.template(text)
    words = [text[a:b] for a, b in zip(start, end, strict=True)]
    return [{dc.LITERAL: w.lower(), dc.NUMBER: "<num>", dc.UNIT: "<unit>", dc.CAPITAL: "<name>"}[s] for s, w in zip(slot, words, strict=True)]


def test_template():
    assert template("The old John paid 1,200.50 dollars. He met Mary: IN TOWN 5 km away, days later.") == (
        "the old <name> paid <num> <unit> he met <name> in town <num> <unit> away days later".split()
    )
    assert template("") == template(None) == template(" ... \n") == []


def test_words_equal_a_pattern_scan():
    import random
    import re

    pattern = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+")
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(list("ab Zé.,1 2_\n!߀²中😀𝒜-'"), k=rng.randint(1, 60)))
        code, slot, start, end, _ = dc.template(text)
        assert [text[a:b] for a, b in zip(start, end, strict=True)] == pattern.findall(text), text
        lit = {text[a:b].lower(): c for a, b, c, s in zip(start, end, code.tolist(), slot, strict=True) if s == dc.LITERAL}
        assert len(set(lit.values())) == len(lit)


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    text = "alpha beta Gamma 12 km " * 30 + "x" * 300 + " omega"
    whole = dc.template(text)[0].tolist()
    monkeypatch.setattr(dc, "PIECE", 64)
    assert dc.template(text)[0].tolist() == whole


def found(docs, items, **kw):
    return {(r["doc_id"], r["item_id"]): r for r in dc.leaks(docs, items, **kw).collect()}


def test_copies_and_exchanged_values(documents, benchmark):
    noise = "Something else entirely happens here before and after the passage, as it often does. "
    renamed = ITEM.replace("John", "Peter").replace("Mary", "Alice").replace("12", "40").replace("3", "7").replace("dollars", "euros").replace("Monday", "Friday")
    mixed = ITEM.replace("John gives", "Paul gives")  # John is two people now
    texts = [ITEM, noise + ITEM.upper() + noise, noise + renamed, noise + mixed + noise, noise, None, "", ITEM[:60], ITEM]
    got = found(documents(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, None]), benchmark(ITEM, None, "", "...", ITEM))
    docs = {d for d, _ in got}
    assert docs == {0, 1, 2, 3, None} and not docs & {4, 5, 6, 7}
    assert got[(0, 0)]["matched_words"] == got[(0, 0)]["item_words"] == 27 and got[(0, 0)]["changed_slots"] == 0
    assert got[(2, 0)]["matched_words"] == 27 and got[(2, 0)]["changed_slots"] == 6
    assert got[(3, 0)]["matched_words"] < 27 and got[(3, 0)]["changed_slots"] == 0
    assert {i for _, i in got} == {0, 4}


def test_literals_in_capitals_still_match(documents, benchmark):
    item = "la mente que no asque del ciónes para osue rrez en ñas de los y se cias"
    got = found(documents(["X!! " + item.upper() + " Y!!", item.replace("que", "qua", 1)]), benchmark(item))
    assert set(got) == {(0, 0), (1, 0)} and got[(1, 0)]["matched_words"] == 14


def test_slots_that_contradict_each_other_are_no_run():
    slots = [("3a\x1f3b", "3x\x1f3y"), ("3a", "3x"), ("3a", "3z"), ("3a", "3z")]
    assert dc.consistent_runs([0, 1, 2, 3], slots, 4) == [(0, 5, 2), (2, 5, 1)]
    assert dc.consistent_runs([0], [("3a\x1f3a", "3x\x1f3y")], 4) == []
    assert dc.consistent_runs([0, 9], [("", ""), ("", "")], 4) == [(0, 4, 0), (9, 4, 0)]


def test_short_items_match_whole(documents, benchmark):
    got = found(documents(["so what is two plus two now", "what is two", "what"]), benchmark("What is two plus two?", "what"))
    assert set(got) == {(0, 0), (0, 1), (1, 1), (2, 1)}


def test_windows_of_mere_placeholders_say_nothing(documents, benchmark):
    item = "totals 1 2 3 4 5 6 7 8 9 10 11 12 and then the sum of all the numbers here is taken"
    got = found(documents(["the 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36", "x " + item]), benchmark(item))
    assert set(got) == {(1, 0)}


def test_items_dense_in_slots_are_found(documents, benchmark):
    item = "Add these numbers and write the total: 3 4 5 6 7 8 9 10"
    changed = "so " + item.replace("3 4 5", "21 22 23") + " then"
    got = found(documents([item, changed, "Add these numbers and write the total: then rest", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"]), benchmark(item))
    assert (0, 0) in got and got[(0, 0)]["matched_words"] == 15 and got[(0, 0)]["changed_slots"] == 0
    lower = found(documents([changed.lower()]), benchmark(item.lower()))
    assert lower[(0, 0)]["matched_words"] == 15 and lower[(0, 0)]["changed_slots"] == 3
    assert {d for d, _ in got} <= {0, 1}


def test_blocks_of_hashes_give_the_same(monkeypatch, documents, benchmark):
    rng = random.Random(0)
    items = [" ".join(rng.choices(["red", "cat", "runs", "over", "7", "Bob", "km", "tree", "is", "at"], k=30)) for _ in range(12)]
    texts = [rng.choice(items) + " " + " ".join(rng.choices(["red", "cat", "at"], k=20)) for _ in range(20)]
    want = found(documents(texts), benchmark(*items))
    monkeypatch.setattr(dc, "BLOCK_HASHES", 50)
    assert found(documents(texts), benchmark(*items)) == want and len(want) >= 20


def test_empty_tables_and_filter(documents, no_documents, benchmark):
    docs = documents([ITEM, "clean", None, ITEM], ids=[1, 2, None, None])
    assert dc.leaks(no_documents, benchmark(ITEM)).count() == 0
    nothing = dc.leaks(docs, benchmark(ITEM).limit(0))
    assert nothing.count() == 0 and dc.keep_clean(docs, nothing).count() == 4
    kept = dc.keep_clean(documents([ITEM, "clean", None], ids=[1, 2, None]), dc.leaks(documents([ITEM, "clean", None], ids=[1, 2, None]), benchmark(ITEM)))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, None]


TOM = "Tom has 5 apples at home. Anna gives Tom 3 more apples today. Tom eats 2 of them. How many are left?"
SARAH = "Sarah buys 12 pencils and 4 pens for school."


def test_names_that_open_a_sentence_can_be_exchanged(documents, benchmark):
    tom = TOM.replace("Tom", "Ben").replace("Anna", "Lisa").replace("5", "7").replace("3", "4").replace("2", "3")
    sarah = "Look here. " + SARAH.replace("Sarah", "Emma").replace("12", "15").replace("4", "6") + " Done."
    other = "Tom has 5 pears in town. Anna sells him 3 of hers now. He eats 2 at once. Who has some of them still?"
    got = found(documents([TOM, tom, sarah, other, SARAH.lower(), "The old cat sleeps. Some dogs run around here for hours and hours. They are tired."]), benchmark(TOM, SARAH))
    assert set(got) == {(0, 0), (1, 0), (2, 1), (4, 1)}
    assert got[(1, 0)]["matched_words"] == 22 and got[(1, 0)]["changed_slots"] == 5
    assert got[(2, 1)]["matched_words"] == 9 and got[(2, 1)]["changed_slots"] == 3


def test_sql_says_the_same_on_names_and_digits(spark, documents, benchmark):
    import duckdb

    from larder.llm import checks

    rng = random.Random(7)
    items = [TOM, SARAH, ITEM, "Add these numbers and write the total: 3 4 5 6 7 8 9 10", "What is two plus two?"]
    people = ["Ben", "Lisa", "Omar", "Kim"]
    for _ in range(8):
        items.append(" ".join(rng.choices(["Red", "cat", "runs", "over", "7", "12", "km", "tree", "is", "at", "a.", "The", "on", "big"], k=rng.randint(6, 24))))
    texts = []
    for item in items * 3:
        text = item
        for old, new in zip(["Tom", "Anna", "Sarah", "John", "Mary"], rng.sample(people, 4)):
            text = text.replace(old, new) if rng.random() < 0.6 else text
        if rng.random() < 0.6:
            text = text.replace("7", "70").replace("12", "99").replace("5", "88")
        texts.append("Some words before it. " + text + " and more words behind it.")
    docs, bench = documents(texts, extra=False), benchmark(*items)
    got = sorted(tuple(r) for r in dc.leaks(docs, bench).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    want = sorted(con.execute(checks.LEAKS).fetchall())
    assert got == want and len(got) >= 30
