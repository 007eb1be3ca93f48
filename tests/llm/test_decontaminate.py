from __future__ import annotations

from itertools import combinations

import pytest

from quire.llm.decontaminate import overlaps, without_overlaps

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_substitutions_are_tolerated_and_clean_texts_stay(spark):
    words = ITEM.split()
    swapped = " ".join("X" if i in (4, 11, 14) else w for i, w in enumerate(words))
    many = " ".join("X" if i % 3 == 0 else w for i, w in enumerate(words))
    moved = " ".join(words[:7] + ["inserted"] + words[7:])
    docs = [(1, f"before {ITEM.upper()}, after"), (2, f"a b c {swapped} d"), (3, many), (4, "clean text of its own"), (5, None), (6, ""), (None, ITEM), (1, ITEM), (7, moved), (8, "tiny\nitem."), (9, "tiny thing item"), (10, "w " * 20000 + ITEM)]
    bench = [(100, ITEM), (101, "Tiny item"), (102, None), (103, ""), (None, "clean text of its own")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as key", "2 as h").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item_tokens, r.n_matched, r.start) for r in overlaps(d, b).collect()}
    assert got == {(1, 100): (15, 15, 0), (2, 100): (15, 12, 3), (8, 101): (2, 2, 0), (10, 100): (15, 15, 20000)}
    kept = without_overlaps(d, b)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [3, 4, 5, 6, 7, 9]  # rows without an id are judged too
    assert kept.columns == d.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert overlaps(none, items).count() == 0
    assert overlaps(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), items.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    d, b = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = overlaps(d, b)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 14, 15, 20])
def test_every_pattern_within_the_budget_is_found(spark, n):
    words = [f"w{i}" for i in range(n)]
    patterns = list(combinations(range(n), n // 5))
    d = spark.createDataFrame([(k, " ".join("x" if i in p else w for i, w in enumerate(words))) for k, p in enumerate(patterns)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.n_matched, r.start) for r in overlaps(d, b).orderBy("doc_id").collect()] == [(k, n - n // 5, 0) for k in range(len(patterns))]


def test_parts_of_items_and_moved_tokens(spark):
    words = [f"w{i}" for i in range(59)]
    fifteen = ITEM.split()
    docs = {
        1: "x y " + " ".join(words[:47]) + " z",  # 79.7 % of the item
        2: " ".join(words[30:]) + " the item begins before this text",
        3: "the text ends in the item " + " ".join(words[:20]),
        4: " ".join(fifteen[:7] + ["inserted"] + fifteen[7:]),
        5: " ".join(fifteen[:7] + fifteen[8:]),
        6: " ".join(words[:12]) + " too little",
        7: " ".join(words[20:33]) + " just enough",
        8: "a a a a a a",  # an item of one word, repeated
        9: " ".join(fifteen[8:] + ["and"] + fifteen[:8]),
        10: " ".join(words[:6] + ["X"] + words[7:10] + ["Y"] + words[11:15]),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(100, " ".join(words)), (101, ITEM), (102, "a " * 15)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item_tokens, r.n_matched, r.start) for r in overlaps(d, b, part=13).collect()}
    assert got == {(1, 100): (59, 47, 2), (2, 100): (59, 29, -30), (3, 100): (59, 20, 6), (4, 101): (15, 15, 0), (5, 101): (15, 14, -1), (7, 100): (59, 13, -20), (10, 100): (59, 13, 0)}
    assert sorted(r.doc_id for r in without_overlaps(d, b, part=13).collect()) == [6, 8, 9]


def test_many_copies_of_a_text_are_one(spark):
    words = [f"w{i}" for i in range(59)]
    text = "x y " + " ".join(words[:40]) + " z " + " ".join(words[20:50])
    d = spark.range(3000).selectExpr("id as doc_id", f"case when id % 3 = 0 then '{text}' else concat('clean ', id) end as text")
    b = spark.createDataFrame([(100, " ".join(words))], "item_id long, text string")
    kept = without_overlaps(d, b, part=13)
    assert kept.count() == 2000 and kept.where("doc_id % 3 = 0").count() == 0
