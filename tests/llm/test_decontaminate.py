import math
import random
import re
from itertools import combinations

import pytest

from panelloom.llm import decontaminate as dc


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    """All diagonals, compared token by token."""
    out = {}
    for doc_id, text in docs:
        t = words_of(text)
        for item_id, body in items:
            w = words_of(body)
            if not w:
                continue
            n = min(dc.WINDOW, len(w))
            for d in range(-len(w) + 1, len(t)):
                same = [int(0 <= d + i < len(t) and t[d + i] == x) for i, x in enumerate(w)]
                best = max(sum(same[k : k + n]) for k in range(len(w) - n + 1))
                if best >= -(-n * 4 // 5) and best > out.get((doc_id, item_id), (0, 0))[1]:
                    out[doc_id, item_id] = (d, best, n)
    return sorted((*k, *v) for k, v in out.items())


def corpus():
    dice = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(dice.choices(vocabulary, k=n))) for i, n in enumerate([5, 11, 15, 20, 30, 60, 60])] + [(7, None), (8, ""), (9, "w1 w2"), (10, " ".join(dice.choices(vocabulary, k=8)))]
    docs = []
    for d in range(60):
        text = dice.choices(vocabulary, k=dice.randint(0, 80))
        if d % 2:
            passage = dice.choice([x for x in items if x[1]])[1].split()
            for _ in range(dice.choice([0, 0, 1, 2, 4, 8])):
                passage[dice.randrange(len(passage))] = f"swap{d}"
            if dice.random() < 0.3:
                passage = passage[: len(passage) // 2]
            at = dice.randint(0, len(text))
            text[at:at] = passage
        docs.append((d, dice.choice([" ", ", ", "\n"]).join(text)))
    docs += [(60, "W1, w2!"), (61, "w1 w2 w3")]
    return docs, items


def test_against_brute_force(spark, space_of):
    docs, items = corpus()
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), space_of("d"))
    want = brute(docs, items)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 15


def repeating():
    """Items that have blocks over and over, and documents with parts of them from any place."""
    dice = random.Random(21)
    block = lambda n: [f"b{dice.randrange(400)}" for _ in range(n)]
    items, docs = [], []
    for i in range(25):
        a, b, c, d = block(8), block(8), block(dice.randint(1, 6)), block(dice.randint(1, 30))
        filler = lambda: block(dice.randint(0, 12))
        body = dice.choice([[*a, *b, *filler(), *a, *c, *b, *filler(), *a, *b], (a * 5 + c) * 3, a + d + a + d + a, c * 30, block(dice.randint(1, 4))])
        items.append((i, " ".join(body)))
        for _ in range(4):
            at = dice.randrange(len(body))
            part = list(body[at : at + dice.randint(10, 40)])
            for _ in range(dice.randint(0, len(part) // 6)):
                part[dice.randrange(len(part))] = f"z{dice.randrange(99)}"
            docs.append((len(docs), " ".join([*filler(), *part, *filler()])))
    return docs, items


def test_items_that_repeat_against_brute_force(spark, space_of):
    docs, items = repeating()
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), space_of("d"))
    want = brute(docs, items)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_middle_place_of_a_block(spark, space_of):
    """Blocks a and b stand at the start, in the middle and at the end of the item; the document has the middle with other words inside."""
    a, b = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]
    gap = lambda name: [f"{name}{i}" for i in range(20)]
    item = [*a, *b, *gap("x"), *a, *[f"c{i}" for i in range(4)], *b, *gap("y"), *a, *b]
    docs = spark.createDataFrame([(1, " ".join([*a, *[f"d{i}" for i in range(4)], *b])), (2, "some of one two three four in a longer text here so it is"), (3, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item)), (6, "One, two, three four!")], "item_id long, text string")
    rows = dc.leaks(docs, items, space_of("d")).collect()
    assert sorted(map(tuple, rows)) == [(1, 5, -36, 16, 20), (2, 6, 2, 4, 4)]
    assert [r.doc_id for r in dc.clean_documents(docs, items, space_of("d")).collect()] == [3]


def test_substitutions_are_tolerated(spark, space_of):
    item = [f"x{i}" for i in range(40)]
    text = list(item)
    for k in (3, 14, 20, 33):
        text[k] = "other"
    docs = spark.createDataFrame([(1, "before it " + " ".join(text) + " after"), (2, " ".join(reversed(item)))], "doc_id long, text string")
    rows = dc.leaks(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"), space_of("d")).collect()
    assert [(r.doc_id, r.item_id, r.doc_start) for r in rows] == [(1, 9, 2)]


def test_edges(spark, edge_docs, no_docs, space_of):
    items = spark.createDataFrame([(None, "w0x0 w0x1 w0x2 w0x3 w0x4 w0x5 w0x6 w0x7 w0x8 w0x9 w0x10 w0x11", 1), (1, None, 2), (2, "", 3), (3, "one", 4)], "item_id long, text string, doc_id int")
    rows = dc.leaks(edge_docs, items, space_of("d")).collect()
    # an item of one token is leaked by every text that has it
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(3, 3), (4, 3), (6, None), (20, 3)]
    kept = dc.clean_documents(edge_docs, items, space_of("d"))
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 7
    assert kept.where("doc_id = 3").count() == 0  # "another text under one id" has the item, too
    assert kept.where("doc_id is null").count() == edge_docs.where("doc_id is null").count()
    assert dc.leaks(no_docs, items, space_of("d")).count() == 0
    assert dc.leaks(edge_docs, items.limit(0), space_of("d")).count() == 0


def test_plan_has_no_python(spark, documents, sf_dir, space_of):
    plan = dc.leaks(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), space_of("d"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|Cartesian|NestedLoop", plan)


def test_masks_find_every_window_that_agrees():
    for lengths, masks in ((range(dc.LONG, dc.WINDOW + 1), dc.MASKS), (range(dc.SHORTEST, dc.LONG), dc.SHORT_MASKS)):
        for n in lengths:
            for wrong in combinations(range(n), n - math.ceil(n * dc.SIMILARITY - 1e-9)):
                assert any(not set(wrong) & {k + i for k in m} for m in masks for i in range(n - m[-1])), (n, wrong)


def test_short_items(spark, space_of):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six seven eight it is"), (2, "one two three four"), (3, "one two three FOUR 5 six seven eight")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_agree) for r in dc.leaks(docs, items, space_of("d")).collect()) == [(1, 8), (3, 7)]


def test_one_word_over_and_over(spark, space_of):
    docs = spark.createDataFrame([(1, "la " * 3000), (2, "lo " * 3000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 400)], "item_id long, text string")
    assert [r.doc_id for r in dc.leaks(docs, items, space_of("d")).collect()] == [1]


def test_clean_rows_stay_whatever_their_ids(spark, space_of):
    """Expectation by row: a row goes if and only if its own text leaks."""
    bad, good = " ".join(f"x{i}" for i in range(30)), "a clean text about nothing much"
    rows = [(1, bad), (1, good), (None, bad), (None, good), (2, good), (2, good), (3, None), (4, f"before {bad} after")]
    kept = dc.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, bad)], "item_id long, text string"), space_of("d"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if "x5" not in (r[1] or ""))
