import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import passages as ps


def chain_score(pos, ref, k, cost):
    """Best score of a chain that ends in each match, over all predecessors."""
    order = sorted(zip(pos, ref, strict=True))
    f = []
    for i, (p, r) in enumerate(order):
        best = float(k)
        for j in range(i):
            q, s = order[j]
            if q < p and s < r:
                best = max(best, k + min(f[j], f[j] - cost * ((p - q - k) + (r - s - k))))
        f.append(best)
    return max(f)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
@settings(max_examples=150, deadline=None)
def test_chains_rise_and_use_each_match_once(matches):
    pos, ref = map(np.array, zip(*matches, strict=True))
    found = ps.chains(pos, ref)
    flat = [m for c in found for m in c]
    assert sorted(flat) == sorted(matches)
    for c in found:
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))
        assert all(b[0] - a[0] - ps.K <= ps.MAX_GAP and b[1] - a[1] - ps.K <= ps.MAX_GAP for a, b in zip(c, c[1:], strict=False))


@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), min_size=2, max_size=25, unique=True))
@settings(max_examples=100, deadline=None)
def test_first_chain_is_the_best(matches):
    """With matches so far apart that they do not overlap, the score is the plain gap cost."""
    matches = sorted({(p // ps.K * ps.K, r // ps.K * ps.K) for p, r in matches})
    pos, ref = map(np.array, zip(*matches, strict=True))
    best = ps.chains(pos, ref, max_gap=10**9)[0]
    score = ps.K * len(best) - sum(ps.GAP_COST * ((b[0] - a[0] - ps.K) + (b[1] - a[1] - ps.K)) for a, b in zip(best, best[1:], strict=False))
    assert score == pytest.approx(chain_score(pos, ref, ps.K, ps.GAP_COST), abs=1e-6)


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=150, deadline=None)
def test_edit_distance(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert ps.edit_distance(a, b) == d[-1][-1]


def test_winnowing_finds_shared_runs():
    dice = random.Random(1)
    run = np.array([dice.getrandbits(64) for _ in range(ps.K + ps.WINDOW - 1)], dtype=np.uint64)
    for _ in range(40):
        made = [np.concatenate([np.array([dice.getrandbits(64) for _ in range(dice.randint(0, 30))], dtype=np.uint64), run, np.array([dice.getrandbits(64) for _ in range(dice.randint(0, 30))], dtype=np.uint64)]) for _ in range(2)]
        a, b = (set(ps.winnow(x)[0].tolist()) for x in made)
        assert a & b
    assert len(ps.winnow(run[:4])[0]) == 0 and len(ps.winnow(run[:5])[0]) == 1


def planted():
    dice = random.Random(7)
    word = lambda: f"w{dice.randrange(100_000)}"
    passage = [word() for _ in range(70)]
    fuzzy = list(passage)
    for k in (20, 40, 60):
        fuzzy[k] = "swap"
    del fuzzy[50]
    rows, short = [], [word() for _ in range(30)]
    for d in range(40):
        text = [word() for _ in range(dice.randint(60, 150))]
        if d < 10:
            text[30:30] = fuzzy if d == 4 else passage
        elif d < 20:
            text[10:10] = short
        rows.append((d, " ".join(text)))
    return rows + [(100, rows[30][1]), (101, rows[30][1]), (102, "a short copy"), (103, "a short copy")], passage


def test_planted_passages_are_found_and_clean_documents_left_alone(spark, space_of):
    rows, _ = planted()
    got = ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), space_of("p")).collect()
    ids = {r.doc_id for r in got} | {r.ref_doc_id for r in got}
    assert ids == {*range(10), 30, 100, 101}
    for r in got:
        assert r.similarity >= ps.SIMILARITY and r.passage_words >= ps.MIN_WORDS
    pieces = [r for r in got if r.doc_id < 10]
    assert len({r.doc_id for r in pieces}) >= 8  # stars about one or two texts
    text = dict(rows)
    for r in pieces:
        if 4 not in (r.doc_id, r.ref_doc_id):
            assert text[r.doc_id].split()[r.start_word : r.end_word] == text[r.ref_doc_id].split()[r.ref_start : r.ref_end]
    assert all(r.passage_words == 70 for r in pieces if r.doc_id != 4)
    assert {(r.doc_id, r.ref_doc_id, r.similarity) for r in got if r.doc_id >= 100} == {(100, 30, 1.0), (101, 30, 1.0)}


def test_alignment_of_a_fuzzy_passage():
    a = list(range(100, 170))
    b = a[:20] + [1] + a[21:50] + a[51:]
    m = [(i, i) for i in (0, 10)] + [(i, i) for i in (25, 40)] + [(55, 54), (64, 63)]
    s, e, t, u, edits = ps.align(a, b, [x for x, _ in m], [y for _, y in m])
    assert (s, e, t, u, edits) == (0, 70, 0, 69, 2)


def test_edges(edge_docs, no_docs, space_of):
    assert ps.repeated_passages(edge_docs, space_of("p")).count() == 0
    twice = edge_docs.unionByName(edge_docs.where("doc_id = 6")).unionByName(edge_docs.selectExpr(*["doc_id + 50 as doc_id" if c == "doc_id" else f"`{c}`" for c in edge_docs.columns]).where("doc_id = 56"))
    rows = ps.repeated_passages(twice, space_of("p")).collect()
    assert [(r.doc_id, r.ref_doc_id, r.n_copies, r.end_word) for r in rows] == [(56, 6, 3, 60_000)]
    assert ps.repeated_passages(no_docs, space_of("p")).count() == 0


def repeated(spark, rows, space_of):
    return ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), space_of("p")).collect()


def test_passages_put_together_from_common_lines(spark, space_of):
    """Two texts share a passage each line of which stands first in another text."""
    dice = random.Random(21)
    word = lambda: f"v{dice.randrange(100_000)}"
    rows, n = [], 0
    for trial in range(12):
        lines = [[word() for _ in range(dice.choice([12, 16, 20]))] for _ in range(5)]
        rows += [(n + k, " ".join([*(word() for _ in range(30)), *line, *(word() for _ in range(30))])) for k, line in enumerate(lines)]
        passage = [w for line in lines for w in line]
        rows += [(n + 5 + k, " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))])) for k in range(2)]
        n += 7
    got = {r.doc_id for r in repeated(spark, rows, space_of)}
    assert sum(bool({7 * k + 5, 7 * k + 6} & got) for k in range(12)) >= 11
    assert all(d % 7 >= 5 for d in got)


def test_one_word_over_and_over(spark, space_of):
    rows = [(1, "start " + "la " * 80 + "one two three"), (2, "other words here " + "la " * 70 + "end"), (3, " ".join(f"z{i}" for i in range(90)))]
    got = {r.doc_id for r in repeated(spark, rows, space_of)}
    assert got <= {1, 2} and len(got) == 1
