import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from panelloom.llm import graph, simhash


def naive_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_groups(rows, radius=2):
    fps = [naive_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("source", ["documents", "edge_docs"])
def test_against_brute_force(request, space_of, source):
    docs = request.getfixturevalue(source)
    got = sorted(map(tuple, simhash.near_duplicates(docs, space_of("s")).collect()), key=str)
    assert got == sorted(naive_groups([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_empty(no_docs, space_of):
    assert simhash.near_duplicates(no_docs, space_of("s")).count() == 0


def test_near_copies_link_in_chains(spark, space_of):
    base = random.Random(1).getrandbits(64)
    fps = [base, base ^ 3, base ^ 3 ^ (5 << 40), base ^ 3 ^ (5 << 40) ^ (3 << 60), base ^ (7 << 20)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.hamming_links(df)
    roots = {r.node & (1 << 64) - 1: r.root for r in graph.components(links, space_of("s")).collect()}
    assert len({roots[f] for f in fps[:4]}) == 1 and fps[4] not in roots


@pytest.mark.parametrize("n", [300, 5000])
def test_close_forest_equals_all_pairs(n):
    dice = np.random.default_rng(n)
    fps = np.unique(dice.integers(0, 1 << 13, n).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(99))
    a, b = simhash.close_forest(fps, 2)
    i, j = simhash._near(fps, 2)
    x, y = graph.forest(fps[i].view(np.int64), fps[j].view(np.int64))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(x.tolist(), y.tolist(), strict=True))


def test_components_of_random_graphs(spark, space_of):
    dice = random.Random(3)
    edges = [(dice.randrange(400), dice.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7), space_of("s")).collect()}
    a, b = graph.forest(*(np.array([e[k] for e in edges if e[0] is not None and e[0] != e[1]]) for k in (0, 1)))
    want = dict(zip(a.tolist(), b.tolist(), strict=True))
    want |= {r: r for r in want.values()}
    assert got == want


def jaccard_groups(rows):
    """Smallest row of each group of texts by all pairs' Jaccard similarity of five-word shingles."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    texts = sorted({r[1] for r in rows}, key=str)
    sets = {t: shingles(t) for t in texts}
    up = {t: t for t in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = sets[a], sets[b]
            if not x and not y or x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                up[root(a)] = root(b)
    groups = {}
    for r in rows:
        groups.setdefault(root(r[1]), []).append(r)
    return groups.values()


def kept_ids(groups):
    return sorted(min((r[0] is None, r[0] or 0) for r in g) for g in groups)


def test_one_of_each_against_brute_force(spark, space_of):
    """The expectation uses the rows alone; ids repeat and are null."""
    dice = random.Random(12)
    bases = [[f"w{dice.randrange(3000)}" for _ in range(dice.choice([1, 3, 6, 30, 120, 300]))] for _ in range(40)]
    rows = [(3, "A text"), (5, "A text"), (5, "B other"), (None, "B other"), (None, "C alone"), (7, None), (8, " "), (None, "D"), (None, "D")]
    for _ in range(150):
        words = list(dice.choice(bases))
        for _ in range(dice.choice([0, 0, 1, 2, 5])):
            words[dice.randrange(len(words))] = f"x{dice.randrange(1000)}"
        rows.append((dice.choice([None, *range(10, 90)]), " ".join(words)))
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = simhash.one_of_each(docs, space_of("s")).collect()
    groups = jaccard_groups(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == kept_ids(groups)
    assert {(r.doc_id, r.text) for r in got} <= set(rows) and len(got) == len(groups)
    assert all(sum((r.doc_id, r.text) in set(g) for r in got) >= 1 for g in groups)


def test_one_of_each_on_edges(edge_docs, no_docs, space_of):
    kept = simhash.one_of_each(edge_docs, space_of("s"))
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == kept_ids(jaccard_groups([(r.doc_id, r.text) for r in edge_docs.collect()]))
    assert simhash.one_of_each(no_docs, space_of("s")).count() == 0


def test_bit_counts_of_long_runs():
    dice = np.random.default_rng(0)
    for n in (1, 254, 255, 256, 3000):
        h = dice.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(3)
        starts = np.unique(np.append(0, dice.integers(0, n, 4)))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        assert np.array_equal(simhash.bit_counts(h, starts), np.add.reduceat(bits, starts, axis=0, dtype=np.int64))


def test_workers_hold_one_operators_tables():
    from panelloom.llm import common

    a = common.held("a", list)
    assert common.held("a", list) is a
    common.held("b", list)
    assert common.held("a", list) is not a


def test_stage_joins_by_jaccard_of_five_word_shingles(spark, space_of):
    base = [f"w{i}" for i in range(204)]  # 200 shingles
    one = [w if i != 100 else "x" for i, w in enumerate(base)]  # 195 of 205 shared
    four = [w if i not in (20, 60, 100, 140) else "x" for i, w in enumerate(base)]  # 180 of 220 shared: 0.818
    five = [w if i not in (20, 60, 100, 140, 180) else "y" for i, w in enumerate(base)]  # 175 of 225 shared: 0.778
    rows = [(1, " ".join(base)), (2, " ".join(one)), (3, " ".join(four)), (4, " ".join(five)), (5, "  "), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, space_of("s")).collect()) == [1, 4, 5]


def test_one_of_each_against_an_exact_join(spark, space_of):
    """Kept rows of 1,000 documents against all pairs of similarity 0.8, found by an exact prefix filter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: simhash.shingle_hashes(r.text) for r in docs.collect()}
    often = Counter(x for s in rows.values() for x in s.tolist())
    up = {i: i for i in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = defaultdict(list)
    for i in sorted(rows, key=lambda i: len(rows[i])):
        s = sorted(rows[i].tolist(), key=lambda x: (often[x], x))
        # two sets of similarity 0.8 share one of the rarest fifth of either, and one more
        first = s[: len(s) - -(-len(s) * 4 // 5) + 1]
        for j in {j for x in first for j in seen[x]}:
            n = len(np.intersect1d(rows[i], rows[j], assume_unique=True))
            if n >= 0.8 * (len(rows[i]) + len(rows[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for x in first:
            seen[x].append(i)
    wordless = [i for i in rows if not len(rows[i])]
    want = {i for i in rows if find(i) == i} - set(wordless[1:])
    got = {r.doc_id for r in simhash.one_of_each(docs, space_of("exact")).collect()}
    assert got == want and len(want) < len(rows) - 50


def test_links_of_a_crowd_in_the_stage(spark, space_of):
    """Copies similar to one text and not to each other: under a shared block none need meet that text first, or as a neighbour."""
    dice = np.random.default_rng(8)
    base = [f"w{i}" for i in range(204)]  # 200 shingles
    rows = [" ".join(base)]
    for k in range(300):
        copy = list(base)
        for i in np.sort(dice.choice(40, 4, replace=False)):  # 180 of 220 shared with the first, of two copies 160 to 180 of 240
            copy[5 * i + 4] = f"x{k}"
        rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in simhash.one_of_each(docs, space_of("crowd")).collect()] == [0]
