import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from panelloom.llm import forest
from panelloom.llm.simhash import shingle_hashes


def shingle_set(text):
    w = (text or "").encode().lower().split()
    w = [x.decode() for x in w]
    return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """All pairs of rows on their full sets of strings; components by doc_id."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for group in groups.values():
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out += [str((rows[i][0], len(sets[i]), least, rows[i][0] == least)) for i in group]
    return sorted(out)


def copies(seed, groups=30, size=12):
    """Texts in groups of copies with more and more words replaced, about the threshold, and texts that share a passage."""
    dice = random.Random(seed)
    word = lambda: f"w{dice.randrange(4000)}"
    texts = []
    for g in range(groups):
        base = [word() for _ in range(dice.choice([3, 8, 40, 120, 300]))]
        for k in range(dice.randint(1, size)):
            copy = list(base)
            for _ in range(dice.choice([0, 1, len(base) // 60, len(base) // 40, len(base) // 25])):
                copy[dice.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if k % 5 == 4 else " ".join(copy))
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(30)) for _ in range(60)]
    dice.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, space_of, seed):
    rows = copies(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "one two three"), (9006, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = forest.near_duplicates(df, space_of("f"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_one_region_of_many_sets(spark, space_of):
    """Over a thousand different copies of one text: their orders are far longer than the window, and split over partitions."""
    dice = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(1200):
        copy = list(base)
        for _ in range(dice.randint(0, 4)):
            copy[dice.randrange(200)] = f"x{i}"
        rows.append((i + 5, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = forest.near_duplicates(df, space_of("f"))
    assert found.where("component_id = 5").count() == 1200 and found.where("kept").count() == 1


def test_pairs_at_the_threshold_are_found(spark, space_of):
    """Pairs just over the threshold among texts that are just under it."""
    rows = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(403)]  # 400 shingles
        for copy, changed in ((0, 0), (1, 44), (2, 45)):  # 44 shingles lost of 400: 356 of 444 in common; 45: 355 of 445
            text = [*base[: 403 - changed], *[f"c{copy}g{g}n{i}" for i in range(changed)]]
            rows.append((g * 10 + copy, " ".join(text)))
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), space_of("f")).collect()}
    assert all(got[g * 10 + 1] == g * 10 for g in range(150))
    want = [str((r[0], len(shingle_set(r[1])))) for r in rows]
    assert len(want) == len(got)


def test_walk_over_borders():
    """Neighbours on both sides of a border come out of the second pass."""
    rows = np.zeros((len(forest.ORDER), 40), dtype=np.int64)
    rows[8] = rows[9] = np.arange(40)
    found = forest.neighbours(rows, 3, agree=0)
    assert found.shape[1] == 39 + 38 + 37 and set(found[2]) == {forest.VALUES}
    rows[1, 20:] = 1
    assert not any(x < 20 <= y for x, y in zip(*forest.neighbours(rows, 3, agree=0)[:2], strict=True))
    rows[9, :] = 5  # one group: nothing to link
    assert forest.neighbours(rows, 3, agree=0).shape[1] == 0


def test_sketch_estimates_similarity():
    dice = np.random.default_rng(4)
    for share in (0.3, 0.8, 0.95):
        off = []
        for _ in range(30):
            n = int(dice.integers(50, 2000))
            both = round(n * share)
            pool = dice.integers(0, 1 << 63, size=2 * n - both, dtype=np.uint64)
            x, y = (forest.signature(forest.minhashes(s))[1].view(np.uint64) for s in (pool[:n], pool[n - both :]))
            bits = forest.VALUES - int(np.bitwise_count(x ^ y).sum())
            off.append(bits / forest.VALUES - (1 + both / (2 * n - both)) / 2)
        assert abs(np.mean(off)) < 0.02


def test_edges(spark, edge_docs, no_docs, space_of):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = forest.near_duplicates(edge_docs, space_of("f")).collect()
    empty = [r for r in got if r.n_shingles == 0]
    assert len(got) == len(rows) and all(r.kept and r.component_id == r.doc_id for r in empty)
    # rows of one id link each by its own text: 3 (three times, two texts), 4 and 20 are "one two"
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id in (3, 4, 20)) == [(3, 3), (3, 3), (3, 3), (3, 3), (4, 4), (20, 4)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert forest.near_duplicates(no_docs, space_of("f")).count() == 0


def test_sql(spark, documents, sf_dir, space_of):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = forest.near_duplicates(documents, space_of("f"))
    assert sorted(map(str, map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()))) == sorted(map(str, con.execute(forest.SQL).fetchall()))


def test_names_tell_sets_apart():
    names = {forest.set_name(shingle_hashes(t, 4)) for t in ("a", "b", "a b", "b a", "a b c d", "a b c d e", "b c d e a")}
    assert len(names) == 7
    assert forest.set_name(shingle_hashes("A b C d", 4)) == forest.set_name(shingle_hashes("a  b c\nd", 4))


def test_links_of_a_crowd_that_the_orders_do_not_reach(spark, space_of):
    """Copies of one text that are similar to it and not to each other: the orders show each of many its nearest neighbours only."""
    dice = np.random.default_rng(5)
    base = [f"w{i}" for i in range(203)]  # 200 shingles of four words
    rows = [" ".join(base)]
    for k in range(600):
        copy = list(base)
        for i in np.sort(dice.choice(40, 5, replace=False)):  # 20 shingles go: 180 of 220 are shared, of two copies 160 to 180 of 240
            copy[5 * i + 1] = f"x{k}"
        rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = forest.near_duplicates(docs, space_of("crowd")).collect()
    sets = [set(zip(*(r.split()[i:] for i in range(4)), strict=False)) for r in rows]
    want = [100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets]
    assert sum(want) > 500
    assert all(r.component_id == 0 for r in got if want[r.doc_id])
