import numpy as np
import pytest

from panelloom.llm import jaccard


def sets_of(seed, runs):
    """(key, n, parity words, root, sets) of runs of near copies, of sizes about the threshold."""
    dice = np.random.default_rng(seed)
    key, sets, root = [], [], []
    for k, size in enumerate(runs):
        base = dice.integers(0, 1 << 63, 120, dtype=np.uint64)
        for _ in range(size):
            gone = int(dice.integers(0, 22))
            sets.append(np.unique(np.concatenate([base[dice.permutation(120)[gone:]], dice.integers(0, 1 << 63, int(dice.integers(0, 6)), dtype=np.uint64)])))
            key.append(k)
            root.append(int(dice.integers(0, 3)) + 10 * k)
    n = np.array([len(x) for x in sets])
    bits = np.stack([jaccard.parities(x) for x in sets], axis=1).view(np.uint64)
    return np.array(key), n, bits, np.array(root), sets


def linked(sets, i, j):
    both = len(np.intersect1d(sets[i], sets[j]))
    return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)


@pytest.mark.parametrize("many", [False, True])
def test_no_link_between_roots_is_ruled_out(many, monkeypatch):
    monkeypatch.setattr(jaccard, "ROWS", 7)
    monkeypatch.setattr(jaccard, "TILE", 11)
    key, n, bits, root, sets = sets_of(3, [60] if many else [2, 3, 1, 17, 9])
    want = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if key[i] == key[j] and root[i] != root[j] and linked(sets, i, j)}

    def found(nearest):
        parts = list(jaccard.possible_pairs(n, bits, root, 0.8, nearest)) if many else [jaccard.few_pairs(key, n, bits, root, 0.8, nearest)]
        pairs = [(min(a, b), max(a, b)) for x, y in parts for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert all(root[a] != root[b] and key[a] == key[b] for a, b in pairs)
        return pairs

    every = found(False)
    assert len(want) > 20 and want <= set(every) and len(every) == len(set(every))
    # one pair for each set at most, and one for each that has any but for those of the largest root
    near = found(True)
    assert set(near) <= set(every) and len(near) <= len(n)
    _, of, members = np.unique(root, return_inverse=True, return_counts=True)
    asking = {i for p in every for i in p if not many or of[i] != members.argmax()}
    assert asking <= {i for p in near for i in p}


def test_wide_parities_rule_out_large_sets_but_no_link(spark, space_of):
    from pyspark.sql import functions as F

    dice = np.random.default_rng(5)
    base = dice.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[gone:], dice.integers(0, 1 << 63, new, dtype=np.uint64)])) for gone, new in ((0, 0), (444, 0), (0, 1000), (400, 300), (445, 444), (801, 0), (0, 1001))]
    sets += [dice.integers(0, 1 << 63, k, dtype=np.uint64) for k in (4000, 4097, 5000)] + [base[:1], base[:2], base[:60], base[:75]]
    rows = [(k, [int(y) for y in x.view(np.int64)], len(x), [int(y) for y in jaccard.wide_parities(x)]) for k, x in enumerate(sets)]
    made = spark.createDataFrame(rows, jaccard.SHINGLE_ROWS)
    space = space_of("wide")
    reader = jaccard.Shingles(lambda nodes, name: space.write(made.join(nodes, "node", "left_semi"), f"read-{name}"), space)
    pairs = space.write(spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))], "a long, b long"), "pairs")
    done = reader.confirm(pairs, 0.8).collect()
    assert len(done) == pairs.count()
    assert {(r.a, r.b): r.linked for r in done} == {(r.a, r.b): linked(sets, r.a, r.b) for r in done}
    # full sets go to few pairs beyond the links
    maybe = space.read("told-1").where("maybe").select("a", "b")
    assert not maybe.where(F.col("a").isin(7, 8, 9) | F.col("b").isin(7, 8, 9)).count()
