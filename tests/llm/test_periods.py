import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from panelloom.llm import periods as pr


def brute_runs(words, least=24, periods=3):
    """Every period, word by word; a stretch counts under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(kept))


def sequences():
    dice = random.Random(5)
    for k in range(300):
        letters = dice.choice([1, 2, 3, 8, 50])
        out = []
        while len(out) < dice.choice([0, 5, 30, 120, 300]):
            part = [dice.randrange(letters) for _ in range(dice.randint(1, 12))]
            out += part * dice.choice([1, 1, 3, 4, 9])
        yield out
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - x for x in thue]
    yield thue  # polynomial hashes modulo a power of two meet on it
    yield thue[:2048] + [1 - x for x in thue[:2048]] * 3
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


@pytest.mark.parametrize("points", [1, 50, 1 << 18])
def test_runs_against_brute_force(points):
    found = 0
    for seq in sequences():
        if len(seq) > 1000 and points == 1:
            continue
        got = pr.grid_runs(np.array(seq, dtype=np.int64), points=points)
        assert got == brute_runs(seq), seq[:50]
        found += len(got)
    assert found > 200


def test_least_lengths():
    """Runs of exactly the least length and one word less, for every period."""
    for q in range(1, 40):
        for size, there in ((max(24, 3 * q), 1), (max(24, 3 * q) - 1, 0)):
            seq = [1000 + i for i in range(7)] + [i % q for i in range(size)] + [2000 + i for i in range(5)]
            assert pr.grid_runs(np.array(seq)) == [(7, size, q)] * there


def test_hashes_that_meet_are_told_apart(monkeypatch):
    monkeypatch.setattr(pr._Prefix, "same", lambda self, x, q, size: np.ones(len(x), dtype=bool))
    seq = [9, 8] + [0, 1, 2] * 10 + [7] + [5] * 30 + [6]
    assert pr.grid_runs(np.array(seq)) == brute_runs(seq)


def test_query_against_brute_force(spark, documents):
    dice = random.Random(9)
    rows = [(i, dice.choice([" ", "\n", " \t\x0b"]).join(dice.choices(["a", "b", "é", "日本", "x\x1c", "A"], k=dice.randint(0, 200)))) for i in range(300)]
    rows += [(r.doc_id, r.text) for r in documents.collect() if len(r.text) < 6000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pr.run_digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(str(brute(*r)) for r in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert sum(brute(*r)[1] > 0 for r in rows) > 20


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    short = [r for r in rows if len(r[1] or "") < 10_000]
    got = [tuple(r) for r in pr.run_digests(edge_docs).collect()]
    assert len(got) == len(rows) and not {str(brute(*r)) for r in short} - {str(r) for r in got}
    assert pr.run_digests(no_docs).count() == 0
    one = spark.createDataFrame([(None, "la " * 30)], "doc_id long, text string")
    assert [tuple(r)[1:6] for r in pr.run_digests(one).collect()] == [(1, 0, 30, 1, 30000)]
    assert [r.collapsed for r in pr.periodic_runs(one).collect()] == ["la"]
