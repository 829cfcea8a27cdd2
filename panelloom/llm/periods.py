"""Periodic runs: stretches of words that repeat themselves over and over.

Two words a period apart are equal all along a run but for its last period. For
each period these equal stretches have a least length, so grid points that far
apart meet every one of them: a harmonic grid, of about n log n points for all
periods together. Where the words at a grid point and a period on are equal, how far
they stay so in both directions is found by a binary search over prefix hashes, for
all periods and points at once in NumPy. What is found is compared word by word,
and a stretch that comes up at several points or multiples of its period counts once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import held, release, spread

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid points that are looked at together.
POINTS = 1 << 18
#: Bytes of texts in one Arrow batch of results.
BATCH_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base, kept in the worker and made longer as needed."""
    kept = held("powers", lambda: [np.ones(1, dtype=np.uint64)])
    if len(kept[0]) < n:
        kept[0] = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(n, 1 << 12), _BASE)]))
    return kept[0]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, others do not."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


class _Prefix:
    """Prefix hashes of a sequence: equal stretches have equal hashes, whatever else may."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.power = _powers(self.n + 1)
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * self.power[: self.n], dtype=np.uint64)])

    def same(self, x: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Are the stretches of so many words at x and at x + q equal?"""
        s = self.sums
        return (s[x + size] - s[x]) * self.power[q] == s[x + q + size] - s[x + q]

    def ahead(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For all pairs at once: how many words from x on equal those from x + q on."""
        most = self.n - q - x
        found = np.zeros(len(x), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            able = np.flatnonzero(found + step <= most)
            good = able[self.same(x[able] + found[able], q[able], np.int64(step))]
            found[good] += step
            step >>= 1
        return found

    def behind(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words just before x equal those before x + q."""
        found = np.zeros(len(x), dtype=np.int64)
        step = 1 << int(x.max(initial=0)).bit_length()
        while step:
            able = np.flatnonzero(found + step <= x)
            good = able[self.same(x[able] - found[able] - step, q[able], np.int64(step))]
            found[good] += step
            step >>= 1
        return found


def grid_runs(ids: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, points: int = POINTS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the numbered words, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    prefix = _Prefix(ids)
    q = np.arange(1, n // periods + 1)
    apart = np.maximum(least, periods * q) - q  # the least length of an equal stretch
    count = np.maximum(0, -((q - n) // apart))  # grid points whose word a period on exists
    until = np.cumsum(count)
    found: dict[tuple[int, int], int] = {}
    low = 0
    while low < len(q):
        high = max(low + 1, int(np.searchsorted(until, (until[low - 1] if low else 0) + points, side="right")))
        many = count[low:high]
        period = np.repeat(q[low:high], many)
        first = np.repeat(np.cumsum(many) - many, many)
        x = (np.arange(len(period)) - first) * np.repeat(apart[low:high], many)
        equal = np.flatnonzero(ids[x] == ids[x + period])
        low = high
        if not len(equal):
            continue
        x, period = x[equal], period[equal]
        start = x - prefix.behind(x, period)
        size = x - start + prefix.ahead(x, period)
        long = np.flatnonzero(size + period >= np.maximum(least, periods * period))
        for s, m, p in set(zip(start[long].tolist(), size[long].tolist(), period[long].tolist(), strict=True)):
            for a, length in _verified(ids, s, m, p):
                if length >= max(least, periods * p) and found.get((a, length), p) >= p:
                    found[a, length] = p
    return sorted((s, m, p) for (s, m), p in found.items())


def _verified(ids: np.ndarray, start: int, size: int, period: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretch, word by word; if hashes met by chance, all stretches of the period."""
    if np.array_equal(ids[start : start + size], ids[start + period : start + period + size]):
        yield start, size + period
        return
    same = ids[: len(ids) - period] == ids[period:]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield a, b - a + period


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    s, m, p = np.array(runs).T
    np.add.at(gone, s + p, 1)
    np.add.at(gone, s + m, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


Edit = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs(doc_id, text).

    ``runs`` is an array of (start, length, period) in words, by start, then period:
    stretches of LEAST_WORDS words and LEAST_PERIODS periods at least that no
    neighbouring word extends, each under its smallest period. ``collapsed`` is the
    text's words, joined by a space, without what a run has after its first period.
    ``edit`` may change the words of a row first. Null, empty and blank texts have no
    words and no run. Rows that repeat are each returned; a null doc_id is carried; an
    empty table gives an empty result; extra columns are ignored. A very long text is
    handled whole: beside its words stand two arrays of their number, and its grid is
    looked at in pieces of POINTS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        for batch in batches:
            texts = batch.column(1).view(pa.binary())
            rows: list[tuple] = []
            size = 0
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                words = _WORD.findall(texts[k].as_py() or b"")
                if edit is not None:
                    words = edit(doc_id, words)
                runs = grid_runs(numbered(words))
                text = b" ".join(collapsed(words, runs))
                rows.append((doc_id, len(words), [{"start": s, "length": m, "period": p} for s, m, p in runs], text))
                size += len(text) + 48 * len(runs)
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    ids, n, found, out = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(out, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    rows, size = [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def most_periodic(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equals the first by start, then period. Null without a run."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth id (by its crc32) with a part repeated to the end: test material of the query. A null id plants nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """What ``periodic_runs`` finds in the documents after ``planted``: counts, the most periodic run, digests."""
    found = periodic_runs(docs, planted).withColumn("best", most_periodic(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    every = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
