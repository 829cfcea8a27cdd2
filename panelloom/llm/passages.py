"""Fuzzy repeated passages by collinear chaining.

Word k-mers picked by winnowing are the seeds. Each seed that several texts
share is matched with its first text only (a star, not all pairs). The matches
of a text with one partner are chained in order: a Fenwick tree over partner
positions gives the best predecessor under linear gap costs. Chains are aligned
word by word: gaps by edit distance, ends by extension. Aligned pieces of a text
that touch form a passage, which counts from MIN_WORDS words on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, held, small_side, spread
from panelloom.llm.simhash import grouped_runs

K = 5
#: A run of K + WINDOW - 1 equal words has a seed in common.
WINDOW = 12
MIN_WORDS = 50
SIMILARITY = 0.8
GAP_COST = 0.1
#: Wider gaps end a chain.
MAX_GAP = 40
#: Words between aligned pieces of one passage.
TOUCH = K
SLACK = K + WINDOW
CACHE_WORDS = 400_000
#: Keys of texts are broadcast up to so many bytes, as the other side has the texts.
KEY_BYTES = 8 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)

def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each white-space separated word, lower-cased."""
    words = (text or "").lower().split()
    known = held("passages", dict)
    new = [w for w in set(words) if w not in known]
    if new:
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def winnow(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the k-mers that are the last smallest of some window."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * _PRIME
        h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    w = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    at = np.empty(len(views), dtype=np.int64)
    for s in range(0, len(views), 1 << 15):
        at[s : s + (1 << 15)] = w - 1 - views[s : s + (1 << 15)].argmin(axis=1)
    at = np.unique(at + np.arange(len(views)))
    return h[at].view(np.int64), at.astype(np.int32)


def numbered(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds, and for each further occurrence of one in its text a seed of its number, too: so the
    occurrences in two texts of one word over and over meet in order and not all with the first."""
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.empty(0, np.int64)
    number = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    later = order[number > 0]
    mixed = (h[later].view(np.uint64) ^ (number[number > 0].astype(np.uint64) * _PRIME)) * _MIX
    return np.concatenate([h, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)]), np.concatenate([pos, pos[later]])


def _seed_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column(1):
            words = word_hashes(t.as_py())
            rows.append((*numbered(*winnow(words)), len(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int32())], ["key", "h", "pos", "n_words"])


def chains(pos: np.ndarray, ref: np.ndarray, k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int]]]:
    """Chains of matches, each a list of (position, partner position) rising in both.

    The score of a chain is k for each match less gap_cost for each word that the
    matches leave uncovered on either side. As the cost is linear, the best
    predecessor of a match is a prefix maximum over partner positions, which the
    Fenwick tree answers. Every match is in one chain at most; chains are taken by
    falling score and cut at gaps over max_gap."""
    order = np.lexsort((-ref, pos))  # of one position, later partners first: none precedes another
    p, r = pos[order].tolist(), ref[order].tolist()
    ranks = {x: i + 1 for i, x in enumerate(sorted(set(r)))}
    n, size = len(p), len(ranks)
    tree_value, tree_at = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    for i in range(n):
        here = gap_cost * (p[i] + r[i])
        best, at, x = -1e18, -1, ranks[r[i]] - 1
        while x:
            if tree_value[x] > best:
                best, at = tree_value[x], tree_at[x]
            x &= x - 1
        gain = best - here + 2 * k * gap_cost
        score[i], back[i] = (k + min(gain, score[at]), at) if at >= 0 and gain > 0 else (float(k), -1)
        value, x = score[i] + here, ranks[r[i]]
        while x <= size:
            if value > tree_value[x]:
                tree_value[x], tree_at[x] = value, i
            x += x & -x
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: -score[i]):
        chain, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((p[i], r[i]))
            i = back[i]
        chain.reverse()
        piece: list[tuple[int, int]] = []
        for m in chain:
            if piece and (m[0] - piece[-1][0] - k > max_gap or m[1] - piece[-1][1] - k > max_gap):
                out.append(piece)
                piece = []
            piece.append(m)
        if piece:
            out.append(piece)
    return out


def _uncovered(pieces: list[tuple[int, int, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """The pieces, by text and start, without single matches inside a longer piece of the text or at the place of the one before."""
    text, reach = None, 0
    for piece in pieces:
        first, last = piece[2][0][0], piece[2][-1][0] + K
        if piece[0] != text:
            text, reach = piece[0], 0
        if len(piece[2]) > 1 or last > reach:
            reach = max(reach, last)
            yield piece


def _chain_runs(min_words: int):
    """Sorted rows (key, ref, pos, ref_pos) to pieces that can be part of a long enough passage."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in grouped_runs(batches):
            key, ref, pos, at = (tab.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]), [True]]))
            pieces: list[tuple[int, int, list[tuple[int, int]]]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # a match by itself is a piece, too: a passage may be put together from texts that share a line each
                found = chains(pos[a:b], at[a:b]) if b - a > 1 else [[(int(pos[a]), int(at[a]))]]
                pieces += [(int(key[a]), int(ref[a]), c) for c in found]
            # pieces of one text that may touch once their ends are extended
            pieces.sort(key=lambda x: (x[0], x[2][0][0], -len(x[2])))
            pieces = list(_uncovered(pieces))
            kept, group, first, last = [], [], 0, 0
            for piece in [*pieces, (None, 0, [(0, 0)])]:
                start = piece[2][0][0]
                if group and (piece[0] != group[0][0] or start > last + 2 * SLACK + TOUCH):
                    if last - first + 2 * SLACK >= min_words:
                        kept += group
                    group = []
                if piece[0] is None:
                    break
                if not group:
                    first, last = start, 0
                group.append(piece)
                last = max(last, piece[2][-1][0] + K)
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()), pa.array([[m[0] for m in x[2]] for x in kept], pa.list_(pa.int32())), pa.array([[m[1] for m in x[2]] for x in kept], pa.list_(pa.int32()))],
                    ["key", "ref", "p", "r"],
                )

    return run


def edit_distance(a: list[int], b: list[int]) -> int:
    """Word edits between two short sequences."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _extend(a: list[int], b: list[int]) -> tuple[int, int]:
    """(words, edits) by which both sequences go on alike: the best prefix at 1 for an equal and -2 for another word, given up at 5 below the best."""
    best = top = score = wrong = edits = 0
    for i in range(min(len(a), len(b))):
        if a[i] == b[i]:
            score += 1
        else:
            score -= 2
            wrong += 1
        if score > top:
            top, best, edits = score, i + 1, wrong
        elif score < top - 5:
            break
    return best, edits


def align(a: list[int], b: list[int], p: list[int], r: list[int], k: int = K) -> tuple[int, int, int, int, int]:
    """(start, end, partner start, partner end, edits) of a chain of matches at p in a and r in b."""
    left, wrong = _extend(a[: p[0]][::-1], b[: r[0]][::-1])
    edits = wrong
    x, y = p[0] + k, r[0] + k
    for i, j in zip(p[1:], r[1:], strict=True):
        if i - x == j - y and i <= x:  # the next match overlaps on the same diagonal
            x, y = i + k, j + k
            continue
        lap = max(0, x - i, y - j)  # matched words count once
        edits += edit_distance(a[x : i + lap], b[y : j + lap])
        x, y = i + k, j + k
    right, wrong = _extend(a[x:], b[y:])
    return p[0] - left, x + right, r[0] - left, y + right, edits + wrong


def _align_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, ref, p, r, a0, b0, a, b in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            s, e, t, u, edits = align(a, b, [x - a0 for x in p], [x - b0 for x in r])
            longer = max(e - s, u - t)
            out.append((key, ref, s + a0, e + a0, t + b0, u + b0, 1 - edits / longer))
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PIECE.types, strict=True)], schema=_PIECE)


_PIECE = pa.schema([("key", pa.int64()), ("ref", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("ref_start", pa.int32()), ("ref_stop", pa.int32()), ("similarity", pa.float64())])


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words for the alignment, told apart by 32 bits of their hashes: two of the few compared are taken for one once in four billion."""
    for batch in batches:
        words = [word_hashes(t.as_py()).astype(np.uint32).view(np.int32) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32()))], ["key", "words"])


def repeated_passages(docs: DataFrame, space: Workspace, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, ref_doc_id, start_word, end_word, ref_start, ref_end, similarity, passage_words, n_copies).

    One row for each aligned piece of a passage that a text shares with an earlier
    chosen text; the ids are those of class representatives (smallest doc_id of
    equal texts). Each other copy of a text of min_words words has one row of its
    own, the whole text against its representative. ref_doc_id is null where the pieces
    of the passage that the other text has reach over fewer than min_words words. n_copies is the number of rows
    of the class of doc_id. Pieces under the similarity, passages under min_words
    and repeats inside one text alone are left out. A very long text is an array of
    word hashes; what is aligned of it are its pieces. Rows with a null doc_id or text have
    no row; repeated rows count as copies in n_copies only. Empty tables give an
    empty result; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("key", F.xxhash64("text"))
    named = rows.select("key", "doc_id")
    classes = space.write(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    # Only copies need to be told apart, so only they travel.
    copies = space.write(named.join(classes.where("n_copies > 1"), "key").where("doc_id <> rep").select("key", "doc_id", "rep").distinct(), "copies")
    singles = spread(rows.join(small_side(copies.select("key", "doc_id"), 24, KEY_BYTES), ["key", "doc_id"], "left_anti").select("key", "text"))
    seeded = space.write(singles.mapInArrow(_seed_rows, "key long, h array<long>, pos array<int>, n_words int"), "seeds")
    seeds = seeded.select("key", F.inline(F.arrays_zip("h", "pos")))
    shared = seeds.groupBy("h").agg(F.min(F.struct("key", "pos")).alias("f"), F.max("key").alias("last")).where("f.key <> last")
    shared = space.write(shared.select("h", F.col("f.key").alias("ref"), F.col("f.pos").alias("ref_pos")), "shared")
    # A passage that a third of the texts have makes hot seeds; the inner join is one that AQE splits.
    matches = seeds.join(shared, "h").where("key <> ref").select("key", "ref", "pos", "ref_pos")
    pieces = matches.distinct().repartition("key").sortWithinPartitions("key", "ref", "pos", "ref_pos").mapInArrow(_chain_runs(min_words), "key long, ref long, p array<int>, r array<int>")
    pieces = space.write(pieces, "pieces")
    wanted = small_side(space.write(pieces.select(F.explode(F.array("key", "ref")).alias("key")).distinct(), "wanted"), 16, KEY_BYTES)
    bodies = space.write(singles.join(wanted, "key", "left_semi").mapInArrow(_bodies, "key long, words array<int>").dropDuplicates(["key"]), "bodies")
    a0, b0 = F.greatest(F.get("p", F.lit(0)) - SLACK, F.lit(0)), F.greatest(F.get("r", F.lit(0)) - SLACK, F.lit(0))
    mine = pieces.join(bodies, "key").select("key", "ref", "p", "r", a0.alias("a0"), b0.alias("b0"), F.slice("words", a0 + 1, F.element_at("p", -1) + K + SLACK - a0).alias("a"))
    both = mine.join(bodies.withColumnsRenamed({"key": "ref", "words": "theirs"}), "ref")
    both = both.select("key", "ref", "p", "r", "a0", "b0", "a", F.slice("theirs", F.col("b0") + 1, F.element_at("r", -1) + K + SLACK - F.col("b0")).alias("b"))
    aligned = space.write(both.mapInArrow(_align_rows, "key long, ref long, start int, stop int, ref_start int, ref_stop int, similarity double").where(F.col("similarity") >= similarity - 1e-9), "aligned")
    along = Window.partitionBy("key").orderBy("start", "stop", "ref", "ref_start")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = aligned.withColumn("new", F.coalesce((F.col("start") > reach + TOUCH).cast("int"), F.lit(0))).withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("key", "part")
    passages = parted.withColumn("passage_words", F.max("stop").over(whole) - F.min("start").over(whole)).where(F.col("passage_words") >= min_words)
    # A text that has only a line of the passage is no partner of it: its piece stays, its id is left out.
    along_both = Window.partitionBy("key", "part", "ref")
    passages = passages.withColumn("partner", F.max("stop").over(along_both) - F.min("start").over(along_both) >= min_words)
    mates = classes.select(F.col("key").alias("ref"), F.col("rep").alias("ref_doc_id"))
    found = passages.join(classes, "key").join(mates, "ref").select(F.col("rep").alias("doc_id"), F.when(F.col("partner"), F.col("ref_doc_id")).alias("ref_doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("end_word"), "ref_start", F.col("ref_stop").alias("ref_end"), F.round("similarity", 6).alias("similarity"), "passage_words", "n_copies")
    # The words of a class are those of its representative.
    sizes = seeded.select("key", "n_words").where(F.col("n_words") >= min_words).join(classes.where("n_copies > 1"), "key").groupBy("key", "n_copies").agg(F.min("n_words").alias("n"))
    whole_copies = copies.join(sizes, "key").select("doc_id", F.col("rep").alias("ref_doc_id"), F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.lit(0).alias("ref_start"), F.col("n").alias("ref_end"), F.lit(1.0).alias("similarity"), F.col("n").alias("passage_words"), "n_copies")
    return found.unionByName(whole_copies)
