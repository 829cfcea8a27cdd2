"""Exact links of sets by Jaccard similarity: prefixes of the sets in one order.

Two sets of similarity s have at least s times the larger one in common. So if each
is filed under its smallest elements, all but so many that the rest is too few, the
two meet under an element. No pair is lost, whatever the size of a group. What
meets is ruled out by bounds that never rule out a link (sizes, and bits that say of
how many elements in each bucket the number is odd), and the rest is left to a check
of the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace
from panelloom.llm.graph import components
from panelloom.llm.runs import grouped_runs

#: Words of 64 bits of a set's parities.
WORDS = 16
#: Sets under a key up to which runs are compared together.
FEW = 48
#: Sets that are held against a stretch of a run at once, and the sets of the stretch.
ROWS, TILE = 256, 4096


def prefix(elements: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest elements (of a sorted set of hashes), of which two sets that are similar enough share one."""
    n = len(elements)
    return elements[: n - ceil(similarity * n - 1e-9) + 1] if n else elements


def parities(elements: np.ndarray) -> np.ndarray:
    """Bits of the buckets with an odd number of elements: two sets differ in at least as many elements as bits."""
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def wide_parities(elements: np.ndarray) -> np.ndarray:
    """Parities in as many buckets as a set has elements, or up to twice as many: they tell large sets apart, too.

    The words are a power of two. Half as many are those of the halves XORed."""
    words = 1 << max(0, ceil(log2(max(len(elements), 1) / 64)))
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def may_link(n: Column, m: Column, p: Column, q: Column, similarity: float) -> Column:
    """Do the sizes and the wide parities of two sets let them be similar enough?"""
    words = F.least(F.size(p), F.size(q))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > words, F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda a, b: a.bitwiseXOR(b))).otherwise(x)

    far = F.aggregate(F.zip_with(folded(p), folded(q), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    near = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
    return F.when(near, far <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6).otherwise(F.lit(False))


def shingle_batch(names: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (node, shingles, n, odd) of sets of shingle hashes, as ``Shingles`` reads them."""
    longs = pa.list_(pa.int64())
    columns = [pa.array([x.view(np.int64) for x in sets], longs), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(wide_parities, sets)), longs)]
    return pa.RecordBatch.from_arrays([names, *columns], ["node", "shingles", "n", "odd"])


#: Columns of shingle_batch.
SHINGLE_ROWS = "node long, shingles array<long>, n long, odd array<long>"


def possible(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    far = np.bitwise_count(bits[:, i] ^ bits[:, j]).sum(axis=0, dtype=np.int64)
    return (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6) & (far <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6)


def possible_pairs(n: np.ndarray, bits: np.ndarray, root: np.ndarray, similarity: float, nearest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of different roots that the bounds allow, in parts; the memory is a tile's.

    Of two roots one is not the largest of the run, so only the sets of the others are held
    against all. With ``nearest`` each of them is paired with the likeliest only, the first of equals."""
    order = np.argsort(n, kind="stable")
    n, bits = n[order], bits[:, order]
    _, root, members = np.unique(root[order], return_inverse=True, return_counts=True)
    asking = root != members.argmax()
    every = np.flatnonzero(asking)
    for k in range(0, len(every), ROWS):
        rows = every[k : k + ROWS]
        start = int(np.searchsorted(n, similarity * n[rows[0]] - 1e-6))
        stop = int(np.searchsorted(similarity * n - 1e-6, n[rows[-1]], side="right"))
        best, at = np.full(len(rows), np.inf), np.full(len(rows), -1)
        for c in range(start, stop, TILE):
            d = min(c + TILE, stop)
            far = np.bitwise_count(bits[0, rows, None] ^ bits[0, None, c:d]).astype(np.uint16)
            for w in range(1, len(bits)):
                far += np.bitwise_count(bits[w, rows, None] ^ bits[w, None, c:d])
            most = ((1 - similarity) / (1 + similarity) * (n[rows] + n[d - 1]) + 1e-6)[:, None]
            i, j = np.nonzero((far <= most) & (root[rows, None] != root[None, c:d]))
            far = far[i, j]
            j += c
            good = possible(n, bits, rows[i], j, similarity)
            i, j, far = i[good], j[good], far[good]
            if not len(i):
                continue
            if nearest:
                share = far / (n[rows[i]] + n[j])
                first = np.lexsort((j, share, i))
                first = first[np.concatenate([[True], i[first][1:] != i[first][:-1]])]
                closer = first[share[first] < best[i[first]]]
                best[i[closer]], at[i[closer]] = share[closer], j[closer]
                continue
            i = rows[i]
            good = (i < j) | ~asking[j]  # two that ask would be met from either side
            yield order[i[good]], order[j[good]]
        if (at >= 0).any():
            yield order[rows[at >= 0]], order[at[at >= 0]]


def few_pairs(key: np.ndarray, n: np.ndarray, bits: np.ndarray, root: np.ndarray, similarity: float, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As possible_pairs, of many short runs of equal keys at once: rows are held against those so many places further."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, len(key)):
        same = key[k:] == key[:-k]
        if not same.any():
            break
        at = np.flatnonzero(same & (root[k:] != root[:-k]))
        at = at[possible(n, bits, at, at + k, similarity)]
        left.append(at)
        right.append(at + k)
    i, j = np.concatenate(left), np.concatenate(right)
    if nearest and len(i):
        share = np.bitwise_count(bits[:, i] ^ bits[:, j]).sum(axis=0, dtype=np.int64) / (n[i] + n[j])
        one, two, share = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
        order = np.lexsort((two, share, one))
        one, two = one[order], two[order]
        first = np.concatenate([[True], one[1:] != one[:-1]])
        i, j = one[first], two[first]
    return i, j


def _across(similarity: float, nearest: bool):
    """Rows (key, node, root, n, parity words) in runs of keys to pairs (a, b) of nodes of different roots."""

    def batch(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.sort(np.stack([node[i], node[j]]), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in grouped_runs(batches, least=50_000):
            key, node, root, n, *words = (tab.column(k).to_numpy() for k in range(tab.num_columns))
            bits, n = np.stack(words).view(np.uint64), n.astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(cuts)
            few = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
            i, j = few_pairs(key[few], n[few], bits[:, few], root[few], similarity, nearest)
            if len(i):
                yield batch(node, few[i], few[j])
            for k in np.flatnonzero(size > FEW).tolist():
                at = slice(int(cuts[k]), int(cuts[k + 1]))
                if (root[at] != root[at.start]).any():
                    for i, j in possible_pairs(n[at], bits[:, at], root[at], similarity, nearest):
                        yield batch(node[at], i, j)

    return run


def filed_sets(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of sets(node, keys) under the keys that sets of different roots(node, root) have; sets without a root are groups by themselves."""
    rooted = sets.select("node", "keys").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    return of_many_roots(rooted)


def of_many_roots(rooted: DataFrame) -> DataFrame:
    """Rows of rooted(key, node, root) whose key is not of one root only."""
    by = Window.partitionBy("key")
    return rooted.withColumn("low", F.min("root").over(by)).withColumn("high", F.max("root").over(by)).where("low < high").select("key", "node", "root")


def pairs_across(shared: DataFrame, sets: DataFrame, similarity: float, nearest: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of sets(node, n, parity) of different roots that share a key in shared(key, node, root) and may be similar enough.

    With ``nearest`` every set has one pair under a key at most, so that pairs grow with the sets."""
    wide = sets.select("node", "n", *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(WORDS)])
    rows = shared.join(wide, "node").select("key", "node", "root", "n", *[f"p{k}" for k in range(WORDS)])
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_across(similarity, nearest), "a long, b long").distinct()


class Shingles:
    """Shingle sets of the nodes that pairs need, each read once; ``read`` gives (node, shingles, n, odd) of a table of nodes."""

    def __init__(self, read: Callable[[DataFrame, str], DataFrame], space: Workspace):
        self.read, self.space, self.held, self.reads = read, space, None, 0

    def confirm(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """The written pairs(a, b, ...) with ``linked``: is the Jaccard similarity of the full sets high enough?

        Sizes and wide parities, an element in 64 of the sets, rule most others out
        first, so that full sets go to few pairs beyond the links."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if self.held is not None:
            nodes = nodes.join(self.held.select("node"), "node", "left_anti")
        self.reads += 1
        more = self.read(nodes, str(self.reads))
        self.held = more if self.held is None else self.held.unionByName(more)
        narrow = self.held.drop("shingles")
        both = pairs.join(narrow.withColumnsRenamed({"node": "a", "n": "_n", "odd": "_p"}), "a").join(narrow.withColumnsRenamed({"node": "b", "n": "_m", "odd": "_q"}), "b")
        told = self.space.write(both.select(*pairs.columns, may_link(*map(F.col, ("_n", "_m", "_p", "_q")), similarity).alias("maybe")), f"told-{self.reads}")
        full = self.held.select("node", "shingles")
        found = told.where("maybe").drop("maybe").join(full.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(full.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
        n = F.size(F.array_intersect("x", "y"))
        found = found.select(*pairs.columns, (100 * n >= round(100 * similarity) * (F.size("x") + F.size("y") - n)).alias("linked"))
        return found.unionByName(told.where("not maybe").select(*pairs.columns, F.lit(False).alias("linked")))


def join_rest(sets: DataFrame, roots: DataFrame, tried: DataFrame, shingles: Shingles, space: Workspace, similarity: float) -> DataFrame:
    """roots(node, root) of all links of sets(node, n, parity, keys), where ``tried`` (a, b, linked) holds what was found and ruled out before.

    First each set is tried with the likeliest of another group under each of its keys,
    again and again as long as most of these are links, so that a crowd becomes few groups;
    then all pairs of different groups that are left. None that may be a link stays untried."""
    shared = space.write(filed_sets(sets, roots), "shared-0")
    k, nearest, last = 0, True, False
    while not last:
        k, last = k + 1, not nearest
        pairs = space.write(pairs_across(shared, sets, similarity, nearest).join(tried.select("a", "b"), ["a", "b"], "left_anti"), f"rest-{k}")
        n = pairs.count()
        if n:
            done = space.write(shingles.confirm(pairs, similarity), f"rest-done-{k}")
            tried = tried.unionByName(done)
        found = done.where("linked").count() if n else 0
        if found:
            roots = space.write(components(tried.where("linked").select("a", "b"), space, f"rest-cc-{k}"), f"rest-roots-{k}")
            if not last:
                shared = space.write(of_many_roots(shared.drop("root").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))), f"shared-{k}")
        nearest = 2 * found > n
    return roots
