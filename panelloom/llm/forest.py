"""MinHash near-duplicates by an LSH forest.

A text is the set of its word shingles. Each tree of the forest is an order of the
sets by a label of several MinHash values, one after the other; sets that share a
long prefix of the label are likely similar. A set's candidates are the neighbours
in each order with which it shares the longest prefixes. So the depth adapts to the
region: where few sets share a prefix, the neighbours reach down to the least depth,
and in a crowded region only the deepest prefixes are near enough. Bits of more
MinHash values travel along and tell hopeless candidates; the rest is compared on the
full sets. An order is a range partitioning, so a region of any size is dealt over
many tasks, and what lies on both sides of a border meets in a second, small pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, release, small_side, spread
from panelloom.llm.graph import components
from panelloom.llm.jaccard import SHINGLE_ROWS, WORDS, Shingles, join_rest, parities, possible, prefix, shingle_batch
from panelloom.llm.simhash import scramble, shingle_hashes

SHINGLE_WORDS, SIMILARITY = 4, 0.8
#: Trees, MinHash values in a label (16 bits each), and the least prefix that counts. Two sets of
#: similarity 0.8 share the least prefix in no tree once in a hundred thousand times.
TREES, DEPTH, LEAST_DEPTH = 16, 8, 3
#: MinHash values of a set, of which the trees take the first 128; a bit of each is its sketch.
VALUES = 256
#: Neighbours on each side in an order, and the trees that are followed first, with one neighbour.
NEAR, CHAIN_TREES = 16, 2
#: Sketch bits that candidates agree in at least: four deviations under what similarity 0.8 has.
AGREE = 211
#: Shingles hashed at once.
PIECE = 1024
#: Rows of an order in a partition, at least.
LEAST_ROWS = 4096

_dice = np.random.default_rng(20_121)
_SLOPES = _dice.integers(0, 1 << 32, size=(VALUES, 1), dtype=np.uint32) | np.uint32(1)
_SHIFTS = _dice.integers(0, 1 << 32, size=(VALUES, 1), dtype=np.uint32)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set (of one shingle at least), mixed."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), PIECE):
        y = _SLOPES * x[k : k + PIECE]
        y += _SHIFTS
        np.minimum(least, y.min(axis=1), out=least)
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    least ^= least >> np.uint32(12)
    least *= np.uint32(0x297A2D39)
    return least ^ (least >> np.uint32(15))


def signature(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, sketch): two words for the label of each tree, and the lowest bits of all values in four."""
    labels = (values[: TREES * DEPTH] >> np.uint32(16)).astype(">u2").view(">i8").astype(np.int64)
    sketch = np.packbits((values & np.uint32(1)).astype(np.uint8)).view(">i8").astype(np.int64)
    return labels, sketch


def set_name(shingles: np.ndarray) -> int:
    """By what sets are told apart."""
    return int(scramble(np.bitwise_xor.reduce(scramble(shingles), keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def _sign(similarity: float):
    """Rows (doc_id, body, text) to their sets: names, labels and sketches for the forest, sizes, parities and prefixes for the rest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, node, labels, sketch, parity, keys = [], [], [], [], [], []
            for text in batch.column(2):
                shingles = shingle_hashes(text.as_py(), SHINGLE_WORDS)
                n.append(len(shingles))
                if not len(shingles):
                    for column in (node, labels, sketch, parity, keys):
                        column.append(None)
                    continue
                x, y = signature(minhashes(shingles))
                node.append(set_name(shingles))
                labels.append(x)
                sketch.append(y)
                parity.append(parities(shingles))
                keys.append(prefix(shingles, similarity).view(np.int64))
            longs = pa.list_(pa.int64())
            lists = [pa.array(x, longs) for x in (labels, sketch, parity, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *lists], ["doc_id", "body", "n_shingles", "node", "labels", "sketch", "parity", "keys"])

    return run


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(t.as_py(), SHINGLE_WORDS) for t in batch.column(1)]
        yield shingle_batch(batch.column(0), sets)


#: Words of the parities that travel along: those of a set, folded.
FOLDED = 8
#: Columns of a row of an order: border (0 in the main pass), tree, the label's two words, the sketch, the set, its group, size and parities.
ORDER = ("border", "tree", "high", "low", "s0", "s1", "s2", "s3", "node", "root", "n", *(f"p{k}" for k in range(FOLDED)))
PAIR = ("a", "b", "bits", "root_a", "root_b")


def neighbours(rows: np.ndarray, near: int = NEAR, least: int = LEAST_DEPTH, agree: int = AGREE, similarity: float = SIMILARITY) -> np.ndarray:
    """Columns of PAIR, a < b: rows, in order, with up to ``near`` next ones of another group that share so deep a prefix and so many bits;
    what sizes and parities rule out is no link and left out."""
    size, parity = rows[10], rows[11:].view(np.uint64)
    found = [np.empty((len(PAIR), 0), np.int64)]
    high = rows[2].view(np.uint64)
    for k in range(1, min(near, rows.shape[1] - 1) + 1):
        at = np.flatnonzero((((high[k:] ^ high[:-k]) >> np.uint64(64 - 16 * least)) == 0) & (rows[1, k:] == rows[1, :-k]) & (rows[0, k:] == rows[0, :-k]))
        if not len(at):
            break  # rows in between share the prefix, too
        at = at[rows[9, at] != rows[9, at + k]]
        bits = VALUES - np.bitwise_count((rows[4:8, at] ^ rows[4:8, at + k]).view(np.uint64)).sum(axis=0, dtype=np.int64)
        good = (bits >= agree) & possible(size, parity, at, at + k, similarity)
        left, right = rows[8:10, at[good]], rows[8:10, at[good] + k]
        turned = left[0] > right[0]
        left, right = np.where(turned, right, left), np.where(turned, left, right)
        found.append(np.stack([left[0], right[0], bits[good], left[1], right[1]]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _walk(borders: bool, near: int, similarity: float):
    """Over the rows of one partition in their order: candidates, and where ``borders``, the first and last rows under the number of the border that they are at."""

    def batch_of(rows: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        is_pair = np.arange(pairs.shape[1] + rows.shape[1]) < pairs.shape[1]
        columns = [pa.array(np.concatenate([p, rows[8]]), mask=~is_pair) for p in pairs]
        columns += [pa.array(np.concatenate([pairs[0], r]), mask=is_pair) for r in rows]
        return pa.RecordBatch.from_arrays(columns, [*PAIR, *ORDER])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = np.empty((len(ORDER), 0), np.int64)
        held, head = none, none
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(ORDER))])
            if head.shape[1] < near:
                head = np.concatenate([head, rows[:, : near - head.shape[1]]], axis=1)
            rows = np.concatenate([held, rows], axis=1)
            yield batch_of(none, neighbours(rows, near, similarity=similarity))
            held = rows[:, -near:]
        if borders and held.shape[1]:
            edges = np.concatenate([head, held], axis=1)
            edges[0] = np.repeat([part, part + 1], [head.shape[1], held.shape[1]])
            yield batch_of(edges, np.empty((len(PAIR), 0), np.int64))

    return run


def candidates(sets: DataFrame, space: Workspace, name: str, trees: int = TREES, near: int = NEAR, similarity: float = SIMILARITY) -> DataFrame:
    """Columns of PAIR of sets(node, labels, sketch, n, parity, root): neighbours of other groups in the orders of the first ``trees`` trees, each pair once."""
    spark = sets.sparkSession
    longs = ", ".join(f"{c} long" for c in (*PAIR, *ORDER))
    labels = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("long").alias("tree"), F.get("labels", 2 * t).alias("high"), F.get("labels", 2 * t + 1).alias("low")))
    folded = [F.get("parity", F.lit(k)) for k in range(WORDS)]
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), folded[k::FOLDED]).alias(f"p{k}") for k in range(FOLDED)]
    rows = sets.select("node", "root", "sketch", "n", *folded, F.explode(labels).alias("t")).select(F.lit(0).cast("long").alias("border"), "t.tree", "t.high", "t.low", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(4)], "node", "root", "n", *[f"p{k}" for k in range(FOLDED)])
    parts = max(1, min(sets.count() * trees // LEAST_ROWS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    order = ["border", "tree", "high", "low", "node"]
    ranged = rows.repartitionByRange(parts, *order[1:]).sortWithinPartitions(*order[1:])
    walked = space.write(ranged.mapInArrow(_walk(True, near, similarity), longs), name)
    pairs = walked.where("a is not null").select(*PAIR)
    if parts > 1:  # so many rows for each border: a small table
        edges = walked.where("a is null").select(*ORDER).repartition("border").sortWithinPartitions(*order)
        pairs = pairs.unionByName(edges.mapInArrow(_walk(False, near, similarity), longs).select(*PAIR))
    return pairs.distinct()


def crowded(sets: DataFrame, near: int) -> DataFrame:
    """Nodes of the sets that share the least prefix of a tree with more others than are looked at: only of these can a link be missed by that."""
    words = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.shiftrightunsigned(F.get("labels", 2 * t), 64 - 16 * LEAST_DEPTH).alias("start")))
    rows = sets.select("node", F.explode(words).alias("w")).select("node", "w.*")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("tree", "start"))).where(F.col("n") > near + 1).select("node").distinct()


def similar_sets(docs: DataFrame, sets: DataFrame, space: Workspace, similarity: float = SIMILARITY, near: int = NEAR) -> DataFrame:
    """(node, root) of the sets that links of Jaccard similarity connect; docs(body, text), sets(node, body, n, labels, sketch, parity, keys).

    What is connected needs no more links. So first the orders of CHAIN_TREES are
    followed, each set with the next one, which makes few groups of a crowd of
    copies; then all orders, with pairs between groups only: of every two groups the
    likeliest pair, and where that is no link all others of the two. In a crowd a set
    has more neighbours than are looked at; what links of different groups are left
    there share an element of their prefixes, and all that may be one are tried."""

    def read(nodes: DataFrame, name: str) -> DataFrame:
        wanted = space.write(sets.select("node", "body").join(nodes, "node", "left_semi"), f"wanted-{name}")
        texts = docs.join(small_side(wanted, 16), "body").select("node", "text").dropDuplicates(["node"])
        return space.write(texts.mapInArrow(_shingle_sets, SHINGLE_ROWS), f"shingles-{name}")

    shingles = Shingles(read, space)
    alone = sets.withColumn("root", F.col("node"))
    pairs = space.write(candidates(alone, space, "chain", CHAIN_TREES, 1, similarity).select("a", "b"), "pairs-1")
    done = space.write(shingles.confirm(pairs, similarity), "round-1")
    roots = space.write(components(done.where("linked"), space, "forest-1"), "roots-1")
    rooted = sets.join(small_side(roots, 24), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = (F.least("root_a", "root_b").alias("r"), F.greatest("root_a", "root_b").alias("s"))
    pairs = candidates(rooted, space, "forest", TREES, near, similarity).select("a", "b", "bits", *groups)
    pairs = space.write(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "pairs-2")
    # Of equal pairs a hash chooses, so that no set is everyone's partner.
    likeliest = F.max_by(F.struct("a", "b"), F.struct("bits", F.xxhash64("a", "b"))).alias("p")
    first = space.write(pairs.groupBy("r", "s").agg(likeliest).select("r", "s", "p.a", "p.b"), "first")
    first = space.write(shingles.confirm(first, similarity), "round-2")
    rest = pairs.select("a", "b", "r", "s").join(first.where("not linked").select("r", "s", F.col("a").alias("tried"), F.col("b").alias("with")), ["r", "s"]).where("a <> tried or b <> with")
    more = space.write(shingles.confirm(space.write(rest.select("a", "b"), "others"), similarity), "round-3")
    tried = done.unionByName(first.select("a", "b", "linked")).unionByName(more)
    roots = space.write(components(tried.where("linked"), space, "forest-2"), "roots-2")
    crowd = sets.join(small_side(space.write(crowded(sets, near), "crowded"), 8), "node", "left_semi")
    return join_rest(crowd, roots, tried, shingles, space, similarity)


def near_duplicates(docs: DataFrame, space: Workspace, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    n_shingles is the number of distinct shingles (of a shorter text all its words are
    one), component_id the smallest doc_id that links reach, itself included, kept
    whether it is the row's own. Null and wordless texts have an empty set, link with
    nothing and are kept. A null doc_id keeps its row and never is a smallest id; a
    component of null ids only has a null component_id and keeps them. Rows that
    repeat are each returned, rows that share an id are linked each by its own
    text. An empty table gives an empty result; extra columns are ignored. A very long
    text is one array of shingle hashes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("body"), F.col("text").cast("string").alias("text"))
    signed = space.write(spread(texts).mapInArrow(_sign(similarity), "doc_id long, body long, n_shingles long, node long, labels array<long>, sketch array<long>, parity array<long>, keys array<long>"), "signed")
    worded = signed.where("node is not null")
    # Copies meet in the partial step of the aggregate first.
    sets = space.write(worded.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("body").alias("body"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("labels", "sketch", "parity", "keys")]), "sets")
    roots = similar_sets(texts.select("body", "text"), sets, space, similarity)
    merged = sets.select("node", "first").join(small_side(roots, 16), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    label = merged.join(merged.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    # A set that a third of all rows have is a hot key here; the inner join of narrow rows is one that AQE splits.
    found = worded.select("doc_id", "n_shingles", "node").join(label, "node").drop("node")
    alone = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_CAPS, _LOWS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same by DuckDB on the whole table: equal sets once, pairs by shingles in common, components by reachability.
SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPS}', '{_LOWS}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') for i in range(1, len(w) - {SHINGLE_WORDS - 2})])) END AS s FROM w),
  named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN MIN(doc_id) OVER (PARTITION BY s) END AS node FROM s),
  one AS (SELECT node, s, len(s) AS n FROM s JOIN named USING (doc_id) WHERE doc_id = node),
  x AS (SELECT node, n, UNNEST(s) AS shingle FROM one),
  links AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.node <> b.node AND 100 * LEAST(a.n, b.n) >= 80 * GREATEST(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
  reach AS (SELECT node, node AS other FROM one UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
  root AS (SELECT node, MIN(other) AS component_id FROM reach GROUP BY node)
  SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, COALESCE(component_id, doc_id) AS component_id, doc_id = COALESCE(component_id, doc_id) AS kept FROM named LEFT JOIN root USING (node)"""
