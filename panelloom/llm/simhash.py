"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming links.

A fingerprint has 64 bits. Cut into B blocks, two fingerprints that differ in
at most R bits agree on at least B - R blocks; so each fingerprint is filed
under every choice of B - R blocks, and close ones meet under one key. Only
distinct fingerprints are filed, so exact copies cost nothing, and a key fixes
so many bits that the fingerprints under one key have a proven upper number
(2 to the power of the free bits), whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, release, small_side, spread, unused
from panelloom.llm.graph import components, forest
from panelloom.llm.jaccard import SHINGLE_ROWS, Shingles, join_rest, parities, prefix, shingle_batch
from panelloom.llm.runs import grouped_runs

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Seven blocks, five of which must agree: 21 keys, 2^19 fingerprints under a key at most.
BLOCKS = 7
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16
#: Members under one key up to which all distances are computed at once.
DENSE = 512


_LANES = np.uint64(0x0101010101010101)
#: Counters of a byte hold so many rows.
LANE_ROWS = 255


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the hashes of each run have each bit: (runs, 64), the highest bit first.

    Eight bits of a hash at a time are spread over the bytes of a word, so that one
    sum counts all eight; runs are summed in pieces that a byte can count."""
    n = len(hashes)
    sizes = np.diff(np.append(starts, n))
    pieces = -(-sizes // LANE_ROWS)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    inside = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + inside * LANE_ROWS
    out = np.empty((len(starts), 64), dtype=np.int64)
    for shift in range(8):
        summed = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        lanes = summed.astype(">u8").view(np.uint8).reshape(-1, 8)
        out[:, 7 - shift :: 8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    return out


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    count = np.zeros(64, dtype=np.int64)
    raw = hashes.astype(">u8", copy=False).view(np.uint8).reshape(n, 8)
    for k in range(0, n, COUNT_ROWS):
        count += np.unpackbits(raw[k : k + COUNT_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def text_fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Words are runs of non-white ASCII-wise bytes, A-Z lower-cased; bytes.split and bytes.lower do just that."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1))
    return majority(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) of every row; null or wordless text has fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((text_fingerprint(t.as_py(), width) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = MAX_DISTANCE) -> list[int]:
    """For each choice of blocks that must agree, the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the radius; memory stays in proportion to DENSE times the members."""
    left, right = [], []
    for k in range(0, len(fps), DENSE):
        d = np.bitwise_count(fps[k : k + DENSE, None] ^ fps[None, k:])
        i, j = np.nonzero(d <= radius)
        keep = i < j
        left.append(i[keep] + k)
        right.append(j[keep] + k)
    return np.concatenate(left), np.concatenate(right)


def close_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the pairs within the radius connect.

    Few fingerprints are compared all with all; many (which share a key, so few
    bits are free) look up each of their neighbours, in proportion to their number."""
    fps = np.unique(fps)
    if len(fps) <= DENSE * 4:
        i, j = _near(fps, radius)
        return forest(fps[i].view(np.int64), fps[j].view(np.int64)) if len(i) else (np.empty(0, np.int64),) * 2
    base = fps[0]
    free = [np.uint64(1 << k) for k in range(64) if np.any((fps ^ base) & np.uint64(1 << k))]
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for r in range(1, radius + 1):
        for bits in combinations(free, r):
            other = fps ^ np.bitwise_or.reduce(bits)
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = (fps[at] == other) & (fps < other)
            if hit.any():
                a, b = forest(np.concatenate([a, fps[hit].view(np.int64)]), np.concatenate([b, other[hit].view(np.int64)]))
    return a, b


def _link_runs(radius: int, kinds: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in grouped_runs(batches):
            keys = tab.column(0).to_numpy()
            fps = tab.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            many = np.flatnonzero(np.diff(cuts) > 1)
            for k in many:
                a, b = close_forest(fps[cuts[k] : cuts[k + 1]], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    return run


def hamming_links(fps: DataFrame, radius: int = MAX_DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) that connect the same groups as all pairs of distinct
    fingerprints within the radius do. ``fps`` has one long column, distinct.

    A key is the masked fingerprint hashed with the number of its mask; the rare
    meeting of two keys under one hash adds comparisons, never links."""
    masks = block_masks(blocks, radius)
    filed = fps.select(F.col(fps.columns[0]).alias("fp")).select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("key"))
    return filed.select("key", "fp").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_link_runs(radius, len(masks)), "u long, v long")


def near_duplicates(docs: DataFrame, space: Workspace, width: int = SHINGLE_WORDS, radius: int = MAX_DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most ``radius`` bits
    reach, itself included. Null text counts as wordless: fingerprint zero,
    linked like any other. A null doc_id keeps its row and never is a smallest
    id; a component of null ids only has a null component_id. Rows that repeat
    are each returned. An empty table gives an empty result; extra columns are
    ignored.
    """
    signed = space.write(fingerprints(docs, width), "fp")
    groups = space.write(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = space.write(components(hamming_links(groups.select("fp"), radius, blocks), space), "roots")
    merged = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = merged.groupBy("root").agg(F.min("first").alias("component_id"))
    label = merged.join(least, "root").select("fp", "component_id")
    # A fingerprint that a third of all rows share is a hot key here; the inner join of narrow rows is one that AQE splits.
    return signed.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TOPS = np.uint64(0x8080808080808080)
#: What has features just beyond a power of two of blocks is filed under half as many blocks, too.
EDGE = 1.25


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def block_keys(h: np.ndarray, owner: np.ndarray, n: np.ndarray, per: int, least: int, filed: int | None, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of the pigeonhole blocks of lines: h are features, owner their lines, n the features of each line.

    Each block is the SimHash of the features that their own hash deals to it, so an
    edit touches the blocks of its features only, and what has fewer edits than blocks
    shares one. There are so many blocks that one gets ``per`` features on average or
    half of it; those with ``least`` features are keys, of the first ``filed`` only if that is given
    (for callers that have an exact way for the rest)."""
    level = np.maximum(1, np.ceil(np.log2(np.maximum(n, 1) / per) - 1e-9)).astype(np.int64)
    lower = (level > 1) & (n <= EDGE * per * 2.0 ** (level - 1))
    keys, lines = [], []
    for down in (0, 1):
        if down:
            mine = lower[owner]
            h, owner = h[mine], owner[mine]
        now = level - down
        block = (h >> np.uint64(20)).astype(np.int64) & ((1 << now) - 1)[owner]
        of, x = owner, h
        if filed is not None:
            used = block < filed
            of, block, x = owner[used], block[used], h[used]
        if not len(x):
            continue
        wide = int(block.max()) + 1
        flat = of * wide + block
        order = np.argsort(flat)
        flat, x = flat[order], x[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        size = np.diff(np.append(starts, len(flat)))
        most = ((np.uint64(127) - np.minimum(size // 2, 127).astype(np.uint64))) * _LANES
        value = np.zeros(len(starts), dtype=np.uint64)
        for shift in range(8):  # bits set in over half of the features, eight bits at a time
            summed = np.add.reduceat((x >> np.uint64(shift)) & _LANES, starts)
            value |= (((summed + most) & _TOPS) >> np.uint64(7)) << np.uint64(shift)
        full = size >= least
        at, value = flat[starts][full], value[full]
        line = at // wide
        name = (((now[line] << 40) + at % wide) * 8 + salt).astype(np.uint64)
        keys.append(scramble((value ^ scramble(name * ODD)) * ODD))
        lines.append(line)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(lines)


#: What the stage takes for the same text: shingles of five words, exact Jaccard similarity.
STAGE_WIDTH, STAGE_SIMILARITY = 5, 0.8
#: Shingles of a block, at least so many for a key, and blocks filed: at 0.8 a pair of texts of 100
#: words or more shares none of them about once in a thousand times.
STAGE_PER_BLOCK, STAGE_LEAST, STAGE_FILED = 4, 2, 14


def shingle_hashes(text: str | None, width: int = STAGE_WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of a text (of all its words if they are fewer); words as for fingerprints."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))
    width = min(width, len(w))
    h = np.zeros(len(w) - width + 1, dtype=np.uint64)
    for i in range(width):
        h = (h ^ w[i : len(w) - width + 1 + i]) * ODD
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def text_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a text: its pigeonhole blocks, and all its shingles together."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    key, _ = block_keys(shingles, np.zeros(n, np.int64), np.array([n]), STAGE_PER_BLOCK, STAGE_LEAST, STAGE_FILED, 3)
    return np.append(key, scramble(np.bitwise_xor.reduce(scramble(shingles)) + np.uint64(n))[None]).view(np.int64)


def _key_rows(similarity: float):
    """Rows (body, text) to the keys under which a text is filed, and what the exact join needs: size, parities and prefix of its shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [shingle_hashes(t.as_py()) for t in batch.column(1)]
            longs = pa.list_(pa.int64())
            lists = [pa.array(x, longs) for x in ([text_keys(x) for x in sets], [parities(x) for x in sets], [prefix(x, similarity).view(np.int64) for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), *lists], ["body", "n", "keys", "parity", "first"])

    return run


def _shingle_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield shingle_batch(batch.column(0), [shingle_hashes(t.as_py()) for t in batch.column(1)])


def _root_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, body, root) in runs of keys to pairs of bodies: the smallest body of each root with that of the next root."""
    for tab in grouped_runs(batches, least=50_000):
        key, body, root = (tab.column(i).to_numpy() for i in range(3))
        order = np.lexsort((body, root, key))
        key, body, root = key[order], body[order], root[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (root[1:] != root[:-1])
        key, body = key[first], body[first]
        i = np.flatnonzero(key[1:] == key[:-1])
        if len(i):
            both = np.unique(np.sort(np.stack([body[i], body[i + 1]]), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def similar_texts(docs: DataFrame, space: Workspace, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """(node, root) of the texts, named by their xxhash64, that links of the Jaccard similarity of word shingles connect.

    ``docs`` has body and text. Texts meet under a pigeonhole block of their shingles'
    SimHash. Every text under a key is first held against the one of the smallest name,
    then the groups under a key against each other in a row, so that pairs grow with
    the texts and not with their square. Links of different groups that are left share
    a shingle of their prefixes, and all that may be one are tried."""
    texts = spread(docs.where("text is not null"))
    longs = "array<long>"
    signed = texts.mapInArrow(_key_rows(similarity), f"body long, n long, keys {longs}, parity {longs}, first {longs}")
    signed = space.write(signed.groupBy("body").agg(*[F.first(c).alias(c) for c in ("n", "keys", "parity", "first")]), "signed")
    filed = space.write(signed.select("body", F.explode("keys").alias("key")), "blocks")
    least = filed.groupBy("key").agg(F.min("body").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    shared = space.write(filed.join(least, "key"), "shared")
    pairs = space.write(shared.where("body <> a").select("a", F.col("body").alias("b")).distinct(), "pairs-1")

    def read(nodes: DataFrame, name: str) -> DataFrame:
        need = small_side(space.write(nodes.withColumnRenamed("node", "body"), f"need-{name}"), 16)
        found = texts.join(need, "body", "left_semi").mapInArrow(_shingle_rows, SHINGLE_ROWS).dropDuplicates(["node"])
        return space.write(found, f"shingles-{name}")

    shingles = Shingles(read, space)
    tried = space.write(shingles.confirm(pairs, similarity), "links-1")
    roots = space.write(components(tried.where("linked"), space, "near-1"), "near-roots-1")
    rooted = shared.join(small_side(roots.withColumnRenamed("node", "body"), 24), "body", "left").select("key", "body", F.coalesce("root", "body").alias("root"))
    rest = rooted.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_root_pairs, "a long, b long").distinct()
    rest = space.write(rest.join(pairs, ["a", "b"], "left_anti"), "pairs-2")
    if not rest.isEmpty():
        tried = tried.unionByName(space.write(shingles.confirm(rest, similarity), "links-2"))
        roots = space.write(components(tried.where("linked"), space, "near-2"), "near-roots-2")
    space.drop("blocks", "shared")
    sets = signed.select(F.col("body").alias("node"), "n", "parity", F.col("first").alias("keys"))
    return join_rest(sets, roots, tried, shingles, space, similarity)


def _body(text: Column) -> Column:
    """By what the stage tells texts apart; 0 for null and wordless ones."""
    worded = F.coalesce(F.rlike(text.cast("string"), F.lit(r"[^ \t\n\x0b\f\r]")), F.lit(False))
    return F.when(worded, F.xxhash64(text.cast("string"))).otherwise(F.lit(0))


def one_of_each(docs: DataFrame, space: Workspace) -> DataFrame:
    """One row of each group of near-duplicate texts, all columns kept.

    It is the row with the smallest doc_id (null last), of those the one of the
    smallest text hash, of those the smallest row. Texts make the groups, so rows that
    share an id are told apart and none goes for another's sake. Null and wordless
    texts are one group, as they all have no shingle. An empty table gives an empty
    result; a very long text is one array of shingle hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body(docs["text"]).alias("body"))
    texts = docs.select(_body(docs["text"]).alias("body"), F.col("text").cast("string").alias("text")).where("body <> 0")
    inner = space.within("texts")
    roots = similar_texts(texts, inner)
    rooted = space.write(rows.join(small_side(roots.withColumnRenamed("node", "body"), 24), "body", "left").select("doc_id", "body", F.coalesce("root", "body").alias("root")), "rooted")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    inner.drop()
    keep = space.write(rooted.groupBy("root").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1").select("root", "keep"), "keep")
    # Groups of many copies are hot keys; the join has nothing above it that needs them together, so AQE splits it.
    member = space.write(rooted.join(keep, "root").select("doc_id", "body", (place == F.col("keep")).alias("kept")), "members")
    id_, body_, row_ = unused(docs, "id", "body", "row")
    key = (F.col("doc_id").alias(id_), F.col("body").alias(body_))
    gone = space.write(member.where("not kept").select(*key).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (_body(docs["text"]) == F.col(body_))
    left = docs.join(small_side(gone, 24), same, "left_anti")
    # Rows that repeat both the id and the text of a kept one are still there.
    again = space.write(member.where("kept").groupBy("doc_id", "body").count().where("count > 1").select(*key), "again")
    if again.isEmpty():
        return left
    again = small_side(again, 24)
    once = left.join(again, same, "left_semi").groupBy(F.col("doc_id").cast("long").alias(id_), _body(F.col("text")).alias(body_)).agg(F.min(F.struct(*left.columns)).alias(row_)).select(f"{row_}.*")
    return left.join(again, same, "left_anti").unionByName(once)
