"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace

#: Links that one union-find pass holds in a Python worker.
CHUNK_LINKS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace links by stars to the smallest node of each local component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    up = list(range(len(nodes)))
    for x, y in zip(flat[:n].tolist(), flat[n:].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
    for i, x in enumerate(up):  # parents are smaller, so one pass settles all
        up[i] = up[x]
    root = np.array(up, dtype=np.int64)
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= CHUNK_LINKS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(links: DataFrame, space: Workspace, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node of ``links`` (two long columns), root the
    smallest node that can be reached.

    Each round is a large-star and a small-star step (alternated as published by
    Kiveris et al., 2014), both a partial minimum and an equi-join on nodes; a
    hub is a hot join key, which AQE splits. Before each round, links of a
    partition shrink to stars. Rounds end when the star graph stays the same.
    Nulls in ``links`` are ignored; a node linked to itself only is left out.
    """
    u, v = links.columns[:2]
    edges = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    edges = space.write(edges.where("u <> v").mapInArrow(_local, "u long, v long").distinct(), f"{name}-0")
    last = None
    for k in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = down.join(small, "u").select("u", "v", "m")
        step = pairs.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = space.write(step.where("u <> v").distinct(), f"{name}-{k}")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        space.drop(f"{name}-{k - 1}")
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)
