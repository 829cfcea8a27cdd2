"""Runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def grouped_runs(batches: Iterable[pa.RecordBatch], key: int = 0, least: int = 1) -> Iterator[pa.Table]:
    """Whole runs of equal keys from sorted batches; several runs come together in one table, of so many rows at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = 0
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            cut = -1 if size >= least else 0
        if size + batch.num_rows >= least and not cut:
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut > 0 else held)
            held, size = [], 0
            batch = batch.slice(max(cut, 0))
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
