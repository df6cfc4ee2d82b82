"""Streaming over sorted groups: one pass per partition, one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, key: str, fn: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Shuffle by ``key`` and hand ``fn`` runs of whole groups.

    Many small groups arrive together in one table, so the cost per group is that of a slice, not of a Python
    call with its own Arrow stream. ``fn`` gets a list of tables, each one group. Callers bound the rows of a
    group (they cut larger ones into blocks first).
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(key)
            starts = _starts(keys)
            if held and held[-1].column(key)[0].as_py() != keys[0].as_py():
                yield from fn([pa.Table.from_batches(held)])
                held = []
            if len(starts) > 1:
                done = []
                if held:
                    done.append(pa.Table.from_batches([*held, batch.slice(0, starts[1])]))
                    first, held = 1, []
                else:
                    first = 0
                for a, b in zip(starts[first:-1], starts[first + 1 :], strict=True):
                    done.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                yield from fn(done)
            held.append(batch.slice(starts[-1]))
        if held:
            yield from fn([pa.Table.from_batches(held)])

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _starts(keys: pa.Array) -> list[int]:
    """Where a run of equal keys begins."""
    if len(keys) == 1:
        return [0]
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]


def spanning_forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A forest (child, root) over 0..n-1 that connects what the given pairs connect: at most n - 1 edges."""
    parent = np.arange(n)
    while True:
        a, b = parent[left], parent[right]
        low = np.minimum(a, b)
        before = parent.copy()
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while not np.array_equal(jumped := parent[parent], parent):
            parent = jumped
        if np.array_equal(before, parent):
            break
    return [(i, int(p)) for i, p in enumerate(parent) if p != i]
