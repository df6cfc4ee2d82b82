"""Writes. DataFrames do not change, so each gives a new frame; removals also give what was removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.frame import VoxelFrame
from voxlattice.operators.sets import difference, intersection, merge_with
from voxlattice.operators.transforms import map_values


def insert(frame: VoxelFrame, new: VoxelFrame) -> VoxelFrame:
    """The new cells' values win."""
    return merge_with(frame, new, lambda old, new: new)


def insert_with(frame: VoxelFrame, new: VoxelFrame, resolve: Callable[[Column, Column], Column]) -> VoxelFrame:
    """Where both are, ``resolve(old, new)``."""
    return merge_with(frame, new, resolve)


def upsert(frame: VoxelFrame, new: VoxelFrame) -> VoxelFrame:
    """Only where nothing was: the first writer wins."""
    return merge_with(frame, new, lambda old, new: old)


def insert_batch(rows: VoxelFrame, order: str) -> VoxelFrame:
    """Rows that were written in the order of a column: of equal cells the last stays."""
    last = W.partitionBy(*rows.keys).orderBy(F.col(order).desc())
    return rows.over(rows.df.withColumn("n", F.row_number().over(last)).where("n = 1"))


def bulk_load(rows: VoxelFrame, order: str) -> VoxelFrame:
    """``insert_batch`` by aggregation: combined before the shuffle, no sort."""
    return rows.over(rows.df.groupBy(*rows.keys).agg(F.max_by("value", order).alias("value")))


def remove(frame: VoxelFrame, target: VoxelFrame) -> tuple[VoxelFrame, VoxelFrame]:
    """(what stays, what was cut out)."""
    return difference(frame, target), intersection(frame, target)


def map_in_place(frame: VoxelFrame, fn: Callable[[Column], Column]) -> VoxelFrame:
    return map_values(frame, fn)


def clear(frame: VoxelFrame) -> VoxelFrame:
    return frame.over(frame.df.limit(0))
