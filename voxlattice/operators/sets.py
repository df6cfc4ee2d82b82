"""Overlays of two frames: merge, intersection, difference, set algebra.

Both sides are brought to one zoom and, where one is timed, to common time spans; then cells are equal or disjoint and
every overlay is an aggregation or equi-join on the cell's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.frame import AXES, VoxelFrame
from voxlattice.operators.policies import _BOUNDS, MergePolicy
from voxlattice.operators.transforms import value_kind

_HASHED = {*_BOUNDS, "double", "float", "boolean", "date", "timestamp"}


def align(a: VoxelFrame, b: VoxelFrame) -> tuple[VoxelFrame, VoxelFrame]:
    """Both frames at the finer zoom and, if any is timed, cut at the union of both sides' time boundaries."""
    z = max(a.z, b.z)
    a, b = a.refine(z), b.refine(z)
    if not (a.timed or b.timed):
        return a, b
    a, b = a.with_time(), b.with_time()
    ends = None
    for side in (a, b):
        for t in ("t0", "t1"):
            one = side.df.select(*AXES, F.col(t).alias("t"))
            ends = one if ends is None else ends.unionByName(one)
    ends = ends.distinct()
    following = F.lead("t").over(W.partitionBy(*AXES).orderBy("t"))
    pieces = ends.withColumn("next", following).where("next is not null")
    cut = pieces.select(*[F.col(k).alias(f"c{k}") for k in AXES], F.col("t").alias("s0"), F.col("next").alias("s1"))

    def split(side: VoxelFrame) -> VoxelFrame:
        on = [F.col(k) == F.col(f"c{k}") for k in AXES]
        rows = side.df.join(cut, [*on, F.col("t0") <= F.col("s0"), F.col("s1") <= F.col("t1")])
        return side.over(rows.drop("t0", "t1").withColumnsRenamed({"s0": "t0", "s1": "t1"}))

    return split(a), split(b)


def _both(a: VoxelFrame, b: VoxelFrame) -> tuple[DataFrame, VoxelFrame]:
    """Full overlay: keys, ``va``, ``vb`` (null where a side is absent).

    Cells are unique per side. For values that hash aggregation can hold, the overlay is one aggregation over the
    union: one shuffle, no sort, combined before it. Others are joined.
    """
    a, b = align(a, b)
    if value_kind(a) in _HASHED and value_kind(b) in _HASHED:
        none = lambda kind: F.lit(None).cast(kind)
        left = a.df.select(*a.keys, F.col("value").alias("va"), none(value_kind(b)).alias("vb"))
        right = b.df.select(*a.keys, none(value_kind(a)).alias("va"), F.col("value").alias("vb"))
        return left.unionAll(right).groupBy(*a.keys).agg(F.max("va").alias("va"), F.max("vb").alias("vb")), a
    left, right = a.df.withColumnRenamed("value", "va"), b.df.withColumnRenamed("value", "vb")
    return left.join(right, a.keys, "full_outer"), a


def merge(a: VoxelFrame, b: VoxelFrame, default, policy: MergePolicy) -> VoxelFrame:
    """Cells of either side: ``policy.resolve`` of the two values, ``default`` standing for an absent one."""
    both, form = _both(a, b)
    kind = value_kind(a)
    fill = lambda c: F.coalesce(F.col(c), F.lit(default)).cast(kind)
    return form.over(both.withColumn("value", policy.resolve(fill("va"), fill("vb"), kind).cast(kind)))


def merge_with(a: VoxelFrame, b: VoxelFrame, resolve: Callable[[Column, Column], Column]) -> VoxelFrame:
    """Overlay without default: where one side is absent, the other's value stays."""
    both, form = _both(a, b)
    met = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return form.over(both.withColumn("value", F.when(met, resolve(F.col("va"), F.col("vb"))).otherwise(F.coalesce("va", "vb"))))


def _half(a: VoxelFrame, b: VoxelFrame, how: str) -> VoxelFrame:
    a, b = align(a, b)
    return a.over(a.df.join(b.df.select(*b.keys), a.keys, how))


def intersection(a: VoxelFrame, b: VoxelFrame) -> VoxelFrame:
    """A where B is, with A's values."""
    return _half(a, b, "left_semi")


def difference(a: VoxelFrame, b: VoxelFrame) -> VoxelFrame:
    """A where B is not."""
    return _half(a, b, "left_anti")


def union(a: VoxelFrame, b: VoxelFrame) -> VoxelFrame:
    """Cells of either; with values, A's where both are."""
    if a.valued and b.valued:
        return merge_with(a, b, lambda x, y: x)
    a, b = align(a.without_values(), b.without_values())
    return a.over(a.df.unionByName(b.df).distinct())


def set_intersection(a: VoxelFrame, b: VoxelFrame) -> VoxelFrame:
    a, b = align(a.without_values(), b.without_values())
    return a.over(a.df.intersect(b.df))


def set_difference(a: VoxelFrame, b: VoxelFrame) -> VoxelFrame:
    a, b = align(a.without_values(), b.without_values())
    return a.over(a.df.subtract(b.df))
