"""Shards: frames cut to a block of space, halved, and put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlattice.domain import limits
from voxlattice.errors import InvalidShardMerge
from voxlattice.frame import AXES, VoxelFrame
from voxlattice.operators.lookups import Range

#: A shard's region: (zoom, index) for each axis.
Region = dict[str, tuple[int, int]]


def _span(region: Region, axis: str, z: int) -> tuple[int, int]:
    zoom, i = region[axis]
    if zoom <= z:
        return i << (z - zoom), (i + 1) << (z - zoom)
    return i >> (zoom - z), (i >> (zoom - z)) + 1


def in_shard(frame: VoxelFrame, region: Region) -> VoxelFrame:
    """What of the frame lies in the region."""
    z = max(frame.z, *(zoom for zoom, _ in region.values()))
    frame = frame.refine(z)
    inside = F.lit(True)
    for a in AXES:
        lo, hi = _span(region, a, z)
        inside = inside & (F.col(a) >= lo) & (F.col(a) < hi)
    return frame.over(frame.df.where(inside))


def should_split(frame: VoxelFrame, most: int) -> bool:
    """Whether the shard holds more than ``most`` cells; reads no more than one beyond."""
    return frame.df.limit(most + 1).count() > most


def split_region(region: Region) -> tuple[Region, Region]:
    """Halves along the shallowest axis (f before x before y)."""
    axis = min(AXES, key=lambda a: (region[a][0], AXES.index(a)))
    zoom, i = region[axis]
    return {**region, axis: (zoom + 1, 2 * i)}, {**region, axis: (zoom + 1, 2 * i + 1)}


def split_shard(frame: VoxelFrame, region: Region) -> list[tuple[Region, VoxelFrame]]:
    return [(half, in_shard(frame, half)) for half in split_region(region)]


def _within(inner: Region, outer: Region) -> bool:
    return all(inner[a][0] >= outer[a][0] and inner[a][1] >> (inner[a][0] - outer[a][0]) == outer[a][1] for a in AXES)


def _disjoint(a: Region, b: Region) -> bool:
    return any(min(x, y)[1] != max(x, y)[1] >> (max(x, y)[0] - min(x, y)[0]) for x, y in ((a[k], b[k]) for k in AXES))


def merge_shards(parent: Region, children: list[tuple[Region, VoxelFrame]]) -> VoxelFrame:
    """The union of disjoint shards inside a parent region: no shuffle, as they cannot overlap."""
    regions = [r for r, _ in children]
    if not children or not all(_within(r, parent) for r in regions):
        raise InvalidShardMerge("a child lies outside its parent")
    if any(not _disjoint(a, b) for i, a in enumerate(regions) for b in regions[:i]):
        raise InvalidShardMerge("children overlap")
    z = max(f.z for _, f in children)
    frames = [f.refine(z) for _, f in children]
    df = frames[0].df
    for f in frames[1:]:
        df = df.unionByName(f.df)
    return frames[0].over(df)


def shard_keys(frame: VoxelFrame, z: int) -> VoxelFrame:
    """The frame dealt out by its cells at a coarse zoom: columns for ``partitionBy`` in a table layout."""
    d = frame.z - z
    df = frame.df.withColumn("shard", F.concat_ws("/", *[F.shiftright(a, d) for a in AXES]))
    return VoxelFrame(df, frame.z, frame.timed, frame.valued)


def region_range(region: Region) -> Range:
    """The region as a lookup target at its deepest zoom."""
    z = max(zoom for zoom, _ in region.values())
    spans = {a: _span(region, a, z) for a in AXES}
    for a in AXES:
        low, high = limits(a, z)
        spans[a] = (max(low, spans[a][0]), min(high, spans[a][1] - 1))
    return Range(z, **spans)
