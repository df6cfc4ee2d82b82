"""Lookups: what of a table lies in, overlaps or touches a target.

Targets are a few ranges given by the driver (literals, pushed to the scan) or a table of blocks. Tables of blocks of any
zooms are joined on ancestors: for each pair of zooms that occurs, both sides' ancestors at the coarser of the two, axis by
axis, are an equi-join key that only nested blocks share. x wraps everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.domain import WHOLE, check_index, check_zoom, limits
from voxlattice.frame import AXES, FLEX, VoxelFrame, block_bounds
from voxlattice.functions.ids import shift_left, shift_right


@dataclass(frozen=True)
class Range:
    """Closed index ranges at zoom z (x0 > x1 wraps around) and half-open seconds; None is the full axis."""

    z: int
    f: tuple[int, int] | None = None
    x: tuple[int, int] | None = None
    y: tuple[int, int] | None = None
    t: tuple[int, int] = (0, WHOLE)

    def __post_init__(self):
        check_zoom(self.z)
        for a in AXES:
            for i in getattr(self, a) or ():
                check_index(a, self.z, i)

    def spans(self, axis: str, z: int) -> list[tuple[int, int]]:
        """Half-open index spans of the axis at another zoom (rounded outward when coarser); two if x wraps."""
        low, high = limits(axis, self.z)
        lo, hi = getattr(self, axis) or (low, high)
        parts = [(lo, hi)] if lo <= hi else [(lo, high), (low, hi)] if axis == "x" else [(hi, lo)]
        if z >= self.z:
            return [(a << (z - self.z), (b + 1) << (z - self.z)) for a, b in parts]
        d = self.z - z
        return [(a >> d, (b >> d) + 1) for a, b in parts]

    def overlap(self, bounds: dict[str, tuple[Column, Column]], z: int, timed: bool) -> Column:
        """Whether half-open bounds at zoom z overlap the range."""
        hit = F.lit(True)
        for a in AXES:
            lo, hi = bounds[a]
            one = F.lit(False)
            for s, e in self.spans(a, z):
                one = one | ((lo < e) & (hi > s))
            hit = hit & one
        if timed:
            hit = hit & (bounds["t"][0] < self.t[1]) & (bounds["t"][1] > self.t[0])
        return hit


def _cell_bounds(frame: VoxelFrame) -> dict[str, tuple[Column, Column]]:
    out = {a: (F.col(a), F.col(a) + 1) for a in AXES}
    if frame.timed:
        out["t"] = (F.col("t0"), F.col("t1"))
    return out


def get_overlapping(frame: VoxelFrame, targets: list[Range], wrapped: bool = False) -> VoxelFrame:
    """Whole cells that overlap any target, once each; ``wrapped``: also those whose x is off the axis and wraps into one."""
    hit, bounds = F.lit(False), _cell_bounds(frame)
    for r in targets:
        hit = hit | r.overlap(bounds, frame.z, frame.timed)
    if wrapped:
        n = 1 << frame.z
        x = F.pmod(F.col("x"), F.lit(n))
        off, bounds = ~F.col("x").between(0, n - 1), bounds | {"x": (x, x + 1)}
        for r in targets:
            hit = hit | (off & r.overlap(bounds, frame.z, frame.timed))
    return frame.over(frame.df.where(hit))


def get(frame: VoxelFrame, target: Range) -> VoxelFrame:
    """What lies in the target, clipped to it in space and time (in cells of the finer zoom)."""
    out = get_overlapping(frame, [target]).refine(max(frame.z, target.z))
    out = get_overlapping(out, [target])
    if out.timed:
        out = out.over(out.df.withColumns({"t0": F.greatest("t0", F.lit(target.t[0])), "t1": F.least("t1", F.lit(target.t[1]))}))
    return out


# Tables of blocks ------------------------------------------------------------------------------------------------------


def _zooms(blocks: DataFrame) -> list[tuple[int, int, int]]:
    """The zoom triples that occur, at most ``(MAX_ZOOM + 1) ** 3`` and few in practice."""
    return sorted(tuple(r) for r in blocks.select(*[f"{a}z" for a in AXES]).distinct().collect())


def _keyed(blocks: DataFrame, others: list[tuple[int, int, int]], prefix: str, reach: bool, wrapped: bool = False) -> DataFrame:
    """One row per block and zoom triple of the other side: on each axis the block's ancestor at the coarser of both zooms.

    Two blocks whose ancestors agree are nested on every axis, so they meet; no block is ever cut into finer
    ones, however coarse. With ``reach`` the neighbours at the block's own zoom count as well, and keys along x are
    taken around the axis; ``wrapped`` does the same for the side without neighbours.
    """
    df = block_bounds(blocks)
    triple = lambda t: F.struct(*[F.lit(z).alias(a) for a, z in zip(AXES, t, strict=True)])
    df = df.withColumn("o", F.explode(F.array(*map(triple, others))) if others else F.explode(F.array().cast("array<struct<f:int,x:int,y:int>>")))
    for a in AXES:
        z, i = F.col(f"{a}z"), F.col(f"{a}i").cast("long")
        up = z - F.least(z, F.col(f"o.{a}"))
        if reach:
            n = shift_left(F.lit(1).cast("long"), z)
            near = [F.pmod(i + k, n) if a == "x" else i + k for k in (-1, 0, 1)]
            df = df.withColumn(f"{a}key", F.explode(F.array_distinct(F.array(*[shift_right(k, up) for k in near]))))
        else:
            if wrapped and a == "x":
                i = F.pmod(i, shift_left(F.lit(1).cast("long"), z))
            df = df.withColumn(f"{a}key", shift_right(i, up))
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _pairs(blocks: DataFrame, target: DataFrame, test, reach: bool = False) -> DataFrame:
    """Pairs of an equi-join on ancestors that pass ``test``; with ``reach`` a pair may occur several times."""
    target = target.select(*FLEX)
    left, right = _keyed(blocks, _zooms(target), "l_", reach), _keyed(target, _zooms(blocks), "r_", False, reach)
    on = [F.col(f"l_{a}key") == F.col(f"r_{a}key") for a in AXES]
    on += [F.col(f"l_{a}z") == F.col(f"r_o.{a}") for a in AXES] + [F.col(f"l_o.{a}") == F.col(f"r_{a}z") for a in AXES]
    return left.join(right, [*on, test])


def _axis_overlap(a: str) -> Column:
    return (F.col(f"l_{a}lo") < F.col(f"r_{a}hi")) & (F.col(f"r_{a}lo") < F.col(f"l_{a}hi"))


def _overlap() -> Column:
    return _axis_overlap("f") & _axis_overlap("x") & _axis_overlap("y") & _axis_overlap("t")


def blocks_overlapping(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Whole blocks that overlap any target block, once each."""
    hit = _pairs(blocks, target, _overlap())
    return hit.select(*[F.col("l_" + c).alias(c) for c in blocks.columns]).distinct()


def blocks_clipped(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Overlapping blocks cut to the target blocks: along each axis the deeper of two nested segments."""
    hit = _pairs(blocks, target, _overlap())
    cols = []
    for a in ("f", "x", "y", "t"):
        deeper = F.col(f"l_{a}z") >= F.col(f"r_{a}z")
        cols += [F.when(deeper, F.col(f"l_{a}{k}")).otherwise(F.col(f"r_{a}{k}")).alias(f"{a}{k}") for k in "zi"]
    rest = [F.col("l_" + c).alias(c) for c in blocks.columns if c not in FLEX]
    return hit.select(*cols, *rest).distinct()


def blocks_remove_overlapping(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks that no target block overlaps."""
    return blocks.join(blocks_overlapping(blocks.select(*FLEX), target), list(FLEX), "left_anti")


def _touch(a: str) -> Column:
    """The spans of an axis meet end to end; along x one's end, taken around the axis, is where the other begins."""
    if a == "x":
        seam = F.lit(1 << 30)
        return (F.pmod(F.col("l_xhi"), seam) == F.col("r_xlo")) | (F.pmod(F.col("r_xhi"), seam) == F.col("l_xlo"))
    return (F.col(f"l_{a}lo") == F.col(f"r_{a}hi")) | (F.col(f"r_{a}lo") == F.col(f"l_{a}hi"))


def shares_face() -> Column:
    """Exactly one spatial axis meets end to end, the other two overlap, and so does time."""
    out = F.lit(False)
    for a in AXES:
        others = [b for b in AXES if b != a]
        out = out | (_touch(a) & ~_axis_overlap(a) & _axis_overlap(others[0]) & _axis_overlap(others[1]))
    return out & _axis_overlap("t")


def blocks_sharing_face(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks that touch a target block by a face and overlap none."""
    near = _pairs(blocks, target, shares_face(), reach=True)
    near = near.select(*[F.col("l_" + c).alias(c) for c in blocks.columns]).distinct()
    return blocks_remove_overlapping(near, target)


# Reads over a whole frame ----------------------------------------------------------------------------------------------


def bounding_box(frame: VoxelFrame) -> DataFrame:
    """One row ``z, f0, f1, x0, x1, y0, y1``; none for an empty frame."""
    ends = [fn(a).alias(f"{a}{k}") for a in AXES for k, fn in ((0, F.min), (1, F.max))]
    return frame.df.agg(*ends).where("f0 is not null").select(F.lit(frame.z).alias("z"), "f0", "f1", "x0", "x1", "y0", "y1")


def max_zoom(blocks: DataFrame) -> DataFrame:
    """One row: the finest spatial zoom of a table of blocks (null if empty)."""
    return blocks.agg(F.max(F.greatest("fz", "xz", "yz")).alias("max_zoom"))


def is_empty(frame: VoxelFrame) -> DataFrame:
    """One row ``is_empty``; reads no more than a cell of each partition."""
    return frame.df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def value_get(frame: VoxelFrame, v) -> VoxelFrame:
    return frame.over(frame.df.where(F.col("value") == F.lit(v)))


def values(frame: VoxelFrame) -> DataFrame:
    """Distinct values, ascending."""
    return frame.df.select("value").distinct().orderBy("value")


def single_ids(blocks: DataFrame) -> DataFrame:
    """Cells of each block at the block's own finest zoom: ``z, f, x, y`` and the block's other columns."""
    df = blocks.withColumn("z", F.greatest("fz", "xz", "yz"))
    for a in AXES:
        s = shift_left(F.lit(1).cast("long"), F.col("z") - F.col(f"{a}z"))
        df = df.withColumn(a, F.explode(F.sequence(F.col(f"{a}i") * s, (F.col(f"{a}i") + 1) * s - 1).cast("array<int>")))
    return df.select("z", *AXES, *[c for c in blocks.columns if c not in FLEX[:6]])


def overlap_join(a: VoxelFrame, b: VoxelFrame) -> DataFrame:
    """Cells of both frames that meet in space and time: ``f, x, y[, t0, t1], value, other_value``."""
    z = max(a.z, b.z)
    a, b = a.refine(z), b.refine(z)
    right = b.df.withColumnRenamed("value", "other_value")
    if not (a.timed or b.timed):
        return a.df.join(right, list(AXES))
    a, b = a.with_time(), b.with_time()
    right = b.df.withColumnsRenamed({"value": "other_value", "t0": "u0", "t1": "u1"})
    met = a.df.join(right, list(AXES)).where("t0 < u1 and u0 < t1")
    return met.withColumns({"t0": F.greatest("t0", "u0"), "t1": F.least("t1", "u1")}).drop("u0", "u1")
