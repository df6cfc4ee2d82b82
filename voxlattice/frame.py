"""Voxel frames: a DataFrame of unit cells at one zoom, the engine's execution form.

Columns ``f, x, y`` and, in a timed frame, the half-open seconds ``t0, t1``; ``value`` in a valued frame. A frame holds
each point of space-time at most once. Frames of blocks (a zoom per axis) are the storage form, ``FLEX``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlattice.domain import WHOLE, check_zoom
from voxlattice.errors import InvalidQueryParameter
from voxlattice.functions.ids import shift_left

AXES = ("f", "x", "y")
FLEX = ("fz", "fi", "xz", "xi", "yz", "yi", "tz", "ti")
#: Cells that a refinement may make of one, unless the caller asks for more.
MAX_GROWTH = 1 << 21
#: Bytes of stored input, times the rows that come of one, that one task gets; in memory they are several times as many.
TASK_BYTES = 8 << 20
#: Sizes from here on are Spark's word for an unknown one.
_UNKNOWN = 1 << 50


@dataclass(frozen=True)
class VoxelFrame:
    df: DataFrame
    z: int
    timed: bool = False
    valued: bool = True

    @property
    def keys(self) -> list[str]:
        return [*AXES, *(("t0", "t1") if self.timed else ())]

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *(("value",) if self.valued else ())]

    def over(self, df: DataFrame, **changes) -> VoxelFrame:
        """A frame with the same form over another DataFrame."""
        out = replace(self, df=df, **changes)
        return replace(out, df=df.select(*out.columns))

    def cells(self) -> DataFrame:
        """``z`` and all columns of the frame."""
        return self.df.select(F.lit(self.z).alias("z"), *self.columns)

    def refine(self, z: int, axes: tuple[str, ...] = AXES) -> VoxelFrame:
        """The same space in cells of a finer zoom (along ``axes`` only: the caller drops the others)."""
        if z <= self.z:
            return self
        s = 1 << (z - self.z)
        if s ** len(axes) > MAX_GROWTH:
            raise InvalidQueryParameter(f"refining zoom {self.z} to {z} makes {s ** len(axes)} cells of each; coarsen the data or the operator")
        df = self.df
        for a in axes:
            df = df.withColumn(a, F.explode(F.sequence(F.col(a) * s, F.col(a) * s + (s - 1))))
        return self.over(df, z=check_zoom(z))

    def with_time(self) -> VoxelFrame:
        """A timed frame; cells without time get the whole of it."""
        if self.timed:
            return self
        df = self.df.withColumns({"t0": F.lit(0).cast("long"), "t1": F.lit(WHOLE).cast("long")})
        return self.over(df, timed=True)

    def without_values(self) -> VoxelFrame:
        return self.over(self.df, valued=False)


def cells_frame(df: DataFrame, z: int, timed: bool | None = None, valued: bool | None = None) -> VoxelFrame:
    """A frame over ``df`` with columns f, x, y[, t0, t1][, value]; other columns are dropped."""
    timed = "t0" in df.columns if timed is None else timed
    valued = "value" in df.columns if valued is None else valued
    out = VoxelFrame(df, check_zoom(z), timed, valued)
    kinds = {"f": "int", "x": "int", "y": "int", "t0": "long", "t1": "long"}
    return replace(out, df=df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in out.columns]))


def tasks_for(df: DataFrame, growth: int = 1) -> int | None:
    """Tasks among which rows of ``df`` are dealt where each grows to ``growth`` ones; None where few or unknown: AQE's choice.

    What a task aggregates is held in its memory, so their number goes with the size of what is read. The session's number
    of shuffle partitions is fixed, and AQE joins them by their size before the growth.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    size = 0
    while leaves.hasNext():
        size += int(str(leaves.next().stats().sizeInBytes()))
    n = -(-size * growth // TASK_BYTES)
    return n if size < _UNKNOWN and n > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, keys: list[str], growth: int = 1) -> DataFrame:
    """Rows dealt out by ``keys`` in as many tasks as their size asks for; few rows stay where they are."""
    n = tasks_for(df, growth)
    return df if n is None else df.repartition(n, *keys)


def _bounds(zoom: Column, index: Column, top: int) -> tuple[Column, Column]:
    one = F.lit(1).cast("long")
    width = shift_left(one, F.lit(top) - zoom)
    return index * width, (index + 1) * width


def block_bounds(df: DataFrame) -> DataFrame:
    """Adds half-open bounds at the finest zoom (30; seconds for time) to a table of blocks."""
    out = {}
    for a in AXES:
        out[f"{a}lo"], out[f"{a}hi"] = _bounds(F.col(f"{a}z"), F.col(f"{a}i"), 30)
    out["tlo"], out["thi"] = _bounds(F.col("tz"), F.col("ti"), 35)
    return df.withColumns(out)


def to_blocks(frame: VoxelFrame) -> DataFrame:
    """One block per cell, or one per dyadic time segment of it in a timed frame (not yet canonical)."""
    from voxlattice.functions.timeaxis import dyadic_column

    df = frame.df
    for a in AXES:
        df = df.withColumn(f"{a}z", F.lit(frame.z)).withColumnRenamed(a, f"{a}i")
    if frame.timed:
        df = df.withColumn("seg", F.explode(dyadic_column(F.col("t0"), F.col("t1"), 35))).withColumns({"tz": F.col("seg.zoom"), "ti": F.col("seg.index")})
    else:
        df = df.withColumns({"tz": F.lit(0), "ti": F.lit(0).cast("long")})
    return df.select(*FLEX, *(("value",) if frame.valued else ()))


def from_blocks(blocks: DataFrame, z: int, timed: bool = False) -> VoxelFrame:
    """Cells at zoom z of blocks that are nowhere finer than z."""
    df = blocks
    for a in AXES:
        s = shift_left(F.lit(1).cast("long"), F.lit(z) - F.col(f"{a}z"))
        df = df.withColumn(a, F.explode(F.sequence(F.col(f"{a}i") * s, (F.col(f"{a}i") + 1) * s - 1)))
    if timed:
        lo, hi = _bounds(F.col("tz"), F.col("ti"), 35)
        df = df.withColumns({"t0": lo, "t1": hi})
    return cells_frame(df, z, timed=timed)
