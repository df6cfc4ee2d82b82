"""Time runs: adjacent spans of equal cells and values become one, labelled in the unit asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlattice.domain import CALENDAR, WHOLE
from voxlattice.frame import VoxelFrame
from voxlattice.functions.timeaxis import coarsest_allowed, coarsest_unit


def coalesce_time(frame: VoxelFrame) -> VoxelFrame:
    """Maximal spans: gaps and islands over each cell's time line."""
    frame = frame.with_time()
    rest = [c for c in frame.columns if c not in ("t0", "t1")]
    line = W.partitionBy(*rest).orderBy("t0", "t1")
    # Overlapping spans count as adjacent: the running end is the largest so far.
    before = F.max("t1").over(line.rowsBetween(W.unboundedPreceding, -1))
    rows = frame.df.withColumn("new", F.when(before >= F.col("t0"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return frame.over(rows.groupBy(*rest, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")))


def range_ids(frame: VoxelFrame, units: tuple[int, ...] | None = None) -> DataFrame:
    """``z, f, x, y, i, lo, hi[, value]``: a row per run of time, in closed indices of a unit.

    Without ``units`` the unit is the coarsest possible, gcd(start, width); with them the coarsest allowed one.
    """
    runs = coalesce_time(frame)
    unit = coarsest_unit(F.col("t0"), F.col("t1")) if units is None else coarsest_allowed(F.col("t0"), F.col("t1"), units)
    rows = runs.df.withColumn("i", unit)
    return rows.select(
        F.lit(frame.z).alias("z"), "f", "x", "y", F.col("i").cast("long").alias("i"),
        (F.col("t0") / F.col("i")).cast("long").alias("lo"), ((F.col("t1") / F.col("i")).cast("long") - 1).alias("hi"),
        *(("value",) if frame.valued else ()),
    )


def calendar_ids(frame: VoxelFrame) -> DataFrame:
    return range_ids(frame, CALENDAR)


def flat_single_ids(frame: VoxelFrame, units: tuple[int, ...] | None = None) -> DataFrame:
    """``z, f, x, y, i, t[, value]``: each run as one row per index of its unit."""
    rows = range_ids(frame, units)
    return rows.withColumn("t", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def is_whole(i) -> bool:
    return i == WHOLE
