"""Streams of observations: events become cells and time buckets, aggregated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlattice.domain import check_zoom
from voxlattice.functions.projection import cell_of
from voxlattice.functions.timeaxis import bucket
from voxlattice.operators.policies import MergePolicy


def to_cells(events: DataFrame, z: int, interval: int, time: str = "ts") -> DataFrame:
    """Adds ``f, x, y`` from lat, lon, alt, and the index ``t`` of the interval that holds the event's second."""
    check_zoom(z)
    at = cell_of(F.col("lat"), F.col("lon"), F.col("alt"), z)
    return events.withColumn("cell", at).withColumns({**{a: F.col(f"cell.{a}") for a in "fxy"}, "t": bucket(F.unix_timestamp(time), interval)}).drop("cell")


def windowed_cells(cells: DataFrame, interval: int, policy: MergePolicy, kind: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``f, x, y, t0, t1, value`` per cell and tumbling interval; works on streams and on tables.

    On a stream, state of an interval goes once the watermark has passed it; later events are dropped.
    """
    rows = cells.withWatermark(time, late).groupBy("f", "x", "y", F.window(time, f"{interval} seconds").alias("w"))
    out = rows.agg(policy.aggregate(F.col("value"), F.col(time), kind).alias("value"))
    return out.select("f", "x", "y", F.unix_timestamp("w.start").alias("t0"), F.unix_timestamp("w.end").alias("t1"), "value")


def upsert_into(path: str):
    """A ``foreachBatch`` function that appends updates with their batch number; ``latest`` reads the table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return write


def latest(table: DataFrame, keys: tuple[str, ...] = ("f", "x", "y", "t0", "t1")) -> DataFrame:
    """The last update of each key."""
    return table.groupBy(*keys).agg(F.max_by("value", "batch").alias("value"))
