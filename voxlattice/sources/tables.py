"""Stored tables of blocks: Parquet with a format version, laid out for range scans.

Blocks are dealt into directories by a coarse cell and sorted by their key inside the files, so that a region's scan is
pruned by directory and by row-group statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlattice.errors import UnsupportedFormat
from voxlattice.frame import FLEX, VoxelFrame, cells_frame, tasks_for
from voxlattice.functions.ids import shift_right
from voxlattice.operators.lookups import Range, get_overlapping

#: Written with each table; other versions are not read.
FORMAT_VERSION = 1
#: Small tables of cells have directories of this zoom at the finest.
DIRECTORY_ZOOM = 3


def working_folder(spark: SparkSession) -> str:
    """A new folder below the shared one of ``spark.checkpoint.dir``; a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="voxlattice-tables-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Any table of blocks with its value column."""
    blocks.withColumn("format_version", F.lit(FORMAT_VERSION)).repartitionByRange("xz", "xi", "yi").sortWithinPartitions("xz", "xi", "yi", "fi").write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not set(FLEX) <= set(df.columns) or "format_version" not in df.columns:
        raise UnsupportedFormat("not a table of blocks")
    if df.where(F.col("format_version") != FORMAT_VERSION).limit(1).count():
        raise UnsupportedFormat(f"a table of another format version than {FORMAT_VERSION}")
    return df.drop("format_version")


def write_cells(frame: VoxelFrame, path: str, shard_zoom: int = 4) -> None:
    """Directories ``sz/sx/sy``: a cell's column at zoom ``sz``, which is ``shard_zoom`` or as much coarser as the table is small.

    A directory takes time to make and to list however little it holds, so their number goes with the size of the table.
    Cells are dealt out by range: a task writes few directories, and one that holds much is written by several tasks.
    """
    top = min(shard_zoom, frame.z)
    n = tasks_for(frame.df)
    sz = min(top, max(DIRECTORY_ZOOM, ((n or 1).bit_length() + 1) // 2))
    df = frame.cells().withColumns({"sz": F.lit(sz), "sx": F.shiftright("x", frame.z - sz), "sy": F.shiftright("y", frame.z - sz)})
    keys = [F.col(c) for c in ("sx", "sy", "x", "y")]
    df = df.repartitionByRange(*keys) if n is None else df.repartitionByRange(n, *keys)
    df.sortWithinPartitions("sx", "sy", "x", "y", "f").write.mode("overwrite").partitionBy("sz", "sx", "sy").parquet(path)


class CellTable:
    """A stored table of cells as a query source: a demanded region becomes partition and row-group filters."""

    def __init__(self, spark: SparkSession, path: str, z: int, shard_zoom: int = 4):
        self.spark, self.path, self.z, self.shard_zoom = spark, path, z, min(shard_zoom, z)

    def read(self, ranges: list[Range] | None = None) -> VoxelFrame:
        df = self.spark.read.parquet(self.path)
        if ranges is None:
            return cells_frame(df, self.z)
        # Tables of before have no ``sz``; their directories are of ``shard_zoom``.
        up = F.lit(self.shard_zoom) - (F.col("sz") if "sz" in df.columns else F.lit(self.shard_zoom))
        hit = F.lit(False)
        for r in ranges:
            one = F.lit(True)
            for column, axis in (("sx", "x"), ("sy", "y")):
                part = F.lit(False)
                for a, b in r.spans(axis, self.shard_zoom):
                    part = part | F.col(column).between(shift_right(F.lit(a), up), shift_right(F.lit(b - 1), up))
                one = one & part
            hit = hit | one
        return get_overlapping(cells_frame(df.where(hit), self.z), ranges)
