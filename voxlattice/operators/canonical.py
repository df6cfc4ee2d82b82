"""Canonical blocks: sibling halves with equal content become one, axis by axis.

Space is halved along f, x, y in turn, level by level. From the deepest level up, the two halves of a node become one
along the node's axis if they hold the same blocks and none of these is cut deeper along that axis. The result
depends on the content only. Above and below ground never merge.

Cells are dealt out by a prefix ``STEP`` levels above them and merged inside it with array operations, so what is held
together is bounded by ``8**STEP`` cells. Each prefix is then one row (a hash of its relative content, and whether it
is cut deeper along each axis) and is merged in the same way with its neighbours, up to ``TOP_ZOOM``; the at most
``2 * 8**TOP_ZOOM`` rows that are left are merged on the driver. What each level decided is added up downward over the
small tables and reaches the blocks in one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlattice.errors import UnsupportedOperation
from voxlattice.frame import AXES, FLEX, VoxelFrame
from voxlattice.functions.ids import shift_right

STEP = 6
TOP_ZOOM = 4
#: Rows that a worker merges at once; a prefix is never cut.
_CHUNK = 100_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _hash(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * _MUL
        h ^= h >> np.uint64(29)
    return h


def _labels(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers from 0 that are equal where all columns are; two columns at a time are packed into one, which sorts fast."""
    label = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        if not len(c):
            return label
        # Labels are below the number of rows and indices below 2**32, so that the product stays in 64 bits.
        low = c.min()
        label = np.unique(label * (int(c.max() - low) + 1) + (c - low), return_inverse=True)[1].reshape(-1)
    return label


def merge_levels(zoom: np.ndarray, index: np.ndarray, value: np.ndarray, frozen: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """Merge blocks in place from zoom ``bottom`` up to below zoom ``top``; returns which rows remain.

    ``zoom``, ``index``: (n, 3) by axis; ``value``: content codes; ``frozen``: (n, 3), rows whose content is cut deeper
    along an axis than the row shows, so that it cannot merge along it.
    """
    alive = np.ones(len(value), bool)
    for depth in range(bottom, top, -1):
        for axis in (2, 1, 0):
            rows = np.flatnonzero(alive)
            # The node that this axis halves at this depth: earlier axes are already cut to `depth` there.
            path = []
            for a in range(3):
                d = depth if a < axis else depth - 1
                z, i = zoom[rows, a], index[rows, a]
                path.append(np.where(z > d, i >> np.maximum(z - d, 0), i << np.maximum(d - z, 0)))
            # A row coarser than the node along another axis stands in every node that it crosses; it was merged
            # there at a deeper level, so all of its nodes look alike and the first of them speaks for it.
            node = _labels(path)
            own_z = zoom[rows, axis]
            upper = (np.where(own_z >= depth, index[rows, axis] >> np.maximum(own_z - depth, 0), 0) & 1).astype(bool)
            others = [a for a in range(3) if a != axis]
            content = _hash(*(zoom[rows, a] for a in others), *(index[rows, a] for a in others), value[rows])
            n = node.max() + 1 if len(node) else 0
            sums = np.zeros((2, n), np.uint64)
            np.add.at(sums, (upper.astype(int), node), content)
            counts = np.zeros((2, n), np.int64)
            np.add.at(counts, (upper.astype(int), node), 1)
            blocked = np.zeros(n, bool)
            np.logical_or.at(blocked, node, (own_z != depth) | frozen[rows, axis])
            join = (sums[0] == sums[1]) & (counts[0] == counts[1]) & (counts[0] > 0) & ~blocked
            hit = join[node]
            low, high = rows[hit & ~upper], rows[hit & upper]
            zoom[low, axis] -= 1
            index[low, axis] >>= 1
            alive[high] = False
    return alive


def _codes(values: pd.Series) -> np.ndarray:
    """64-bit content codes that agree across partitions."""
    return pd.util.hash_pandas_object(values, index=False).to_numpy(np.uint64).view(np.int64)


def _by_prefix(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over runs of whole prefixes, about ``_CHUNK`` rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < _CHUNK:
                continue
            rows = pd.concat(held, ignore_index=True)
            same = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if cut:
                yield fn(rows.iloc[:cut].reset_index(drop=True))
            held, n = [rows.iloc[cut:]], len(rows) - cut
        if n:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _relative(zoom: np.ndarray, index: np.ndarray, p: int) -> list[np.ndarray]:
    """Indices inside the prefix at zoom p, wherever that is."""
    below = np.maximum(zoom - p, 0)
    return [index[:, k] - ((index[:, k] >> below[:, k]) << below[:, k]) for k in range(3)]


def _summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per prefix: ``f, x, y`` (its indices), ``code`` (order-free hash of the content), ``df, dx, dy`` (cut deeper)."""
    digest = F.xxhash64(F.sum(F.col("code").cast("decimal(38,0)")), F.count(F.lit(1)))
    return rows.groupBy(*[F.col(n).alias(a) for n, a in zip(names, AXES, strict=True)]).agg(digest.alias("code"), *[F.max(f"d{a}").alias(f"d{a}") for a in AXES])


def _merged(f: np.ndarray, code: np.ndarray, deeper: np.ndarray, zoom_from: int, zoom_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alive, zooms, indices) of prefixes at one zoom after merging up to another."""
    zoom, index = np.full((len(f), 3), zoom_from, np.int64), f.astype(np.int64).copy()
    return merge_levels(zoom, index, code, deeper, zoom_to, zoom_from), zoom, index


def canonicalize(frame: VoxelFrame, step: int = STEP, top: int = TOP_ZOOM) -> DataFrame:
    """The canonical blocks of a frame without time: ``fz, fi, xz, xi, yz, yi, tz, ti[, value]``."""
    if frame.timed:
        raise UnsupportedOperation("blocks of timed frames: coalesce the time axis, then canonicalize the cells of each span")
    spark, z = frame.df.sparkSession, frame.z
    value = ["value"] if frame.valued else []
    kind = dict(frame.df.dtypes).get("value")
    levels = [z]
    while levels[-1] > top:
        levels.append(max(top, levels[-1] - step))
    if len(levels) == 1:
        levels.append(z)
    p = levels[1]
    keys = [f"p{a}" for a in AXES]
    flags = ", ".join(f"d{a} boolean" for a in AXES)
    schema = ", ".join(["fz int, fi int, xz int, xi int, yz int, yi int", *([f"value {kind}"] if value else []), "pf int, px int, py int, code long", flags])

    def cells_inside(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        zoom, index = np.full((n, 3), z, np.int64), pdf[list(AXES)].to_numpy(np.int64).copy()
        codes = _codes(pdf["value"]) if value else np.zeros(n, np.int64)
        alive = merge_levels(zoom, index, codes, np.zeros((n, 3), bool), p, z)
        zoom, index, out = zoom[alive], index[alive], {}
        for k, a in enumerate(AXES):
            out[f"{a}z"], out[f"{a}i"] = zoom[:, k].astype(np.int32), index[:, k].astype(np.int32)
        if value:
            out["value"] = pdf["value"].to_numpy()[alive]
        for a in keys:
            out[a] = pdf[a].to_numpy()[alive]
        out["code"] = _hash(*zoom.T, *_relative(zoom, index, p), codes[alive]).view(np.int64)
        for k, a in enumerate(AXES):
            out[f"d{a}"] = zoom[:, k] > p
        return pd.DataFrame(out)

    cells = frame.df.withColumns({f"p{a}": F.shiftright(a, z - p) for a in AXES})
    # Read again below; a lost partition of it is made again from its input.
    blocks = _by_prefix(cells, keys, cells_inside, schema).persist(StorageLevel.MEMORY_AND_DISK)
    table, decided = _summary(blocks, keys), []
    for here, above in zip(levels[1:-1], levels[2:], strict=True):
        decided.append(_level(table, here, above))
        table = _summary(decided[-1].where("keep"), ["qf", "qx", "qy"])

    # At most 2 * 8**top rows.
    last, rest = levels[-1], table.toPandas()
    alive, zoom, _ = _merged(rest[list(AXES)].to_numpy().reshape(-1, 3), rest["code"].to_numpy(np.int64), rest[[f"d{a}" for a in AXES]].to_numpy(bool).reshape(-1, 3), last, 0)
    rows = [(*map(int, i), bool(k), *(int(last - v) for v in u)) for i, k, u in zip(rest[list(AXES)].to_numpy(), alive, zoom, strict=True) if not k or (u < last).any()]
    names = ["cf", "cx", "cy", "kept", *(f"v{a}" for a in AXES)]
    change = spark.createDataFrame(rows, ", ".join(f"{c} {'boolean' if c == 'kept' else 'int'}" for c in names))
    changes = bool(rows)
    for level in reversed(decided):
        if changes:
            joined = level.join(change, F.expr("qf = cf and qx = cx and qy = cy"), "left")
            kept = F.col("keep") & F.coalesce("kept", F.lit(True))
            own = joined.select(*[F.col(a).alias(f"c{a}") for a in AXES], kept.alias("kept"), *[(F.col(f"u{a}") + F.coalesce(f"v{a}", F.lit(0))).alias(f"v{a}") for a in AXES])
        else:
            own = level.select(*[F.col(a).alias(f"c{a}") for a in AXES], F.col("keep").alias("kept"), *[F.col(f"u{a}").alias(f"v{a}") for a in AXES])
        change, changes = own.where("not kept or vf + vx + vy > 0"), True
    out = blocks
    if changes:
        out = blocks.join(change, F.expr("pf = cf and px = cx and py = cy"), "left").where(F.coalesce("kept", F.lit(True)))
        for a in AXES:
            less = F.coalesce(f"v{a}", F.lit(0))
            out = out.withColumns({f"{a}z": F.col(f"{a}z") - less, f"{a}i": shift_right(F.col(f"{a}i"), less)})
    return out.withColumns({"tz": F.lit(0), "ti": F.lit(0).cast("long")}).select(*FLEX, *value)


def _level(table: DataFrame, here: int, above: int) -> DataFrame:
    """Prefixes at zoom ``here`` merged up to zoom ``above``: whether each stays (``keep``), by how much its blocks' zooms
    shrink (``uf, ux, uy``), the prefix above (``qf, qx, qy``) and its content for the next level."""
    keys = ["qf", "qx", "qy"]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        code, deeper = pdf["code"].to_numpy(np.int64), pdf[[f"d{a}" for a in AXES]].to_numpy(bool)
        alive, zoom, index = _merged(pdf[list(AXES)].to_numpy(), code, deeper, here, above)
        out = pdf[[*AXES, *keys]].copy()
        out["keep"] = alive
        out["code"] = _hash(*zoom.T, *_relative(zoom, index, above), code).view(np.int64)
        for k, a in enumerate(AXES):
            out[f"u{a}"] = (here - zoom[:, k]).astype(np.int32)
            out[f"d{a}"] = deeper[:, k] | (zoom[:, k] > above)
        return out

    schema = "f int, x int, y int, qf int, qx int, qy int, keep boolean, code long, uf int, df boolean, ux int, dx boolean, uy int, dy boolean"
    rows = table.withColumns({f"q{a}": F.shiftright(a, here - above) for a in AXES})
    return _by_prefix(rows, keys, inside, schema).persist(StorageLevel.MEMORY_AND_DISK)
