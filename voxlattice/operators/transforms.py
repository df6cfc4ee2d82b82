"""Transforms of one frame: shift, extrude, falloff, zoom out, filters, value maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlattice.domain import check_index, check_zoom, limits
from voxlattice.errors import InvalidQueryParameter
from voxlattice.frame import AXES, VoxelFrame, dealt, tasks_for
from voxlattice.functions.ids import shift_left, shift_right
from voxlattice.operators.policies import _BOUNDS, MergePolicy, truncated_division


def value_kind(frame: VoxelFrame) -> str:
    return dict(frame.df.dtypes)["value"]


def _order(frame: VoxelFrame) -> Column:
    return F.struct(*[F.col(k) for k in frame.keys])


def _guarded(axis: str, to: Column, z: int) -> Column:
    low, high = limits(axis, z)
    return F.when(to.between(low, high), to).otherwise(F.raise_error(F.lit(f"shift leaves the {axis} axis")).cast("int"))


def shift(frame: VoxelFrame, axis: str, z: int, n: int) -> VoxelFrame:
    """Translate by n cells of zoom z. x is cyclic; leaving f or y is an error of the whole query."""
    if n == 0:
        return frame
    check_shift(axis, z, n)
    frame = frame.refine(z)
    d = n << (frame.z - z)
    at = F.col(axis).cast("long") + d
    to = F.pmod(at, F.lit(1 << frame.z)) if axis == "x" else _guarded(axis, at, frame.z)
    return frame.over(frame.df.withColumn(axis, to.cast("int")))


def check_shift(axis: str, z: int, n: int) -> None:
    if abs(n) > (1 << check_zoom(z)) - 1:
        raise InvalidQueryParameter(f"shift_{axis} by {n} is more than the axis holds at zoom {z}")


def check_extrude(axis: str, z: int, a: int, b: int) -> None:
    check_zoom(z)
    check_index(axis, z, a)
    check_index(axis, z, b)


def extrude(frame: VoxelFrame, axis: str, z: int, a: int, b: int, policy: MergePolicy) -> VoxelFrame:
    """Forget ``axis`` and occupy [a, b] of it at zoom z; x runs eastward from a to b and wraps if a > b."""
    check_extrude(axis, z, a, b)
    if axis != "x":
        a, b = min(a, b), max(a, b)
    rest = tuple(k for k in AXES if k != axis)
    fine = frame.refine(z, rest)
    s = 1 << (fine.z - z)
    keys = [k for k in fine.keys if k != axis]
    # Equal cells along the forgotten axis meet before anything is multiplied.
    grouped = fine.df.groupBy(*keys).agg(policy.aggregate(F.col("value"), F.col(axis), value_kind(frame)).alias("value"))
    if a <= b:
        run = F.sequence(F.lit(a * s), F.lit((b + 1) * s - 1))
    else:
        run = F.concat(F.sequence(F.lit(a * s), F.lit((1 << fine.z) - 1)), F.sequence(F.lit(0), F.lit((b + 1) * s - 1)))
    return fine.over(grouped.withColumn(axis, F.explode(run)))


@dataclass(frozen=True)
class Pattern:
    """How a value decreases with distance d up to radius r; integers truncate, multiplying before dividing."""

    name: str

    def attenuate(self, v: Column, d: Column, r: int, kind: str) -> Column:
        if self.name == "Linear":
            above, below = v * (F.lit(r) - d), r
        elif self.name == "QuadraticIn":
            above, below = v * (F.lit(r * r) - d * d), r * r
        elif self.name == "QuadraticOut":
            above, below = v * (F.lit(r) - d) * (F.lit(r) - d), r * r
        else:
            raise InvalidQueryParameter(f"no falloff pattern {self.name}")
        return truncated_division(above, F.lit(below)).cast(kind) if kind in _BOUNDS else above / below


#: Cells of a lane that stay together in a falloff's exchange.
LANE_TILE = 1 << 16
#: Cells of a tile along each axis in which several falloffs run, unless they reach far.
TILE = 64
LINEAR, QUADRATIC_IN, QUADRATIC_OUT = Pattern("Linear"), Pattern("QuadraticIn"), Pattern("QuadraticOut")
#: Zooms that a coarsening may span for its rows to be dealt out by its result's cells: no key has more than 8**7 rows.
DEALT_ZOOMS = 7
DIRECTIONS = {"both": (-1, 1), "upper": (0, 1), "lower": (-1, 0)}


def check_falloff(axis: str, z: int, r: int, direction: str) -> None:
    check_zoom(z)
    if direction not in DIRECTIONS:
        raise InvalidQueryParameter(f"direction {direction} is not one of {sorted(DIRECTIONS)}")
    if r < 0:
        raise InvalidQueryParameter("falloff radius below 0")


def falloff(frame: VoxelFrame, axis: str, z: int, r: int, direction: str, pattern: Pattern, policy: MergePolicy) -> VoxelFrame:
    """Scatter each value to offsets within r cells of zoom z along ``axis``, attenuated; combine by ``policy``.

    All contributions to a cell come from its lane (the cells that share the other coordinates). The rows are
    dealt out by lane before they are multiplied, so the shuffle carries the input and not the 2r + 1 times as
    many contributions, and the aggregation that follows needs no further exchange. Long lanes are cut into tiles;
    a row near a tile's edge goes to both sides. A tile has at most ``LANE_TILE`` cells (per time span), so no key
    of the exchange is hot, however the cells lie.
    """
    if r == 0:
        return frame
    check_falloff(axis, z, r, direction)
    frame = frame.refine(z)
    kind, stride, n = value_kind(frame), 1 << (frame.z - z), 1 << frame.z
    low, high = DIRECTIONS[direction]
    lane = [k for k in frame.keys if k != axis]
    d = F.abs(F.col("d")).cast("long")
    at = F.col(axis).cast("long") + F.col("d") * stride
    to = F.pmod(at, F.lit(n)) if axis == "x" else at
    rows, tile = frame.df, None
    width = max(LANE_TILE, 1 << (2 * r * stride).bit_length())
    if n > width:
        tile, tiles = F.col("tile"), (2 * n if axis == "f" else n) // width
        first, last = (F.floor((F.col(axis).cast("long") + k * r * stride) / width) for k in (low, high))
        reached = F.when(first == last, F.array(first)).otherwise(F.array(first, last))
        rows = rows.withColumn("tile", F.explode(reached))
        if axis == "x":
            rows = rows.withColumn("tile", F.pmod(tile, F.lit(tiles)))
    dealt = [*lane, *(("tile",) if tile is not None else ())]
    n_tasks = tasks_for(rows, (high - low) * r + 1)
    rows = (rows.repartition(*dealt) if n_tasks is None else rows.repartition(n_tasks, *dealt)).withColumn("d", F.explode(F.array(*[F.lit(k) for k in range(low * r, high * r + 1)])))
    if tile is not None:
        rows = rows.where(F.floor(to / width) == tile)
    rows = rows.select(*dealt, to.cast("int").alias(axis), pattern.attenuate(F.col("value"), d, r, kind).alias("value"), F.struct(F.col(axis), F.col("d")).alias("seq"))
    if axis != "x":
        rows = rows.where(F.col(axis).between(*limits(axis, frame.z)))
    return frame.over(rows.groupBy(*dealt, axis).agg(policy.aggregate(F.col("value"), F.col("seq"), kind).alias("value")))


def fuses(frame: VoxelFrame, steps: list) -> bool:
    """Whether ``falloffs`` can take the steps: none is finer than the frame, and no policy looks at the order of values."""
    return all(step.z <= frame.z and step.policy.commutative for step in steps)


def falloffs(frame: VoxelFrame, steps: list) -> VoxelFrame:
    """Several falloffs in order, over one exchange of the input instead of one for each step's output.

    Space is cut into tiles along the axes of the steps. A row goes to each tile that the steps together can carry it to,
    as an index relative to the tile; every step then runs inside the tiles, on what can still reach them.
    """
    for step in steps:
        check_falloff(step.axis, step.z, step.r, step.direction)
    steps = [step for step in steps if step.r]
    n = 1 << frame.z
    reach = [tuple(k * step.r << (frame.z - step.z) for k in DIRECTIONS[step.direction]) for step in steps]

    def left(axis, first=0):
        """How far the steps from ``first`` on carry along the axis, down and up."""
        own = [r for step, r in zip(steps[first:], reach[first:], strict=True) if step.axis == axis]
        return sum(low for low, _ in own), sum(high for _, high in own)

    axes = [a for a in AXES if left(a) != (0, 0)]
    rows, width, growth = frame.df, {}, 1
    for a in axes:
        low, high = left(a)
        width[a] = min(n, max(TILE, 16 << (high - low).bit_length()))
        first, last = (F.floor((F.col(a).cast("long") + k) / width[a]) for k in (low, high))
        rows = rows.withColumn(f"tile_{a}", F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))
        rows = rows.withColumn(a, F.col(a) - F.col(f"tile_{a}") * width[a])
        if a == "x":
            rows = rows.withColumn("tile_x", F.pmod(F.col("tile_x"), F.lit(n // width[a])))
    for step in steps:
        growth *= (DIRECTIONS[step.direction][1] - DIRECTIONS[step.direction][0]) * step.r + 1
    # Steps meet in the same cells: the last one holds about a quarter of the product at once.
    keys = [*(f"tile_{a}" for a in axes), *(k for k in frame.keys if k not in axes)]
    n_tasks = tasks_for(rows, max(1, growth // 4))
    rows = rows.repartition(*keys) if n_tasks is None else rows.repartition(n_tasks, *keys)
    whole = lambda a: F.col(f"tile_{a}") * width[a] + F.col(a)
    for k, step in enumerate(steps):
        kind, a = dict(rows.dtypes)["value"], step.axis
        low, high = DIRECTIONS[step.direction]
        rows = rows.withColumn("d", F.explode(F.array(*[F.lit(i) for i in range(low * step.r, high * step.r + 1)])))
        value = step.pattern.attenuate(F.col("value"), F.abs(F.col("d")).cast("long"), step.r, kind).alias("value")
        to = F.col(a) + F.col("d") * (1 << (frame.z - step.z))
        rows = rows.select(*[c for c in rows.columns if c not in ("d", "value", a)], to.alias(a), value)
        low, high = left(a, k + 1)
        rows = rows.where(F.col(a).between(-high, width[a] - 1 - low))
        if a != "x":
            rows = rows.where(whole(a).between(*limits(a, frame.z)))
        # Their order is of no account, so any column may stand for it.
        rows = rows.groupBy(*[c for c in rows.columns if c != "value"]).agg(step.policy.aggregate(F.col("value"), F.lit(0), kind).alias("value"))
    return frame.over(rows.withColumns({a: whole(a).cast("int") for a in axes}))


def zoom_out(frame: VoxelFrame, z: int, policy: MergePolicy, weight: str = "cell") -> VoxelFrame:
    """Parents at zoom z, equal ones resolved by ``policy``.

    Rows are dealt out by parent in as many tasks as their size asks for, so what a task holds does not grow. Parents of
    more than ``DEALT_ZOOMS`` zooms, which may be few and large, are combined in place first, in the session's partitions.
    ``weight="cell"`` folds unit cells; ``"block"`` folds the canonical blocks, where eight equal children are
    one. They differ for Sum and Average only.
    """
    check_zoom(z)
    if z >= frame.z:
        return frame
    d = frame.z - z
    if weight == "block":
        from voxlattice.operators.canonical import canonicalize

        if frame.timed:
            raise InvalidQueryParameter("block weights need a frame without time")
        blocks = canonicalize(frame)
        # A block coarser than z along an axis stands for all its cells at z, once each.
        df = blocks
        for a in AXES:
            up, down = F.greatest(F.col(f"{a}z") - z, F.lit(0)), F.greatest(F.lit(z) - F.col(f"{a}z"), F.lit(0))
            first = shift_left(shift_right(F.col(f"{a}i"), up).cast("long"), down)
            df = df.withColumn(a, F.explode(F.sequence(first, first + shift_left(F.lit(1).cast("long"), down) - 1).cast("array<int>")))
        order = F.struct("fz", "fi", "xz", "xi", "yz", "yi")
    else:
        df = frame.df.withColumn("seq", _order(frame))
        df = df.withColumns({a: F.shiftright(F.col(a), d) for a in AXES})
        order = F.col("seq")
    if policy.commutative or policy.name == "Average":
        df = df.drop("seq")
        order = F.lit(0)
    if d <= DEALT_ZOOMS:
        df = dealt(df, frame.keys)
    return frame.over(df.groupBy(*frame.keys).agg(policy.aggregate(F.col("value"), order, value_kind(frame)).alias("value")), z=z)


def pyramid(frame: VoxelFrame, levels: list[int], policy: MergePolicy):
    """Several zoom levels at once: ``z, f, x, y[, t0, t1], value`` in one aggregation.

    Rows are dealt out by tile before they are multiplied by the levels; a tile is a cell of the coarsest of them, so the
    aggregation needs no other exchange and a task holds what its share of the input grows to.
    """
    if any(level > frame.z for level in levels):
        raise InvalidQueryParameter("a pyramid's levels are at most the frame's zoom")
    df, tile = frame.df.withColumn("seq", _order(frame)), []
    if policy.commutative or policy.name == "Average":
        df = df.withColumn("seq", F.lit(0))
    if levels and frame.z - min(levels) <= DEALT_ZOOMS:
        tile = [f"tile_{a}" for a in AXES]
        df = df.withColumns({f"tile_{a}": F.shiftright(a, frame.z - min(levels)) for a in AXES})
        df = dealt(df, tile, len(levels))
    df = df.withColumn("z", F.explode(F.array(*map(F.lit, levels))))
    df = df.withColumns({a: shift_right(F.col(a), F.lit(frame.z) - F.col("z")) for a in AXES})
    keys = ["z", *frame.keys]
    out = df.groupBy(*tile, *keys).agg(policy.aggregate(F.col("value"), F.col("seq"), value_kind(frame)).alias("value"))
    return out.select(*keys, "value")


@dataclass(frozen=True)
class Bound:
    """One end of a value range."""

    value: Any
    included: bool = True


def _bound(b: Any) -> Bound | None:
    return b if b is None or isinstance(b, Bound) else Bound(b)


@dataclass(frozen=True)
class ValuePredicate:
    """``equals`` a value, or ``inside`` / ``outside`` a range with included, excluded or open ends."""

    kind: str
    value: Any = None
    low: Bound | None = None
    high: Bound | None = None

    def check(self) -> None:
        if self.low and self.high and self.low.value > self.high.value:
            raise InvalidQueryParameter("a value range whose lower end is above its upper end")

    def column(self) -> Column:
        v = F.col("value")
        if self.kind == "equals":
            return v == F.lit(self.value)
        inside = F.lit(True)
        if self.low:
            inside = inside & ((v >= F.lit(self.low.value)) if self.low.included else (v > F.lit(self.low.value)))
        if self.high:
            inside = inside & ((v <= F.lit(self.high.value)) if self.high.included else (v < F.lit(self.high.value)))
        return inside if self.kind == "inside" else ~inside


def equals(v: Any) -> ValuePredicate:
    return ValuePredicate("equals", v)


def inside(low: Any = None, high: Any = None) -> ValuePredicate:
    return ValuePredicate("inside", None, _bound(low), _bound(high))


def outside(low: Any = None, high: Any = None) -> ValuePredicate:
    return ValuePredicate("outside", None, _bound(low), _bound(high))


def filter_values(frame: VoxelFrame, predicate: ValuePredicate) -> VoxelFrame:
    predicate.check()
    return frame.over(frame.df.where(predicate.column()))


def map_values(frame: VoxelFrame, fn: Callable[[Column], Column]) -> VoxelFrame:
    """Any Column function of the value (a pandas UDF is one); it may change the type."""
    return frame.over(frame.df.withColumn("value", fn(F.col("value"))), valued=True)
